"""Queries on crop acreage and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrelane.operators import crops
from acrelane.operators.ingest import upsert_acres
from acrelane.plans.registry import query
from acrelane.shared import written

_STAR = "(SELECT a.*, r.name AS region_name, r.region_type, c.cdl_code, c.name AS crop_name, c.category, c.is_row_crop FROM {crop_acres} a JOIN {crop_region} r ON a.region_id = r.region_id JOIN {crop_type} c ON a.crop_type_id = c.crop_type_id)"


def star(t):
    return t("crop_acres"), t("crop_region"), t("crop_type")


def doubled(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


@query("crop_star_join", f"SELECT region_name, region_type, crop_name, category, year, CAST(acres AS DOUBLE) AS acres, pixel_count FROM {_STAR} s")
def crop_star_join(t):
    return doubled(crops.crop_summary(*star(t)), "acres")


@query("crop_totals_by_region", f"SELECT region_name, crop_name, CAST(sum(acres) AS DOUBLE) AS total_acres, count(DISTINCT year) AS n_years, min(year) AS first_year, max(year) AS last_year FROM {_STAR} s GROUP BY 1, 2")
def crop_totals_by_region(t):
    return doubled(crops.crop_totals_by_region(*star(t)), "total_acres")


@query("crop_totals_by_year", f"SELECT year, crop_name, CAST(sum(acres) AS DOUBLE) AS total_acres, count(DISTINCT region_id) AS n_regions FROM {_STAR} s GROUP BY 1, 2")
def crop_totals_by_year(t):
    return doubled(crops.crop_totals_by_year(t("crop_acres"), t("crop_type")), "total_acres")


@query("row_crop_filter", f"SELECT region_name, crop_name, year, CAST(acres AS DOUBLE) AS acres FROM {_STAR} s WHERE is_row_crop")
def row_crop_filter(t):
    return doubled(crops.row_crops_by_region_year(*star(t)), "acres")


@query("top_crops_by_region", f"SELECT region_name, crop_name, year, CAST(acres AS DOUBLE) AS acres, CAST(row_number() OVER (PARTITION BY region_id ORDER BY year DESC, acres DESC, crop_type_id) AS INT) AS crop_rank FROM {_STAR} s")
def top_crops_by_region(t):
    return doubled(crops.top_crops(*star(t)), "acres")


@query("crop_trends", f"SELECT region_name, crop_name, year, CAST(acres AS DOUBLE) AS acres, CAST(p AS DOUBLE) AS previous, CAST(acres - p AS DOUBLE) AS change, CASE WHEN p > 0 THEN round(CAST(acres - p AS DOUBLE) / CAST(p AS DOUBLE) * 100, 6) END AS percent FROM (SELECT *, lag(acres) OVER (PARTITION BY region_id, crop_type_id ORDER BY year) AS p FROM {_STAR} s) x")
def crop_trends(t):
    return doubled(crops.crop_trends(*star(t)), "acres", "previous", "change")


@query("skip_codes_filter", "SELECT code, count(*) AS pixel_count FROM {pixels} p WHERE code NOT IN (0, 111, 121, 122, 123, 124, 131) GROUP BY code HAVING count(*) >= 10")
def skip_codes_filter(t):
    return crops.keep_crop_counts(t("pixels").groupBy("code").agg(F.count("*").alias("pixel_count")))


@query("pixels_to_acres", "SELECT code, round(count(*) * 0.222394e0, 4) AS acres FROM {pixels} p GROUP BY code")
def pixels_to_acres(t):
    return t("pixels").groupBy("code").agg(F.count("*").alias("n")).select("code", crops.pixels_to_acres(F.col("n")).alias("acres"))


#: Five regions over each hundred rows of the pixel grid: square, triangle, L, square with a hole, two parts.  Vertices of each ring.
_RINGS = [
    [[(10, 5), (60, 5), (60, 45), (10, 45)]],
    [[(0, 0), (90, 0), (45, 80)]],
    [[(5, 10), (70, 10), (70, 30), (40, 30), (40, 70), (5, 70)]],
    [[(20, 10), (90, 10), (90, 80), (20, 80)], [(40, 30), (60, 30), (60, 50), (40, 50)]],
    [[(2, 2), (20, 2), (20, 20), (2, 20)], [(50, 50), (95, 50), (95, 75), (50, 75)]],
]


def regions(t):
    block = F.col("block").cast("double") * 100
    ring = lambda points: F.array(*[F.struct(F.lit(float(x)).alias("x"), (block + float(y)).alias("y")) for x, y in points])
    shapes = F.array(*[F.struct((F.col("block") * 5 + i).cast("bigint").alias("region_id"), F.array(*map(ring, parts)).alias("rings")) for i, parts in enumerate(_RINGS)])
    blocks = t("pixels").select(F.floor(F.col("row_no") / 100).alias("block")).distinct()
    return blocks.select(F.inline(shapes))


def _inside(points):
    """Even-odd test of a pixel centre against one ring, by its edges."""
    tests = []
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        if ay != by:
            tests.append(f"CASE WHEN row_no % 100 + 0.5e0 >= {min(ay, by)} AND row_no % 100 + 0.5e0 < {max(ay, by)} AND col_no + 0.5e0 >= {ax} + (row_no % 100 + 0.5e0 - {ay}) / ({by} - {ay}) * ({bx} - {ax}) THEN 1 ELSE 0 END")
    return " + ".join(tests)


_ZONAL = " UNION ALL ".join(f"SELECT CAST(floor(row_no / 100) AS BIGINT) * 5 + {i} AS region_id, code FROM {{pixels}} p WHERE ({' + '.join(_inside(r) for r in parts)}) % 2 = 1" for i, parts in enumerate(_RINGS))


_COUNTED = f"SELECT region_id, code, count(*) AS pixel_count, round(count(*) * 0.222394e0, 4) AS acres FROM ({_ZONAL}) z WHERE code NOT IN (0, 111, 121, 122, 123, 124, 131) AND code <> 255 GROUP BY region_id, code HAVING count(*) >= 10"


@query("crop_zonal_counts", _COUNTED)
def crop_zonal_counts(t):
    return crops.zonal_counts(t("pixels"), regions(t), nodata=255)


@query("crop_tiled_counts", _COUNTED)
def crop_tiled_counts(t):
    """The same by histograms of tiles."""
    tiles = written(crops.tile_histograms(t("pixels"), nodata=255), "tiles")
    return crops.tiled_counts(t("pixels"), tiles, regions(t), nodata=255)


_VALID = "(SELECT code FROM {pixels} p WHERE code <> 255)"


@query("raster_profile", f"SELECT (SELECT count(*) FROM {{pixels}} p) AS total, count(*) AS valid, (SELECT count(*) FROM {{pixels}} p WHERE code = 255) AS nodata, min(code) AS min_code, max(code) AS max_code, round(avg(code), 6) AS mean_code, CAST(median(code) AS DOUBLE) AS median_code FROM {_VALID} v")
def raster_profile(t):
    return crops.raster_profile(t("pixels"), 255)[0].withColumn("mean_code", F.round("mean_code", 6))


@query("raster_top_codes", f"SELECT code, count(*) AS n, round(count(*) * 100e0 / (SELECT count(*) FROM {_VALID} w), 6) AS percent FROM {_VALID} v GROUP BY code ORDER BY n DESC, code LIMIT 4")
def raster_top_codes(t):
    return crops.raster_profile(t("pixels"), 255, top=4)[1]


_NEW = "(SELECT region_id, crop_type_id, CAST(1997 AS INT) AS year, pixel_count + 5 AS pixel_count, CAST(acres + 1 AS DOUBLE) AS acres FROM {crop_acres} a WHERE year = 1997 AND region_id % 2 = 0 UNION ALL SELECT region_id, crop_type_id, CAST(2031 AS INT), pixel_count, CAST(acres AS DOUBLE) FROM {crop_acres} a WHERE year = 1996 AND region_id % 3 = 0)"


@query("upsert_measure", f"SELECT region_id, crop_type_id, year, CAST(acres AS DOUBLE) AS acres, pixel_count FROM {{crop_acres}} a WHERE NOT (year = 1997 AND region_id % 2 = 0) UNION ALL SELECT region_id, crop_type_id, year, acres, pixel_count FROM {_NEW} n")
def upsert_measure(t):
    old = doubled(t("crop_acres"), "acres").select("region_id", "crop_type_id", "year", "acres", "pixel_count")
    codes = t("crop_type").select("crop_type_id", F.col("cdl_code").alias("code"))
    new = old.filter("year = 1997 and region_id % 2 = 0").withColumns({"pixel_count": F.col("pixel_count") + 5, "acres": F.col("acres") + 1}).unionAll(old.filter("year = 1996 and region_id % 3 = 0").withColumn("year", F.lit(2031)))
    counts = new.join(codes, "crop_type_id").select("region_id", "code", "year", "acres", "pixel_count")
    return upsert_acres(old, counts, t("crop_type"))

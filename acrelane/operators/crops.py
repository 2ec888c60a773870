"""Crop acreage: zonal counts of raster pixels, upserts and views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelane.shared import written

#: Background, cloud, water and developed codes.  Fixed values.
SKIP_CODES = (0, 111, 121, 122, 123, 124, 131)
ACRES_PER_PIXEL = 0.222394
#: Rows and columns of a tile.
TILE = 16


def pixels_to_acres(n: Column) -> Column:
    """Acres of 30 m pixels, to four decimals."""
    return F.round(n * F.lit(ACRES_PER_PIXEL), 4)


def keep_crop_counts(counts: DataFrame, skip: Sequence[int] = SKIP_CODES, min_pixels: int = 10) -> DataFrame:
    return counts.filter(~F.col("code").isin(*skip) & (F.col("pixel_count") >= min_pixels))


def region_spans(regions: DataFrame, rows_from: int = 0) -> DataFrame:
    """(region_id, row_no, x0, x1): stretches of each raster row whose pixel centres lie in the region, by even-odd crossings.

    regions: (region_id, rings array<array<struct<x, y>>>) in pixel units; pixel (col, row) has its centre at (col + 0.5, row + 0.5).  Holes and
    several parts are just more rings.
    """
    ring = regions.select("region_id", F.explode("rings").alias("ring"))
    turned = F.concat(F.slice("ring", F.lit(2), F.size("ring") - 1), F.slice("ring", 1, 1))
    edge = ring.select("region_id", F.explode(F.arrays_zip(F.col("ring").alias("a"), turned.alias("b"))).alias("e")).select("region_id", *[F.col(f"e.{p}.{c}").cast("double").alias(f"{p}{c}") for p in "ab" for c in "xy"])
    edge = edge.filter("ay <> by")
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    # rows whose centre y satisfies low <= y < high
    first, last = F.ceil(low - 0.5).cast("int"), (F.ceil(high - 0.5) - 1).cast("int")
    crossing = edge.filter(F.greatest(first, F.lit(rows_from)) <= last).select("region_id", F.explode(F.sequence(F.greatest(first, F.lit(rows_from)), last)).alias("row_no"), "ax", "ay", "bx", "by")
    x = F.col("ax") + (F.col("row_no") + 0.5 - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    line = crossing.groupBy("region_id", "row_no").agg(F.array_sort(F.collect_list(x)).alias("xs"))  # bounded by a region's edges
    pair = F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.get("xs", 2 * i).alias("x0"), F.get("xs", 2 * i + 1).alias("x1")))
    return line.filter("size(xs) >= 2").select("region_id", "row_no", F.explode(pair).alias("s")).select("region_id", "row_no", "s.x0", "s.x1")


def zonal_counts(pixels: DataFrame, regions: DataFrame, nodata: int | None = None, skip: Sequence[int] = SKIP_CODES, min_pixels: int = 10) -> DataFrame:
    """(region_id, code, pixel_count, acres) of pixels (col_no, row_no, code) whose centre lies in a region; with a column year, by year too.

    Pixels are not shuffled where the spans are few enough for Spark to broadcast them; else pixels of one (row, column block) are joined with the spans that touch the block, so a join key is never a whole row.
    """
    width = 256
    spans = region_spans(regions)
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("x0") / width), F.floor(F.col("x1") / width))))
    dots = pixels if nodata is None else pixels.filter(F.col("code") != nodata)
    years = ["year"] if "year" in pixels.columns else []
    dots = dots.select("row_no", "col_no", "code", *years, F.floor(F.col("col_no") / width).alias("block"))
    inside = dots.join(spans, ["row_no", "block"]).filter((F.col("col_no") + 0.5 >= F.col("x0")) & (F.col("col_no") + 0.5 < F.col("x1")))
    counts = inside.groupBy("region_id", *years, "code").agg(F.count("*").alias("pixel_count"))
    return keep_crop_counts(counts, skip, min_pixels).withColumn("acres", pixels_to_acres(F.col("pixel_count")))


def tile_histograms(pixels: DataFrame, tile: int = TILE, nodata: int | None = None) -> DataFrame:
    """(tile_row, tile_col, code, n) of square tiles of a raster, with a column year by year too: a table to be written once and used for any regions."""
    dots = pixels if nodata is None else pixels.filter(F.col("code") != nodata)
    years = ["year"] if "year" in pixels.columns else []
    return dots.groupBy(F.floor(F.col("row_no") / tile).alias("tile_row"), F.floor(F.col("col_no") / tile).alias("tile_col"), *years, "code").agg(F.count("*").alias("n"))


def tile_spans(regions: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """The tiles that lie wholly in a region (region_id, tile_row, tile_col), and the spans in the others (region_id, row_no, tile_col, from_col, to_col, end
    exclusive), whose number grows with the outline."""
    pieces = region_spans(regions).withColumns({"c0": F.ceil(F.col("x0") - 0.5), "c1": F.ceil(F.col("x1") - 0.5), "tile_row": F.floor(F.col("row_no") / tile)}).filter("c0 < c1")
    pieces = pieces.withColumn("tile_col", F.explode(F.sequence(F.floor(F.col("c0") / tile), F.floor((F.col("c1") - 1) / tile))))
    pieces = pieces.withColumns({"from_col": F.greatest("c0", F.col("tile_col") * tile), "to_col": F.least("c1", (F.col("tile_col") + 1) * tile)})
    pieces = written(pieces.select("region_id", "row_no", "tile_row", "tile_col", "from_col", "to_col"), "spans")
    whole = pieces.groupBy("region_id", "tile_row", "tile_col").agg(F.sum(F.col("to_col") - F.col("from_col")).alias("n")).filter(F.col("n") == tile * tile).drop("n")
    return whole, pieces.join(whole, ["region_id", "tile_row", "tile_col"], "left_anti").drop("tile_row")


def tiled_counts(pixels: DataFrame, histograms: DataFrame, regions: DataFrame, tile: int = TILE, nodata: int | None = None, skip: Sequence[int] = SKIP_CODES, min_pixels: int = 10) -> DataFrame:
    """zonal_counts() by tile_histograms() of the same pixels: tiles wholly in a region give their histogram, and only tiles on an outline are
    opened, by the row and column of tiles, so that pixels of the others are not joined with anything."""
    years = ["year"] if "year" in pixels.columns else []
    whole, spans = tile_spans(regions, tile)
    within = histograms.join(whole, ["tile_row", "tile_col"]).select("region_id", *years, "code", "n")
    dots = pixels if nodata is None else pixels.filter(F.col("code") != nodata)
    dots = dots.select("row_no", "col_no", "code", *years, F.floor(F.col("col_no") / tile).alias("tile_col"))
    outline = dots.join(spans, ["row_no", "tile_col"]).filter((F.col("col_no") >= F.col("from_col")) & (F.col("col_no") < F.col("to_col"))).select("region_id", *years, "code", F.lit(1).cast("long").alias("n"))
    counts = within.unionAll(outline).groupBy("region_id", *years, "code").agg(F.sum("n").alias("pixel_count"))
    return keep_crop_counts(counts, skip, min_pixels).withColumn("acres", pixels_to_acres(F.col("pixel_count")))


def raster_profile(pixels: DataFrame, nodata: int | None = None, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """One row of totals, least, greatest, mean and median code; and the most frequent codes with their share in percent."""
    is_none = F.lit(False) if nodata is None else F.col("code") == nodata
    counts = pixels.groupBy("code").agg(F.count("*").alias("n"))
    valid = counts.filter(~is_none)
    # the median from counts by code: no task sorts all pixels
    running = valid.withColumns({"upto": F.sum("n").over(Window.orderBy("code")), "all": F.sum("n").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    low = F.min(F.when(F.col("upto") >= F.floor((F.col("all") + 1) / 2), F.col("code")))
    high = F.min(F.when(F.col("upto") >= F.floor(F.col("all") / 2) + 1, F.col("code")))
    middle = running.agg(((low + high) / 2).cast("double").alias("median_code"))
    total = counts.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(~is_none, F.col("n"))), F.lit(0)).alias("valid"), F.min(F.when(~is_none, F.col("code"))).alias("min_code"), F.max(F.when(~is_none, F.col("code"))).alias("max_code"), (F.sum(F.when(~is_none, F.col("n") * F.col("code"))) / F.sum(F.when(~is_none, F.col("n")))).alias("mean_code"))
    summary = total.join(F.broadcast(middle)).withColumn("nodata", F.col("total") - F.col("valid"))
    share = F.round(F.col("n") * 100.0 / F.col("all"), 6)
    ranked = running.select("code", "n", share.alias("percent")).orderBy(F.desc("n"), "code").limit(top)
    return summary, ranked


def star(acres: DataFrame, region: DataFrame, crop: DataFrame) -> DataFrame:
    """Facts with names of region and crop."""
    regions = region.select("region_id", F.col("name").alias("region_name"), "region_type")
    crops = crop.select("crop_type_id", "cdl_code", F.col("name").alias("crop_name"), "category", "is_row_crop")
    return acres.join(regions, "region_id").join(crops, "crop_type_id")


def crop_summary(acres: DataFrame, region: DataFrame, crop: DataFrame) -> DataFrame:
    return star(acres, region, crop).select("region_name", "region_type", "crop_name", "category", "year", "acres", "pixel_count").orderBy("region_name", F.desc("year"), F.desc_nulls_first("acres"))


def crop_totals_by_region(acres: DataFrame, region: DataFrame, crop: DataFrame) -> DataFrame:
    return star(acres, region, crop).groupBy("region_name", "crop_name").agg(F.sum("acres").alias("total_acres"), F.count_distinct("year").alias("n_years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def crop_totals_by_year(acres: DataFrame, crop: DataFrame) -> DataFrame:
    crops = crop.select("crop_type_id", F.col("name").alias("crop_name"))
    return acres.join(crops, "crop_type_id").groupBy("year", "crop_name").agg(F.sum("acres").alias("total_acres"), F.count_distinct("region_id").alias("n_regions"))


def row_crops_by_region_year(acres: DataFrame, region: DataFrame, crop: DataFrame) -> DataFrame:
    return star(acres, region, crop).filter("is_row_crop").select("region_name", "crop_name", "year", "acres")


def top_crops(acres: DataFrame, region: DataFrame, crop: DataFrame) -> DataFrame:
    """Rank within a region over all years: latest year first, then acres; ties by crop."""
    w = Window.partitionBy("region_id").orderBy(F.desc("year"), F.desc_nulls_first("acres"), "crop_type_id")
    return star(acres, region, crop).withColumn("crop_rank", F.row_number().over(w)).select("region_name", "crop_name", "year", "acres", "crop_rank")


def crop_trends(acres: DataFrame, region: DataFrame, crop: DataFrame) -> DataFrame:
    """Acres of the year before, change, and change in percent where there were any."""
    before = F.lag("acres").over(Window.partitionBy("region_id", "crop_type_id").orderBy("year"))
    rows = star(acres, region, crop).withColumn("previous", before)
    percent = F.when(F.col("previous") > 0, F.round((F.col("acres") - F.col("previous")).cast("double") / F.col("previous").cast("double") * 100, 6))
    return rows.select("region_name", "crop_name", "year", "acres", "previous", (F.col("acres") - F.col("previous")).alias("change"), percent.alias("percent"))

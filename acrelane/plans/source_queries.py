"""Queries on readers and writers: derived rows are written in the shared folder and read by the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrelane.operators import routing
from acrelane.plans.registry import query
from acrelane.shared import shared_path, with_ordinal
from acrelane.sources import readers, sinks


@query("src_geojson", "SELECT CAST(id AS VARCHAR) AS id, owner, 'Polygon' AS geometry_type, round(lon - 0.25, 6) AS west, round(lat + 0.25, 6) AS north FROM {parcels} p WHERE lon IS NOT NULL")
def src_geojson(t):
    def at(dx, dy):
        return F.array(F.col("lon") + dx, F.col("lat") + dy)

    ring = F.array(at(-0.25, -0.25), at(0.25, -0.25), at(0.25, 0.25), at(-0.25, 0.25), at(-0.25, -0.25))
    geometry = F.when(F.col("lon").isNotNull(), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("id").cast("string").alias("id"), "owner").alias("properties"), geometry.alias("geometry"))
    rows = t("parcels").select(F.floor(F.col("id") / 500).alias("part"), feature.alias("f"))
    path = shared_path(t.spark, "geojson")
    rows.groupBy("part").agg(F.collect_list("f").alias("features")).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"), "part").write.partitionBy("part").text(path)  # a document of 500 features a file
    got = readers.read_geojson(t.spark, path, "id string, owner string")
    ring0 = F.get("rings", F.lit(0))
    return got.select("id", "owner", "geometry_type", F.round(F.array_min(F.transform(ring0, lambda p: p["x"])), 6).alias("west"), F.round(F.array_max(F.transform(ring0, lambda p: p["y"])), 6).alias("north"))


def _csv(t, df, **options):
    path = shared_path(t.spark, "csv")
    df.write.option("header", True).options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options).csv(path)
    return path


@query("src_staged_csv", "SELECT CAST(id AS VARCHAR) AS id, owner || ', \"x\"' AS owner, usedesc, nullif(trim(county), '') AS county FROM {parcels} p")
def src_staged_csv(t):
    rows = t("parcels").select(F.col("id").cast("string").alias("id"), F.concat("owner", F.lit(', "x"')).alias("owner"), "usedesc", F.coalesce(F.trim("county"), F.lit("")).alias("county"))
    return readers.read_staged_csv(t.spark, _csv(t, rows, quote='"', escape='"', emptyValue=""), ["id", "owner", "usedesc", "county"])


@query("src_renamed_csv", "SELECT CAST(feature_id AS VARCHAR) AS feature_id, label AS section_label FROM {sections} s")
def src_renamed_csv(t):
    rows = t("sections").select(F.col("feature_id").alias("﻿FID"), F.col("label").alias("FRSTDIVLAB"), F.lit("unused").alias("OTHER"))
    return readers.read_renamed_csv(t.spark, _csv(t, rows), {"FID": "feature_id", "FRSTDIVLAB": "section_label"}, ["FID", "FRSTDIVLAB"])


@query("src_variant_csv", "SELECT CAST(seq AS VARCHAR) AS seq, nullif(trim(zip), '') AS postal_code, coalesce(nullif(trim(website), ''), nullif(trim(detail_url), '')) AS link, CAST(NULL AS VARCHAR) AS fax FROM {directory} d")
def src_variant_csv(t):
    rows = t("directory").select(F.col("seq").alias(" Seq "), F.col("zip").alias("ZipCode"), F.col("website").alias("Website"), F.col("detail_url").alias("Link"))
    df = t.spark.read.option("header", True).csv(_csv(t, rows))
    return readers.coalesce_variants(df, {"seq": ["seq"], "postal_code": ["zip", "postal_code", "zipcode"], "link": ["website", "link"], "fax": ["fax"]})


@query("src_jdbc", "SELECT c_custkey, c_name FROM customer WHERE c_custkey < 500 AND c_mktsegment = 'BUILDING'")
def src_jdbc(t):
    return readers.read_table(t.spark, f"{t.sf_dir}/customer.parquet", "c_custkey < 500 and c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")


@query("src_road_graph", "SELECT e.src, e.dst, e.length_m, e.highway FROM {edges} e JOIN {nodes} a ON e.src = a.node JOIN {nodes} b ON e.dst = b.node WHERE (a.lon BETWEEN -98.9 AND -98.75 AND a.lat BETWEEN 38.0 AND 38.3) OR (b.lon BETWEEN -98.9 AND -98.75 AND b.lat BETWEEN 38.0 AND 38.3)")
def src_road_graph(t):
    path = shared_path(t.spark, "graph")
    t("nodes").write.parquet(f"{path}/nodes")
    t("edges").write.parquet(f"{path}/edges")
    return readers.read_road_graph(t.spark, path, (-98.9, 38.0, -98.75, 38.3))[1].select("src", "dst", "length_m", "highway")


def mapped_ways(t):
    """Roads of the grid as ways of two nodes; motorways run one way."""
    speed = F.col("p_size") % 5
    tags = F.when(speed == 0, "residential").when(speed == 1, "unclassified").when(speed == 2, "primary").when(speed == 3, "track").otherwise("motorway")
    return t("edges_one").filter("src % 7 <> 3 or dst - src = 1").select((F.col("src") * 2 + F.expr("int(dst - src = 1)")).alias("way"), F.array("src", "dst").alias("refs"), tags.alias("highway"), F.when(speed == 4, "yes").alias("oneway"))


@query("src_road_map")
def src_road_map(t):
    """The grid written as a map in XML and read again: largest component, chains as one edge."""
    path = shared_path(t.spark, "map")
    t("nodes").select(F.col("node").alias("_id"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).write.format("xml").option("rootTag", "osm").option("rowTag", "node").save(f"{path}/nodes.osm")
    pair = lambda k, v: F.struct(F.lit(k).alias("_k"), v.alias("_v"))
    tags = F.array_compact(F.array(pair("highway", F.col("highway")), F.when(F.col("oneway").isNotNull(), pair("oneway", F.col("oneway")))))
    ways = mapped_ways(t).select(F.col("way").alias("_id"), F.transform("refs", lambda r: F.struct(r.alias("_ref"))).alias("nd"), tags.alias("tag"))
    ways.write.format("xml").option("rootTag", "osm").option("rowTag", "way").save(f"{path}/ways.osm")
    edges = readers.read_road_graph(t.spark, f"{path}/*.osm")[1]
    return edges.select("src", "dst", F.round("length_m", 3).alias("length_m"), F.array_join("highway", ",").alias("highway"))


@query("src_speed_table", "SELECT highway, count(*) AS n_edges, max(CASE highway WHEN 'primary' THEN 60e0 WHEN 'motorway' THEN 70e0 WHEN 'unclassified' THEN 40e0 END) AS mph FROM {edges} e GROUP BY highway")
def src_speed_table(t):
    table = routing.speed_table(t.spark, {"primary": 60, "motorway": "70", "unclassified": 40.0, 5: 10} | {"motorway": 70})
    edges = t("edges").join(F.broadcast(table), F.col("highway") == F.col("tag"), "left")  # a speed table is a few rows
    return edges.groupBy("highway").agg(F.count("*").alias("n_edges"), F.max("mph").alias("mph"))


@query("src_lookup_json", "SELECT 'companies' AS section, CAST(company_id AS VARCHAR) AS id, name AS label FROM {company} c WHERE name <> '' UNION ALL SELECT 'facilityTypes', CAST(facility_type_id AS VARCHAR), name FROM {facility_type} t WHERE name <> '' UNION ALL SELECT 'companyWebsites', CAST(company_id AS VARCHAR), coalesce(website, '') FROM {company} c WHERE name <> ''")
def src_lookup_json(t):
    path = shared_path(t.spark, "lookups")
    sinks.write_lookups(t("company"), t("facility_type"), path)
    return readers.read_lookups(t.spark, path, by_line=True)


def _lines(section, ids, values, table):
    return f"SELECT {section} AS section, {ids} AS key, CASE WHEN row_number() OVER (ORDER BY {ids}) > 1 THEN ',' ELSE '' END || '\"' || {ids} || '\":\"' || {values} || '\"' AS line FROM {{{table}}} x WHERE name <> ''"


_LINES_SQL = " UNION ALL ".join([_lines(0, "company_id", "name", "company"), _lines(1, "facility_type_id", "name", "facility_type"), _lines(2, "company_id", "coalesce(website, '')", "company"),
                                 "SELECT * FROM (VALUES (0, NULL, '{{\"companies\":{{'), (1, NULL, '}},\"facilityTypes\":{{'), (2, NULL, '}},\"companyWebsites\":{{'), (3, NULL, '}}}}')) v"])


@query("sink_lookup_json", f"SELECT row_number() OVER (ORDER BY section, key NULLS FIRST) AS line_no, line FROM ({_LINES_SQL}) x")
def sink_lookup_json(t):
    """The document's lines, numbered as the written parts hold them."""
    path = shared_path(t.spark, "lookups")
    sinks.write_lookups(t("company"), t("facility_type"), path)
    place = F.concat_ws("-", "_file", F.lpad(F.col("_block").cast("string"), 20, "0"), F.lpad(F.col("_id").cast("string"), 20, "0"))
    lines = readers.in_file_order(t.spark, path).select(place.alias("place"), F.col("value").alias("line"))
    return with_ordinal(lines, "place", "line_no").select("line_no", "line")


@query("sink_csv", "SELECT CAST(facility_id AS VARCHAR) AS facility_id, name FROM {facility} f UNION ALL SELECT CAST(facility_id AS VARCHAR), name FROM {facility} f")
def sink_csv(t):
    path = shared_path(t.spark, "out")
    rows = t("facility").select("facility_id", "name")
    sinks.write_csv(rows, path)
    sinks.write_csv(rows, path, append=True)
    return t.spark.read.schema("facility_id string, name string").option("header", True).csv(path)


_POINTS = "SELECT '{{\"type\":\"Feature\",\"geometry\":{{\"type\":\"Point\",\"coordinates\":[' || CAST(facility_id AS VARCHAR) || '.5,' || CAST(company_id AS VARCHAR) || '.25]}},\"properties\":{{\"facility_id\":' || CAST(facility_id AS VARCHAR) || ',\"city\":' || coalesce('\"' || city || '\"', 'null') || '}}}}' AS feature FROM {facility} f"
_LINES = "SELECT '{{\"type\":\"Feature\",\"geometry\":{{\"type\":\"LineString\",\"coordinates\":[[' || CAST(facility_id AS VARCHAR) || '.5,' || CAST(company_id AS VARCHAR) || '.25],[0.0,1.0]]}},\"properties\":{{\"facility_id\":' || CAST(facility_id AS VARCHAR) || '}}}}' FROM {facility} f"


@query("sink_geo_features", f"{_POINTS} UNION ALL {_LINES}")
def sink_geo_features(t):
    rows = t("facility").select("facility_id", "city", (F.col("facility_id") + 0.5).cast("double").alias("lon"), (F.col("company_id") + 0.25).cast("double").alias("lat"))
    lines = rows.drop("city").withColumns({"x2": F.lit(0.0), "y2": F.lit(1.0)})
    path = shared_path(t.spark, "layers")
    sinks.write_features({"points": sinks.to_features(rows), "lines": sinks.to_features(lines, line_to=("x2", "y2"))}, path)
    return t.spark.read.text(f"{path}/points").unionAll(t.spark.read.text(f"{path}/lines")).withColumnRenamed("value", "feature")


@query("sink_table", "SELECT id, CAST(id + 0.5 AS DOUBLE) AS x, CASE WHEN id % 2 = 0 THEN 2.25e0 ELSE lat END AS y FROM {parcels} p")
def sink_table(t):
    wkt = F.when(F.col("id") % 2 == 0, F.concat(F.lit("POINT ("), (F.col("id") + 0.5).cast("string"), F.lit(" 2.25)")))
    rows = t("parcels").select("id", (F.col("id") + 0.5).cast("double").alias("lon"), "lat", wkt.alias("wkt"))
    name = "sink_" + shared_path(t.spark, "t").rpartition("-")[2]
    out = sinks.with_wkt_point(rows, "wkt").select("id", "x", "y")
    sinks.write_table(out.filter("id % 3 = 0"), name)
    sinks.write_table(out.filter("id % 3 <> 0"), name, mode="append")
    return t.spark.table(name)


@query("sink_table_files", "SELECT 'json' AS fmt, region_id, CAST(sum(acres) AS DOUBLE) AS acres FROM {crop_acres} a GROUP BY region_id UNION ALL SELECT 'csv', region_id, CAST(sum(acres) AS DOUBLE) FROM {crop_acres} a GROUP BY region_id UNION ALL SELECT 'parquet', region_id, CAST(sum(acres) AS DOUBLE) FROM {crop_acres} a GROUP BY region_id")
def sink_table_files(t):
    rows = t("crop_acres").groupBy("region_id").agg(F.sum("acres").cast("double").alias("acres"))
    out = None
    for fmt in ("json", "csv", "parquet"):
        path = shared_path(t.spark, fmt)
        sinks.write_table_files(rows, path, fmt)
        reader = t.spark.read.schema("region_id bigint, acres double")
        part = (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path).select(F.lit(fmt).alias("fmt"), "region_id", "acres")
        out = part if out is None else out.unionAll(part)
    return out

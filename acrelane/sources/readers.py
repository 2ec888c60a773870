"""Readers: geographic and staged files, tables, road graphs, lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acrelane.functions.text import blank_null
from acrelane.operators.roads import road_graph
from acrelane.shared import dropped, written


def in_file_order(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """(_file, _block, _id, value): pieces of text files between separators.  _block is the first byte of the range that a task reads and _id the order
    in it, so files of any size are cut into ranges and the three columns give back the order of a file."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")


def _earlier(value: Column | str) -> Column:
    """Sum of value over the pieces before one in its range."""
    return F.coalesce(F.sum(value).over(Window.partitionBy("_file", "_block").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _earlier_blocks(value: Column | str) -> Column:
    """Sum of value over the ranges before one in its file."""
    return F.coalesce(F.sum(value).over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _count_of(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def _depth_change(text: Column) -> Column:
    """Brackets that a piece opens less those that it closes, with the brace that ends it; text starts outside of a string."""
    bare = F.regexp_replace(text, r'"[^"]*("|$)', "")
    return (_count_of(bare, "{[") - _count_of(bare, "}]") - F.when(_count_of(text, '"') % 2 == 0, 1).otherwise(0)).cast("bigint")


def feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """(feature): the JSON text of each member of the features of FeatureCollections.

    A document is read in byte ranges, cut at closing braces.  Whether a piece starts inside of a string, and how deep, is a running sum over the
    pieces: within each range for both cases, then over the ranges, of which there is one row each.  A feature ends where the depth is back at that
    of the list; only its own pieces are put together.  A large file is thus many tasks, whatever the order of members or the white space in it.
    """
    pieces = in_file_order(spark, path, "}")
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # escapes hide quotes
    pieces = pieces.withColumns({"_plain": plain, "_quotes": _count_of(plain, '"').cast("bigint")})
    pieces = pieces.withColumn("_inside", _earlier("_quotes") % 2)
    quoted, open_ = _depth_change(F.concat(F.lit('"'), "_plain")), _depth_change(F.col("_plain"))
    pieces = pieces.withColumns({"_if0": F.when(F.col("_inside") == 0, open_).otherwise(quoted), "_if1": F.when(F.col("_inside") == 0, quoted).otherwise(open_)}).drop("_plain")
    for case in ("0", "1"):
        pieces = pieces.withColumn(f"_sum{case}", _earlier(f"_if{case}"))
    pieces = written(pieces, "pieces")

    blocks = pieces.groupBy("_file", "_block").agg(*[F.sum(c).alias(c) for c in ("_quotes", "_if0", "_if1")])
    blocks = blocks.withColumn("_case", _earlier_blocks("_quotes") % 2)
    blocks = blocks.withColumn("_base", _earlier_blocks(F.when(F.col("_case") == 0, F.col("_if0")).otherwise(F.col("_if1"))))
    case = F.col("_case") == 0
    at = F.col("_base") + F.when(case, F.col("_sum0")).otherwise(F.col("_sum1"))
    rows = pieces.join(blocks.select("_file", "_block", "_case", "_base"), ["_file", "_block"]).select("_file", "_block", "_id", "value", at.alias("_at"), (at + F.when(case, F.col("_if0")).otherwise(F.col("_if1"))).alias("_then"))
    head = r'(?s)^.*"features"\s*:\s*\['
    behind = F.when(F.contains("value", F.lit('"features"')), F.regexp_replace("value", head, "")).otherwise(F.col("value"))
    opens = F.contains("value", F.lit('"features"')) & F.col("value").rlike(head) & ((F.col("_at") <= 1) | ((F.col("_at") == 2) & F.col("value").rlike(r"^\s*\]")))
    closes = ((F.col("_at") == 2) | opens) & behind.rlike(r"^\s*\]")
    rows = rows.withColumns({"_event": F.when(closes, "close").when(opens, "open"), "value": F.when(opens, behind).otherwise(F.col("value")), "_end": (F.col("_then") == 2).cast("bigint")})

    ends = rows.groupBy("_file", "_block").agg(F.sum("_end").alias("_ends"), F.max_by("_event", F.when(F.col("_event").isNotNull(), F.col("_id"))).alias("_last"))
    state = F.last("_last", ignorenulls=True).over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("_file", "_block", _earlier_blocks("_ends").alias("_first"), state.alias("_before"))
    state = F.last("_event", ignorenulls=True).over(Window.partitionBy("_file", "_block").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_no": _earlier("_end"), "_state": state}).join(ends, ["_file", "_block"]).filter(F.coalesce("_state", "_before") == "open")
    parts = rows.groupBy("_file", (F.col("_first") + F.col("_no")).alias("_no")).agg(F.array_sort(F.collect_list(F.struct("_block", "_id", "value"))).alias("p"))
    text = F.concat(F.array_join("p.value", "}"), F.lit("}"))
    features = written(parts.select(F.regexp_replace(text, r"^[\s,]+", "").alias("feature")), "features")
    dropped(pieces)
    return features


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of a FeatureCollection: the properties (a schema in DDL), geometry_type, and rings or point; features without geometry are dropped.

    Coordinates are taken as WGS84 where the file names no system.  No feature at all is an error.
    """
    fields = f"properties struct<{properties}>, geometry struct<type string, coordinates string>"
    rows = feature_texts(spark, path).select(F.from_json("feature", fields).alias("f")).filter("f.geometry is not null and f.geometry.type is not null")
    if rows.isEmpty():
        raise ValueError(f"{path} has no feature with a geometry")
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    as_point = F.from_json(F.when(kind == "Point", text), "array<double>")
    as_polygon = F.from_json(F.when(kind == "Polygon", text), "array<array<array<double>>>")
    as_multi = F.from_json(F.when(kind == "MultiPolygon", text), "array<array<array<array<double>>>>")
    rings = F.transform(F.coalesce(as_polygon, F.flatten(as_multi)), lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    return rows.select("f.properties.*", kind.alias("geometry_type"), F.get(as_point, F.lit(0)).alias("lon"), F.get(as_point, F.lit(1)).alias("lat"), rings.alias("rings"))


def read_staged_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All-text columns; quote and escape are ", an empty value is null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("nullValue", "").option("emptyValue", "").csv(path)
    return rows.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in columns])


def read_renamed_csv(spark: SparkSession, path: str, rename: dict[str, str], required: Sequence[str] = ()) -> DataFrame:
    """The columns of rename under their new names, all text; a byte order mark is dropped; a missing required column is an error."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows.select(*[F.col(f"`{a}`").alias(b) for a, b in rename.items() if a in rows.columns])


def coalesce_variants(df: DataFrame, variants: dict[str, Sequence[str]]) -> DataFrame:
    """Columns by the first filled one of several possible names; header names are trimmed and compared in lower case."""
    low = df.toDF(*[c.lstrip("﻿").strip().lower() for c in df.columns])
    out = []
    for name, names in variants.items():
        there = [blank_null(F.col(f"`{c}`")) for c in names if c in low.columns]
        out.append((F.coalesce(*there) if there else F.lit(None).cast("string")).alias(name))
    return low.select(*out)


def read_table(spark: SparkSession, source: str, where: str | None = None, table: str | None = None, partition: tuple[str, int, int, int] | None = None, properties: dict | None = None) -> DataFrame:
    """A table by JDBC URL, or a Parquet path, with a filter that goes to the source.  partition: (column, low, high, parts)."""
    if source.startswith("jdbc:"):
        reader = spark.read.format("jdbc").options(url=source, dbtable=table, **(properties or {}))
        if partition is not None:
            reader = reader.options(partitionColumn=partition[0], lowerBound=partition[1], upperBound=partition[2], numPartitions=partition[3])
        rows = reader.load()
    else:
        rows = spark.read.parquet(source)
    return rows if where is None else rows.filter(where)


def clip_graph(nodes: DataFrame, edges: DataFrame, box: tuple[float, float, float, float] | None) -> tuple[DataFrame, DataFrame]:
    """Edges with an end in the box (west, south, east, north) and the nodes that they touch or that lie inside."""
    if box is None:
        return nodes, edges
    west, south, east, north = box
    inside = nodes.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north)).select("node")
    by = [edges.join(inside, edges[end] == inside["node"], "left_semi") for end in ("src", "dst")]
    kept = by[0].unionAll(by[1]).distinct()
    touched = reduce(DataFrame.unionAll, [kept.select(F.col("src").alias("node")), kept.select(F.col("dst").alias("node")), inside]).distinct()
    return nodes.join(touched, "node", "left_semi"), kept


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of map files in XML: (node, lon, lat) and (way, refs, highway, surface, oneway, junction) of the ways that are roads."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id long, _lon double, _lat double").load(path).toDF("node", "lon", "lat")
    ways = spark.read.format("xml").option("rowTag", "way").schema("_id long, nd array<struct<_ref long>>, tag array<struct<_k string, _v string>>").load(path)

    def tag(name: str):
        return F.get(F.filter("tag", lambda t: t["_k"] == name), F.lit(0))["_v"].alias(name)

    ways = ways.select(F.col("_id").alias("way"), F.col("nd._ref").alias("refs"), *[tag(name) for name in ("highway", "surface", "oneway", "junction")])
    return nodes, ways.filter("highway is not null and refs is not null")


def read_road_graph(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph saved as GraphML (.graphml), of a map in XML (.osm, .xml; its largest component, simplified, with tags as lists), or of
    Parquet folders nodes and edges; an empty graph is an error."""
    if path.endswith((".osm", ".xml")):
        nodes, edges = road_graph(*read_osm(spark, path))
    elif path.endswith(".graphml"):
        def elements(tag: str) -> DataFrame:
            keyed = "data array<struct<_key string, _VALUE string>>"
            ends = "_id string" if tag == "node" else "_source string, _target string"
            return spark.read.format("xml").option("rowTag", tag).schema(f"{ends}, {keyed}").load(path)

        # a saved graph names its values in a table of keys, a handful of rows; without it they go by their own names
        keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, _for string, `_attr.name` string").load(path)
        ids = {(r[1], r[2]): r[0] for r in keys.collect()}

        def value(tag: str, name: str):
            key = ids.get((tag, name), ids.get(("all", name), name))
            return F.get(F.filter("data", lambda d: d["_key"] == key), F.lit(0))["_VALUE"]

        nodes = elements("node").select(F.col("_id").cast("bigint").alias("node"), value("node", "x").cast("double").alias("lon"), value("node", "y").cast("double").alias("lat"))
        edges = elements("edge").select(F.col("_source").cast("bigint").alias("src"), F.col("_target").cast("bigint").alias("dst"), value("edge", "length").cast("double").alias("length_m"), value("edge", "highway").alias("highway"), value("edge", "surface").alias("surface"))
    else:
        nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    nodes, edges = clip_graph(nodes, edges, box)
    if edges.isEmpty():
        raise ValueError(f"{path} has no road there")
    return nodes, edges


def read_lookups(spark: SparkSession, path: str, sections: Sequence[str] = ("companies", "facilityTypes", "companyWebsites"), by_line: bool = False) -> DataFrame:
    """(section, id, label) of a document of maps {section: {id: name}}.

    by_line reads a document with one entry a line, as sinks.write_lookups makes it, in ranges of lines, so that no task takes it whole: an entry belongs
    to the last section named before it.  Without, each file is one JSON text of any layout.
    """
    if not by_line:
        schema = T.StructType([T.StructField(s, T.MapType(T.StringType(), T.StringType())) for s in sections])
        rows = spark.read.option("multiLine", True).schema(schema).json(path)
        return reduce(DataFrame.unionAll, [rows.select(F.lit(s).alias("section"), F.explode(s).alias("id", "label")) for s in sections])
    lines = written(in_file_order(spark, path).withColumn("_section", F.nullif(F.regexp_extract("value", r'^[\s{},]*"([^"\\]*)"\s*:\s*\{\s*$', 1), F.lit(""))), "lines")
    place = F.struct("_file", "_block", "_id")
    heads = lines.filter("_section is not null").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col("_section").alias("section")))).alias("heads"))  # a handful: one a section and document
    entry = F.regexp_replace("value", r"^[\s,]+|[\s,]+$", "")
    rows = lines.filter(F.col("_section").isNull() & entry.startswith('"')).crossJoin(F.broadcast(heads))
    section = F.element_at(F.filter("heads", lambda h: h["place"] < place), -1)["section"]
    rows = rows.select(section.alias("section"), F.explode(F.from_json(F.concat(F.lit("{"), entry, F.lit("}")), "map<string,string>")).alias("id", "label"))
    return rows.filter(F.col("section").isin(*sections))

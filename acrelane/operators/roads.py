"""A road graph from mapped ways: directed edges, the largest component, and chains of edges taken together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelane.shared import dropped, written

#: Values of the tag oneway that make a way one-way, and those that turn it around.  Fixed values.
ONE_WAY = ("yes", "true", "1", "-1", "reverse", "T", "F")
BACKWARD = ("-1", "reverse", "T")
#: The sphere of great-circle lengths, in metres.
EARTH_RADIUS = 6371009.0


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.asin(F.sqrt(F.least(F.lit(1.0), half))) * (2 * EARTH_RADIUS)


def way_edges(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(src, dst, length_m, highway, surface, way, step, back) of ways (way, refs, highway, surface, oneway, junction) between nodes (node, lon, lat).

    A way gives an edge each way between each two successive nodes, a one-way street and a roundabout one only, against the order of the nodes if the
    tag says so.  A node repeated in succession is one; edges whose ends are not in the file are left out.
    """
    oneway = F.col("oneway").isin(*ONE_WAY) | (F.col("junction") == "roundabout")
    kept = F.filter("refs", lambda x, i: (i == 0) | (x != F.get("refs", i - 1)))
    lines = ways.select("way", "highway", "surface", F.coalesce(oneway, F.lit(False)).alias("single"), F.coalesce(F.col("oneway").isin(*BACKWARD), F.lit(False)).alias("turned"), kept.alias("refs")).filter("size(refs) > 1")
    steps = lines.select("way", "highway", "surface", "single", "turned", F.posexplode(F.arrays_zip(F.slice("refs", F.lit(1), F.size("refs") - 1).alias("a"), F.slice("refs", F.lit(2), F.size("refs") - 1).alias("b"))).alias("step", "e"))
    steps = steps.select("*", "e.a", "e.b").drop("e")
    ahead = steps.filter("not (single and turned)").withColumn("back", F.lit(False))
    behind = steps.filter("not single or turned").withColumns({"a": F.col("b"), "b": F.col("a"), "back": F.lit(True)})
    ends = [nodes.select(F.col("node").alias(f"n{x}"), F.col("lon").alias(f"x{x}"), F.col("lat").alias(f"y{x}")) for x in "ab"]
    both = ahead.unionByName(behind).join(ends[0], F.col("a") == F.col("na")).join(ends[1], F.col("b") == F.col("nb"))
    return both.select(F.col("a").alias("src"), F.col("b").alias("dst"), great_circle(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb")).alias("length_m"), "highway", "surface", "way", "step", "back")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each weakly connected component of edges (src, dst).

    In each round a node goes to the least of itself and its neighbours, in an order by chance, and on to where that one goes; the nodes that are left
    and the links between them make up the next round, of about a quarter of the size.  All rounds together cost little more than the first.
    """
    links = written(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "links")
    went: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        chance = lambda c: F.struct(F.xxhash64(F.lit(len(went)), c).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        first = both.groupBy("a").agg(F.min(chance("b")).alias("m")).select(F.col("a").alias("node"), F.least(chance("a"), "m")["n"].alias("parent"))
        first = written(first, "parents")
        parents = written(first.join(first.toDF("parent", "far"), "parent").select("node", F.col("far").alias("parent")), "parents")
        dropped(first)
        pa, pb = parents.toDF("a", "pa"), parents.toDF("b", "pb")
        following = written(links.join(pa, "a").join(pb, "b").filter("pa <> pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(), "links")
        dropped(links)
        links = following
        went.append(parents)
    nodes = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).distinct()
    if not went:
        return nodes.withColumn("component", F.col("node"))
    ends = went[-1].toDF("node", "end")
    for parents in reversed(went[:-1]):
        ends = parents.join(ends.toDF("parent", "end"), "parent", "left").select("node", F.coalesce("end", "parent").alias("end"))
    ends = written(ends, "ends")
    least = ends.groupBy("end").agg(F.min("node").alias("component"))
    of = ends.join(least, "end").select("node", "component")
    return nodes.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with most nodes (ties: the one with the least node)."""
    of = written(components(edges), "components")
    first = of.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    # the component is one row
    inside = of.join(F.broadcast(first), "component").select("node")
    return edges.join(inside, edges["src"] == inside["node"], "left_semi")


def junctions(edges: DataFrame) -> DataFrame:
    """The nodes at which roads begin, end or meet: those with a loop, with edges in or out only, or without exactly two neighbours and two or four edges."""
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", "src", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node", "other").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))  # equal neighbours first, so that a hub is counted in two steps
    of = seen.groupBy("node").agg(F.count("*").alias("n"), F.sum("o").alias("o"), F.sum("i").alias("i"), F.max(F.expr("int(node = other)")).alias("loop"))
    return of.filter("loop = 1 or o = 0 or i = 0 or not (n = 2 and o + i in (2, 4))").select("node")


def simplify(edges: DataFrame) -> DataFrame:
    """(src, dst, length_m, highway, surface) with chains of edges between junctions as one edge: lengths summed, tags listed in order, each once.

    edges: (src, dst, length_m, highway, surface, way, step, back).  Each edge points to the one after it, and the pointers are doubled, so a chain of n
    edges takes the logarithm of n rounds.  Rings without a junction stay as they are.  A tag that no edge of a chain has is null.
    """
    stops = written(junctions(edges), "junctions")
    key = F.xxhash64("src", "dst", "way", "step", "back")
    listed = [F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c)).alias(c) for c in ("highway", "surface")]
    parts = written(edges.withColumn("id", key).select("id", "src", "dst", "length_m", *listed), "parts")
    heads = parts.join(stops, parts["src"] == stops["node"], "left_semi").select("id")
    through = parts.join(stops, parts["dst"] == stops["node"], "left_anti").select("id", "src", "dst")
    # a node within a road has two neighbours, so the next edge is the one that does not lead back
    after = through.alias("e").join(parts.alias("f"), (F.col("e.dst") == F.col("f.src")) & (F.col("f.dst") != F.col("e.src"))).groupBy("e.id").agg(F.min("f.id").alias("next"))
    after = written(after, "after")
    # most edges run between junctions: only those that go on, or that others lead to, take part in the rounds
    alone = parts.join(heads, "id", "left_semi").join(after, "id", "left_anti").select("src", "dst", "length_m", "highway", "surface")
    moving = after.select("id").unionAll(after.select("next")).distinct()
    chain = written(parts.join(moving, "id", "left_semi").join(after, "id", "left").select("id", "src", "dst", "length_m", "highway", "surface", "next"), "chains")
    heads = written(heads.join(after, "id", "left_semi"), "heads")
    # a head's pointer comes to an end; what still points after so many rounds is a ring
    for _ in range(max(1, chain.count()).bit_length() + 1):
        if chain.join(heads, "id", "left_semi").filter("next is not null").isEmpty():
            break
        b = chain.select(F.col("id").alias("next"), F.col("dst").alias("dst2"), F.col("length_m").alias("l2"), F.col("highway").alias("h2"), F.col("surface").alias("s2"), F.col("next").alias("next2"))
        joined = chain.join(b, "next", "left")
        more = F.col("l2").isNotNull()
        both = {c: F.when(more, F.array_distinct(F.concat(c, d))).otherwise(F.col(c)) for c, d in (("highway", "h2"), ("surface", "s2"))}
        doubled = joined.select("id", "src", F.coalesce("dst2", "dst").alias("dst"), F.when(more, F.col("length_m") + F.col("l2")).otherwise(F.col("length_m")).alias("length_m"), *[v.alias(c) for c, v in both.items()], F.col("next2").alias("next"))
        following = written(doubled, "chains")
        dropped(chain)
        chain = following
    tags = [F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("highway", "surface")]
    roads = chain.join(heads, "id", "left_semi").select("src", "dst", "length_m", "highway", "surface").unionAll(alone).select("src", "dst", "length_m", *tags)
    if chain.filter("next is not null").isEmpty():  # an edge of a ring always points on
        return roads
    # edges that no head leads to
    ring = parts.join(_on_rings(parts, stops), "id", "left_semi").select("src", "dst", "length_m", *tags)
    return roads.unionAll(ring)


def _on_rings(parts: DataFrame, stops: DataFrame) -> DataFrame:
    """Ids of edges in components that hold no junction."""
    begun, ended = (F.col(c).isNotNull() for c in ("from", "to"))
    sides = parts.select("id", "src", "dst").join(stops.select(F.col("node").alias("from")), F.col("src") == F.col("from"), "left").join(stops.select(F.col("node").alias("to")), F.col("dst") == F.col("to"), "left")
    within = written(sides.filter(~begun & ~ended).select("id", "src", "dst"), "within")
    beside = sides.filter(begun & ~ended).select(F.col("dst").alias("node")).unionAll(sides.filter(~begun & ended).select("src")).distinct()
    of = written(components(within), "components")
    held = of.join(beside, "node", "left_semi").select("component").distinct()
    free = of.join(held, "component", "left_anti").select("node")
    return within.join(free, within["src"] == free["node"], "left_semi").select("id")


def road_graph(nodes: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of mapped nodes and ways: the largest component, simplified; the nodes are the ends of its edges."""
    nodes = written(nodes, "nodes")  # the map is read once
    edges = written(largest_component(written(way_edges(nodes, ways), "steps")), "steps")
    roads = written(simplify(edges), "roads")
    ends = roads.select(F.col("src").alias("node")).unionAll(roads.select("dst")).distinct()
    return nodes.join(ends, "node", "left_semi"), roads

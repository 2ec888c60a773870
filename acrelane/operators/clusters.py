"""Clusters along an order: a member begins a new one where it is too far from the member that began the last.

Groups of any size: each member's successor (the first later member that is too far from it) is found by going down a tree of boxes over the
group's order, and the beginnings are the chain of successors from the first member, reached by doubled pointers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelane.functions.geo import MERCATOR_R
from acrelane.shared import dropped, in_ranges, written

#: Boxes to a node of the tree; rows to a block of which clusters are numbered at once; steps along the tree between two tables.
FAN, BLOCK, STEPS = 16, 1024, 4


def _northing(lat: Column) -> Column:
    return F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * MERCATOR_R


def ranked(groups: DataFrame) -> DataFrame:
    """(group_key, rank from 0 by facility_id, facility_id, x in degrees, y in metres), where x and y are null if the point is not known.

    Ranges of rows are numbered, so a group may spread over many tasks.
    """
    rows = groups.filter("group_key is not null").select("group_key", "facility_id", "lon", "lat")
    rows = in_ranges(rows, "group_key", "facility_id", "lon", "lat")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = rows.join(F.broadcast(before), "_part").withColumn("_at", F.col("_before") + F.col("_pos"))
    first = placed.groupBy("group_key").agg(F.min("_at").alias("_first"))
    known = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    return placed.join(first, "group_key").select("group_key", (F.col("_at") - F.col("_first")).alias("rank"), "facility_id", F.when(known, F.col("lon")).alias("x"), F.when(known, _northing(F.col("lat"))).alias("y"))


def _up(c: str, by: int) -> Column:
    return F.floor(F.col(c) / by)


def box_tree(members: DataFrame) -> tuple[DataFrame, int]:
    """(group_key, level, parent, kids) and the top level: FAN boxes a row, those of members at level 0, those of nodes of the level below above it."""
    boxes = members.select("group_key", F.col("rank").alias("idx"), F.col("x").alias("x0"), F.col("x").alias("x1"), F.col("y").alias("y0"), F.col("y").alias("y1"))
    last = members.agg(F.max("rank")).first()[0] or 0  # one number
    levels, level = [], 0
    while True:
        node = written(boxes.groupBy("group_key", _up("idx", FAN).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("idx", "x0", "x1", "y0", "y1"))).alias("kids")), "nodes")  # FAN at most
        levels.append(node.select("group_key", F.lit(level).alias("level"), "parent", "kids"))
        last //= FAN
        if last == 0:
            break
        boxes = node.select("group_key", F.col("parent").alias("idx"), *[part(f"kids.{c}").alias(c) for c, part in (("x0", F.array_min), ("x1", F.array_max), ("y0", F.array_min), ("y1", F.array_max))])
        level += 1
    tree = levels[0]
    for more in levels[1:]:
        tree = tree.unionAll(more)
    return tree, level


def successors(members: DataFrame, max_metres: float) -> DataFrame:
    """(group_key, rank, next): the first later member over max_metres away; members without one, or whose own point is not known, are left out."""
    tree, top = box_tree(members)

    def beyond(kid: Column) -> Column:
        wide = F.greatest(F.abs(F.col("x") - kid["x0"]), F.abs(F.col("x") - kid["x1"]))
        high = F.greatest(F.abs(F.col("y") - kid["y0"]), F.abs(F.col("y") - kid["y1"]))
        return F.sqrt(F.pow(F.radians(wide) * MERCATOR_R, 2) + F.pow(high, 2)) > max_metres

    def step(states: DataFrame) -> DataFrame:
        keyed = states.withColumn("parent", _up("at", FAN))
        hit = F.get(F.filter("kids", lambda k: (k["idx"] >= F.col("at")) & beyond(k)), F.lit(0))["idx"]
        looked = keyed.join(tree, ["group_key", "level", "parent"], "left").withColumn("hit", F.when(F.col("next").isNull(), hit))
        found = F.col("hit").isNotNull()
        # down into the first box that reaches far enough, or up and on behind all of this node
        level = F.when(F.col("next").isNotNull(), F.col("level")).when(found, F.col("level") - 1).otherwise(F.col("level") + 1)
        at = F.when(F.col("next").isNotNull(), F.col("at")).when(found, F.col("hit") * FAN).otherwise(F.col("parent") + 1)
        next_ = F.coalesce("next", F.when(F.col("level") == 0, F.col("hit")))
        return looked.select("group_key", "rank", "x", "y", level.cast("int").alias("level"), at.alias("at"), next_.alias("next"))

    states = members.filter("x is not null").select("group_key", "rank", "x", "y", F.lit(0).alias("level"), (F.col("rank") + 1).alias("at"), F.lit(None).cast("bigint").alias("next"))
    solved, before = None, None
    while True:
        for _ in range(STEPS):
            states = step(states)
        states = written(states, "states")
        if before is not None:
            dropped(before)
        done = written(states.filter("next is not null").select("group_key", "rank", "next"), "successors")
        solved = done if solved is None else solved.unionAll(done)
        before, states = states, states.filter(F.col("next").isNull() & (F.col("level") <= top))
        if states.isEmpty():
            return solved


def beginnings(jumps: DataFrame, starts: DataFrame) -> DataFrame:
    """(group_key, rank) reached from starts by jumps (group_key, rank, next), whose length doubles each round."""
    reached, before = starts, None
    while True:
        new = reached.join(jumps, ["group_key", "rank"]).select("group_key", F.col("next").alias("rank"))
        new = written(new, "reached")
        if new.isEmpty():
            return reached
        reached = reached.unionAll(new)
        far = jumps.select("group_key", F.col("rank").alias("next"), F.col("next").alias("_to"))
        jumps = written(jumps.join(far, ["group_key", "next"]).select("group_key", "rank", F.col("_to").alias("next")), "jumps")
        if before is not None:
            dropped(before)
        before = jumps


def split_by_pointers(groups: DataFrame, max_metres: float) -> DataFrame:
    """(group_key, cluster_no, facility_id) of groups of any size, clusters of one included."""
    members = written(ranked(groups), "ranked")
    firsts = members.filter("rank = 0").select("group_key", "rank")
    # a first member without a known point keeps all others: an unknown distance joins
    heads = beginnings(successors(members, max_metres), firsts).withColumn("head", F.lit(1))
    marked = written(members.join(heads, ["group_key", "rank"], "left").select("group_key", "rank", "facility_id", F.coalesce("head", F.lit(0)).alias("head"), _up("rank", BLOCK).alias("block")), "marked")
    blocks = marked.groupBy("group_key", "block").agg(F.sum("head").alias("_n"))
    before = blocks.select("group_key", "block", F.coalesce(F.sum("_n").over(Window.partitionBy("group_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum("head").over(Window.partitionBy("group_key", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_own", own).join(before, ["group_key", "block"]).select("group_key", (F.col("_before") + F.col("_own") - 1).cast("int").alias("cluster_no"), "facility_id")

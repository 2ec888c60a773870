"""Connected components by alternating stars, one written table a round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelane.llm.common import drop_written, written


def _digest(edges: DataFrame) -> tuple:
    """Count and an order-free checksum of the edges: one row to the driver."""
    x = F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(x), F.lit(0))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    lower = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the least node that can be reached.

    Nulls and loops are left out.  Each round needs one shuffle a star; minima are combined before they are shuffled, so a
    node with very many links is no burden.  Rounds grow with the logarithm of the longest path.  The driver sees a count
    and a checksum a round.  No edges: no rows.
    """
    clean = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(clean, "edges")
    seen = _digest(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        new = written(_small_star(_large_star(now)), "edges")
        digest = _digest(new)
        drop_written(now)
        now = new
        if digest == seen:
            break
        seen = digest
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


#: In a bucket of up to so many nodes all pairs are compared.
PAIR_BUCKET = 16
_EPS = 1e-9


def _apart(a: Column, b: Column) -> Column:
    """Elements that only one of two arrays has."""
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def _open_buckets(rows: DataFrame) -> DataFrame:
    """(key, n) of the buckets of rows(key, node, root) that hold several roots; of buckets with the same nodes one."""
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("node"), 16)).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    return sums.filter("lo <> hi").groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key", "n")


def bucket_links(rows: DataFrame, sets: DataFrame, least: float, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Edges (a, b) of pairs of at least the given Jaccard similarity that connect whatever all such pairs within buckets connect.

    rows(key, node) are distinct; sets(node, items array<bigint>) holds each node once, with distinct items.

    Small buckets compare all pairs.  A large bucket is described from its centre, the items that over half of its nodes have: what a node has
    more or less than that is its rest, and two nodes differ in what their rests differ.  With x for the number of differing items, a pair is
    alike if x <= r * (both sizes), r = (1 - least) / (1 + least).  Call a node's rest less r times its size its excess.

    - The node of least excess is the head; all are compared with it, and linked if alike.  If the excesses of two nodes add up to 0 or less, both
      are alike to the head, so this pair needs no look.
    - Any other pair that is alike has at least half its summed excess of rest items in common, so the rarest items of each rest (all but so many,
      less one) share one.  Each becomes the key of a bucket, which holds half of the nodes at most, and the same is done there.

    So nothing is lost, no large bucket becomes pairs, and a bucket of n nodes is done after log(n) rounds.  Nodes that heads
    connect have one root and are not compared again; buckets of one root, or that repeat the nodes of another, are closed.  In the first round buckets
    with the same centre (the same nodes by several bands) are one.
    """
    r = (1 - least) / (1 + least)
    met = written(rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key"), "buckets")
    small = met.filter(F.col("n") <= pair_bucket)
    x, y = small.select("key", F.col("node").alias("a")), small.select("key", F.col("node").alias("b"))
    pairs = x.join(y, "key").filter("a < b").select("a", "b").distinct()
    a, b = sets.select(F.col("node").alias("a"), F.col("items").alias("sa")), sets.select(F.col("node").alias("b"), F.col("items").alias("sb"))
    edges = written(pairs.join(a, "a").join(b, "b").filter(jaccard(F.col("sa"), F.col("sb")) >= least - _EPS).select("a", "b"), "links")
    crowd = met.filter(F.col("n") > pair_bucket).select("key", "node", F.col("node").alias("root"))
    crowd = written(crowd.join(_open_buckets(crowd), "key"), "crowds")
    crowd = written(crowd.join(_shared_items(sets.join(crowd.select("node").distinct(), "node")), "node"), "crowds")
    first = True
    while not crowd.isEmpty():
        placed = _centred(crowd, r, first)
        drop_written(crowd)
        seen = _seen(placed, r)
        drop_written(placed)
        dealt = _dealt(seen, r, least)
        links = seen.filter("head is not null").select(F.col("head").alias("a"), F.col("node").alias("b"))
        edges = edges.unionAll(written(links.unionAll(_few_pairs(dealt.filter(F.col("n") <= pair_bucket), r)).distinct(), "links"))
        drop_written(seen)
        crowd = written(dealt.filter(F.col("n") > pair_bucket), "crowds")
        drop_written(dealt)
        first = False
    return edges


def _shared_items(sets: DataFrame) -> DataFrame:
    """(node, size, own, rest): rest are the items that other nodes have too, own is the number of the others, which no two nodes have in common."""
    each = sets.select("node", F.size("items").alias("size"), F.explode("items").alias("item"))
    often = each.groupBy("item").agg(F.count("*").alias("c")).filter("c > 1").select("item")
    found = each.join(often, "item").groupBy("node", "size").agg(F.collect_list("item").alias("rest"))  # bounded by a set
    return found.select("node", "size", (F.col("size") - F.size("rest")).alias("own"), "rest")


def _centred(crowd: DataFrame, r: float, merge: bool) -> DataFrame:
    """(key, node, root, size, own, rest, excess) of crowd(key, n, node, root, size, own, rest), with the rest now taken from the bucket's centre."""
    counts = crowd.select("key", "n", F.explode("rest").alias("item")).groupBy("key", "n", "item").agg(F.count("*").alias("c"))
    centre = counts.filter(2 * F.col("c") > F.col("n")).groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("centre"))  # bounded by two rests
    placed = crowd.join(centre, "key", "left").withColumn("rest", F.coalesce(_apart(F.col("rest"), F.col("centre")), F.col("rest")))
    if merge:
        placed = placed.withColumn("key", F.when(F.col("centre").isNull(), F.col("key")).otherwise(F.xxhash64("centre"))).dropDuplicates(["key", "node"])
    return written(placed.select("key", "node", "root", "size", "own", "rest", (F.col("own") + F.size("rest") - F.lit(r) * F.col("size")).alias("excess")), "placed")


def _seen(placed: DataFrame, r: float) -> DataFrame:
    """placed with the head that a node is linked with, if any, the root after that, and the root of the bucket's head as main."""
    heads = placed.groupBy("key").agg(F.min(F.struct("excess", "node", "root", "size", "own", "rest")).alias("first"))
    both = placed.join(heads, "key")
    alike = (F.col("own") + F.col("first.own") + F.size(_apart(F.col("rest"), F.col("first.rest"))) <= F.lit(r) * (F.col("size") + F.col("first.size")) + _EPS) & (F.col("node") != F.col("first.node"))
    root = F.when(alike, F.col("first.root")).otherwise(F.col("root"))
    return written(both.select("key", "node", "size", "own", "rest", "excess", F.when(alike, F.col("first.node")).alias("head"), root.alias("root"), F.col("first.root").alias("main")), "seen")


def _dealt(seen: DataFrame, r: float, least: float) -> DataFrame:
    """The open buckets (key, n, node, root, size, own, rest) that the rarest items of the rests make."""
    # a partner has a rest of its own; what the head is connected with need only be held against the others, if the sum of excesses may be positive
    placed, seen = seen, seen.filter(F.size("rest") > 0).withColumn("within", F.col("root") == F.col("main"))
    other = F.when(~F.col("within"), F.col("excess"))
    spans = seen.groupBy("key").agg(F.min("excess").alias("least"), F.max("excess").alias("most"), F.min(other).alias("least_other"), F.max(other).alias("most_other"))
    busy = seen.join(spans, "key").filter(F.col("excess") + F.when(F.col("within"), F.col("most_other")).otherwise(F.col("most")) > _EPS)
    half = F.ceil((F.col("excess") + F.when(F.col("within"), F.col("least_other")).otherwise(F.col("least"))) / 2 - _EPS)
    shared = F.greatest(F.lit(1), half, F.ceil(F.col("excess") - F.lit(r / least) * F.col("size") - _EPS))
    d = F.col("own") + F.size("rest")
    items = busy.filter(d >= shared).select("key", "node", (d - shared + 1).alias("prefix"), d.alias("d"), F.explode("rest").alias("item"))
    often = items.groupBy("key", "item").agg(F.count("*").alias("c")).filter("c > 1")
    ranked = items.join(often, ["key", "item"]).groupBy("key", "node", "prefix", "d").agg(F.array_sort(F.collect_list(F.struct("c", "item"))).alias("xs"))  # bounded by a rest
    alone = F.col("d") - F.size("xs")  # items that no other node has come first of all
    kept = F.slice("xs", F.lit(1), F.greatest(F.lit(0), F.col("prefix") - alone).cast("int"))
    keys = ranked.select("key", "node", F.explode(F.transform(kept, lambda x: x["item"])).alias("item"))
    rows = keys.join(placed.select("key", "node", "root", "size", "own", "rest"), ["key", "node"]).select(F.xxhash64("key", "item").alias("key"), "node", "root", "size", "own", "rest")
    dealt = written(rows, "dealt")
    out = written(dealt.join(_open_buckets(dealt), "key").select("key", "n", "node", "root", "size", "own", "rest"), "dealt")
    drop_written(dealt)
    return out


def _few_pairs(few: DataFrame, r: float) -> DataFrame:
    x, y = (few.select("key", F.col("node").alias(v), F.col("root").alias(f"r{v}"), F.col("size").alias(f"n{v}"), F.col("own").alias(f"o{v}"), F.col("rest").alias(f"s{v}")) for v in "ab")
    pairs = x.join(y, "key").filter("a < b and ra <> rb").filter(F.col("oa") + F.col("ob") + F.size(_apart(F.col("sa"), F.col("sb"))) <= F.lit(r) * (F.col("na") + F.col("nb")) + _EPS)
    return pairs.select("a", "b")

"""Benchmark decontamination by spaced seeds.  Column expressions only.

Fixed masks select some of successive tokens and ignore the others; a document and an item that agree in a mask's tokens share a hash.  Around every
shared hash the item is laid beside the document and equal tokens are counted, so substituted words do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from acrelane.llm.common import col, written

#: Spaced seeds: each takes six tokens and ignores those between them.  Found by a search over masks of a span of ten at most; with a fifth of an item's tokens
#: changed, at any places, one of the four lies on unchanged tokens somewhere, for every length from EXACT_BELOW to ITEM_TOKENS, and so in
#: a stretch.  Fixed values; tests prove this for every placement.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 4, 6, 7, 8), (0, 1, 3, 7, 8, 9), (0, 1, 2, 3, 7, 8))
#: Items of fewer tokens must occur as they are.
EXACT_BELOW = 11
#: Share of equal tokens that counts as contamination, over the whole item or over a stretch of so many of its tokens.
LEAST_OVERLAP, STRETCH = 0.8, 24
#: Tokens of the items of one broadcast, each of which gives a seed at most for each mask; more go in several passes over the documents.
BLOCK_TOKENS = 2_000_000
#: Longer items are cut into parts of so many tokens, each of which is looked for.
ITEM_TOKENS = 512
#: Documents are looked through in runs of so many places, each with the tokens around that an item may reach.
RUN_PLACES = 128


def token_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words: lower-case runs of letters and digits."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(tokens: Column, at: Column, mask_no: int, offsets: tuple[int, ...]) -> Column:
    """The hash of the selected tokens from position at; null where the mask reaches over the end."""
    parts = [F.get(tokens, at + o) for o in offsets]
    return F.when(at + offsets[-1] < F.size(tokens), F.xxhash64(F.lit(mask_no), *parts))


def item_masks(n: int) -> tuple[tuple[int, ...], ...]:
    """The offsets that make the seeds of an item of n tokens; a short item is one seed as a whole."""
    return (tuple(range(n)),) if n < EXACT_BELOW else MASKS


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, tokens, key, part): distinct token sequences of at most ITEM_TOKENS, with the ids that have them counted by key."""
    rows = benchmark.select(col(id_col).alias("item"), token_hashes(col(text_col)).alias("all")).filter("size(all) > 0")
    # parts overlap, so each stretch lies whole in one of them
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("all") - STRETCH), F.lit(ITEM_TOKENS - STRETCH + 1))
    rows = rows.select("item", "all", F.explode(starts).alias("start"))
    # a short rest is taken with the tokens before it
    first = F.when(F.col("start") + ITEM_TOKENS > F.size("all"), F.greatest(F.lit(0), F.size("all") - ITEM_TOKENS)).otherwise(F.col("start"))
    return rows.select("item", F.slice("all", first + 1, F.lit(ITEM_TOKENS)).alias("tokens")).distinct().withColumn("key", F.xxhash64("tokens"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST_OVERLAP, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id, item, n_matched, n_item, overlap, doc_start): benchmark items that documents contain, one row a pair, the best place.

    A pair is reported if, item laid beside document at some shared seed, at least the given share of the item's tokens (or of STRETCH
    tokens in a row of it) are equal; overlap is the share of the whole item (of its part, where the item is cut), doc_start
    the first token's number, negative if the item begins before the document.  Items of under EXACT_BELOW tokens must occur as they are.

    Items without a token match nothing; null texts are empty; items with equal tokens are looked for once and reported each; null and
    repeated ids are groups of their own; empty tables give no rows; other columns are not carried.
    """
    items = written(_items(benchmark, item_col, item_text_col), "items")
    distinct = items.groupBy("key").agg(F.first("tokens").alias("tokens"))
    total = distinct.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n")).first()["n"]
    lengths = [r["n"] for r in distinct.select(F.size("tokens").alias("n")).distinct().collect()]  # ITEM_TOKENS at most
    masks = {}  # the lengths of items by mask
    for n in sorted(lengths):
        for offsets in item_masks(n):
            masks.setdefault((n < EXACT_BELOW, offsets), []).append(n)
    masks = [(offsets, ns) for (_, offsets), ns in masks.items()]
    passes = -(-total // block_tokens)
    found = None
    for block in range(passes):
        part = distinct.filter(F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(passes)) == block) if passes > 1 else distinct
        hits = _pass(docs, part, id_col, text_col, masks, least)
        found = hits if found is None else found.unionAll(hits)
    if found is None:
        kinds = [StructField(id_col, docs.select(col(id_col)).schema[0].dataType), StructField(item_col, items.schema["item"].dataType)]
        return docs.sparkSession.createDataFrame([], StructType([*kinds, *StructType.fromDDL("n_matched int, n_item int, overlap double, doc_start int")]))
    best = found.groupBy("id", "key").agg(F.max(F.struct("n_matched", F.negative("doc_start").alias("late"), "n_item")).alias("x"))
    named = best.join(items.select("item", "key"), "key")
    each = named.groupBy("id", "item").agg(F.max(F.struct("x.n_matched", "x.late", "x.n_item")).alias("x"))
    return each.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("x.n_matched").alias("n_matched"), F.col("x.n_item").alias("n_item"), F.round(F.col("x.n_matched") / F.col("x.n_item"), 6).alias("overlap"), F.negative("x.late").alias("doc_start"))


def _pass(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, masks: list[tuple[tuple[int, ...], list[int]]], least: float) -> DataFrame:
    """Verified hits of a bounded set of items; that set is broadcast, the documents are scanned once and not shuffled."""
    def seeds(tokens: Column, at: Column, own: bool = False) -> Column:
        each = [(_seed(tokens, at, m, offsets), F.size(tokens).isin(ns)) for m, (offsets, ns) in enumerate(masks)]
        return F.array(*[F.when(mine, seed) if own else seed for seed, mine in each])

    places = items.select("key", "tokens", F.posexplode("tokens").alias("at", "_"))
    places = places.select("key", "at", F.posexplode(seeds(F.col("tokens"), F.col("at"), True)).alias("mask", "seed")).filter("seed is not null")
    # a seed of one item is looked up as (key, at); the tokens come from a second, smaller broadcast
    around = max(n for _, ns in masks for n in ns)
    doc = docs.select(col(id_col).alias("id"), token_hashes(col(text_col)).alias("doc"))

    def run(start: Column) -> Column:
        low = F.greatest(F.lit(0), start - around)
        return F.struct(start.alias("start"), low.alias("low"), F.slice("doc", low + 1, start + (RUN_PLACES + around) - low).alias("doc"))

    # a row for each run: Spark keeps all hits of such a row at once, so neither these nor the tokens beside them follow a document's length
    runs = F.when(F.size("doc") > 0, F.transform(F.sequence(F.lit(0), F.size("doc") - 1, F.lit(RUN_PLACES)), run))
    rows = doc.select("id", F.explode(runs).alias("run")).select("id", "run.start", "run.low", "run.doc")
    own = F.slice("doc", F.col("start") - F.col("low") + 1, F.lit(RUN_PLACES))
    rows = rows.select("id", "low", "doc", (F.col("start") - F.col("low")).alias("skip"), F.posexplode(own).alias("p", "_")).withColumn("p", F.col("p") + F.col("skip"))
    rows = rows.select("id", "low", "doc", "p", F.explode(seeds(F.col("doc"), F.col("p"))).alias("seed")).filter("seed is not null")
    # doc_start counts from the run's first token, until the item is compared
    hits = rows.join(F.broadcast(places), "seed").select("id", "low", "key", "doc", "mask", "at", (F.col("p") - F.col("at")).alias("doc_start"))
    laid = hits.join(F.broadcast(items.select("key", "tokens")), "key")

    def same(i: Column) -> Column:
        return F.coalesce((i >= 0) & (F.col("doc_start") + i >= 0) & (F.get("tokens", i) == F.get("doc", F.col("doc_start") + i)), F.lit(False))

    # where the mask fits one token earlier as well, the item is laid there: a run of equal tokens is compared once for each mask, not for each token
    before = F.col("at") - 1
    again = F.lit(False)
    for m, (offsets, _) in enumerate(masks):
        fits = same(before)
        for o in offsets[1:]:
            fits = fits & same(before + o)
        again = F.when(F.col("mask") == m, fits).otherwise(again)
    laid = laid.filter(~again)
    # only the tokens beside the item go on
    first = F.greatest(F.lit(0), F.col("doc_start"))
    beside = F.slice("doc", first + 1, F.greatest(F.lit(0), F.col("doc_start") + F.size("tokens") - first))
    laid = laid.select("id", "key", "tokens", (F.col("doc_start") + F.col("low")).alias("doc_start"), (F.col("doc_start") - first).alias("shift"), beside.alias("beside"))
    equal = F.transform("tokens", lambda t, i: F.when(F.get(F.col("beside"), F.col("shift") + i) == t, 1).otherwise(0))
    checked = laid.select("id", "key", "doc_start", F.size("tokens").alias("n_item"), equal.alias("equal"))
    n = F.aggregate("equal", F.lit(0), lambda a, b: a + b)
    checked = checked.withColumn("n_matched", n)
    stretch = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n_item") - STRETCH + 1)), lambda i: F.aggregate(F.slice("equal", i, STRETCH), F.lit(0), lambda a, b: a + b) >= least * STRETCH)
    exact_if_short = F.when(F.col("n_item") < EXACT_BELOW, F.col("n_matched") == F.col("n_item")).otherwise(True)
    return checked.filter(exact_if_short & ((F.col("n_matched") >= least * F.col("n_item")) | ((F.col("n_matched") >= least * STRETCH) & stretch))).select("id", "key", "doc_start", "n_item", "n_matched")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item.  A row is judged by id and text, so rows that share an id, or have none, are judged
    each for itself."""
    text = F.xxhash64(col(text_col))
    keyed = docs.select(F.struct(col(id_col).alias("id"), text.alias("h")).alias("key"), col(text_col).alias("text"))
    bad = contaminated(keyed, benchmark, "key", "text", **options).select("key.*").distinct().toDF("_bad_id", "_bad_text")
    return docs.join(bad, col(id_col).eqNullSafe(F.col("_bad_id")) & (text == F.col("_bad_text")), "left_anti")


#: The same rows by laying every document beside every item at all equal words.
SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws
  FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM d),
bw AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM b),
hits AS (SELECT doc_id, item_id, n, p - i AS doc_start, i FROM dw JOIN bw USING (w)),
busy AS (
  SELECT doc_id, item_id, n, doc_start, count(*) AS n_matched FROM hits GROUP BY ALL
  HAVING CASE WHEN n < 11 THEN count(*) = n ELSE count(*) >= 0.8 * n OR count(*) >= 0.8 * 24 END),
runs AS (
  SELECT doc_id, item_id, doc_start, max(k) AS most FROM (
    SELECT h.doc_id, h.item_id, h.doc_start, count(*) OVER (
      PARTITION BY h.doc_id, h.item_id, h.doc_start ORDER BY h.i RANGE BETWEEN CURRENT ROW AND 23 FOLLOWING) AS k
    FROM hits h JOIN busy USING (doc_id, item_id, doc_start)) GROUP BY ALL),
found AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, doc_start) AS rn
  FROM busy JOIN runs USING (doc_id, item_id, doc_start)
  WHERE n_matched >= 0.8 * n OR most >= 0.8 * 24)
SELECT doc_id, item_id, CAST(n_matched AS INT) AS n_matched, CAST(n AS INT) AS n_item,
       round(n_matched / n, 6) AS overlap, CAST(doc_start AS INT) AS doc_start
FROM found WHERE rn = 1
"""

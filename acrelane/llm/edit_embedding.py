"""Document fingerprints by randomised edit embedding.

A walk copies the current character and then, by a shared random bit of (step, character), stays on it or goes on to the next.  All texts
share the bits.  After an edit two walks drift, and by chance soon fall into step again, so texts at edit distance k have walks
at a Hamming distance of about k squared at most, however long they are.  Samples of the walk at shared random steps are the
fingerprint: equal positions of two fingerprints estimate how much of the walks agrees.

The sampled steps are chosen so that any text length can be compared with any other: sample s of a walk of n steps looks at the last
record of a random process on the steps, so that walks of n and m steps look at the same step with probability min/max.
"""

from __future__ import annotations

import hashlib
import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelane.llm.common import arrow_map, col, map_texts, slices, written
from acrelane.llm.components import bucket_links, connected_components

#: Samples of a fingerprint; each is a hexadecimal digit.
SAMPLES = 128
#: Characters of the walk, from the sampled step on, that a digit is made of.
SPAN = 6
SEED = 20240917
#: The random bits repeat after so many steps; characters share them by class.
PERIOD, CLASSES = 4093, 128
#: Cells of one block of texts that walk together.
BLOCK_CELLS = 1 << 21
#: Rows that share a window in which each looks for the next, and the greatest number of such windows.
STRETCH_ROWS, MOST_STRETCHES = 200, 20_000
#: Banding: bands of digits, and the likeness that candidates must have.
BANDS, BAND_DIGITS, LEAST_LIKENESS = 24, 5, 0.8


@lru_cache(maxsize=1)
def _dwell() -> np.ndarray:
    """Steps that the walk spends on a character of class c when it arrives at step j (mod PERIOD)."""
    go = np.random.default_rng(SEED).integers(0, 2, (CLASSES, PERIOD), dtype=np.int8).astype(bool)
    twice = np.concatenate([go, go], axis=1)
    far = np.where(twice, np.arange(2 * PERIOD), 2 * PERIOD)
    first = np.minimum.accumulate(far[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
    return (first - np.arange(PERIOD) + 1).astype(np.int32).ravel()


@lru_cache(maxsize=1)
def _records() -> list[np.ndarray]:
    """For each sample the steps (ascending) at which its random process has a new record."""
    rng = random.Random(SEED)
    out = []
    for _ in range(SAMPLES):
        at, steps = 1, [0]
        while at < 1 << 40:
            at = int(at / (1 - rng.random())) + 1
            steps.append(at - 1)
        out.append(np.array(steps, np.int64))
    return out


@lru_cache(maxsize=1 << 14)
def _sampled(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All record steps below 2^bits, as a flat array, and the sample of each."""
    flat = [(int(step), s) for s, steps in enumerate(_records()) for step in steps if step < 1 << bits]
    return np.array([f[0] for f in flat], np.int64), np.array([f[1] for f in flat], np.int64)


def _steps_of(n_steps: int) -> np.ndarray:
    """The step that each sample looks at in a walk of n_steps steps."""
    steps, owner = _sampled(n_steps.bit_length())
    below = steps < n_steps
    out = np.zeros(SAMPLES, np.int64)
    np.maximum.at(out, owner[below], steps[below])
    return out


def _walk(block: list[np.ndarray]) -> np.ndarray:
    """arrivals[i, t]: the step at which the walk over text t arrives at its character i; one row more for the end."""
    longest = max(map(len, block))
    chars = np.zeros((longest, len(block)), np.int32)
    for t, codes in enumerate(block):
        chars[: len(codes), t] = codes
    chars = (chars * np.int32(-1640531527) >> 16 & (CLASSES - 1)) * np.int32(PERIOD)
    dwell, now = _dwell(), np.zeros(len(block), np.int32)
    phase = now.copy()
    arrivals = np.empty((longest + 1, len(block)), np.int32)
    for i in range(longest):
        arrivals[i] = now
        spent = dwell[chars[i] + phase]
        now = now + spent
        phase = phase + spent
        phase %= PERIOD
    arrivals[longest] = now
    return arrivals


def _digits(codes: np.ndarray, arrivals: np.ndarray) -> str:
    """The fingerprint of one text from its characters and its walk."""
    n = len(codes)
    if not n:
        return "0" * SAMPLES
    at = _steps_of(int(arrivals[n]))
    # what the walk shows at the sampled step and the next ones: which character, and how far into its stay
    span = at[:, None] + np.arange(SPAN)
    where = np.searchsorted(arrivals[: n + 1], span, side="right") - 1
    shown = np.where(where < n, codes[np.minimum(where, n - 1)], -1).astype(np.uint64)
    h = np.zeros(SAMPLES, np.uint64)
    for k in range(SPAN):
        h = (h ^ (shown[:, k] + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return "".join(map("0123456789abcdef".__getitem__, (h >> np.uint64(60)).tolist()))


def fingerprints_of(texts: list) -> list[str]:
    """Fingerprints of whole texts, None as empty; texts of like length walk together."""
    codes = [np.frombuffer((t or "").encode("utf-32-le"), "<u4").view(np.int32) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: len(codes[i]))
    out = [""] * len(texts)
    while order:
        longest = max(1, len(codes[order[-1]]))
        take = max(1, min(len(order), BLOCK_CELLS // longest))
        block, order = order[-take:], order[:-take]
        arrivals = np.ascontiguousarray(_walk([codes[i] for i in block]).T)
        for t, i in enumerate(block):
            out[i] = _digits(codes[i], arrivals[t])
    return out


def with_fingerprint(df: DataFrame, keep: list[tuple[str, Column]], text: Column, name: str) -> DataFrame:
    """The kept columns and the fingerprint of the text column."""
    return map_texts(df, keep, text, lambda texts: {name: pa.array(fingerprints_of(texts), pa.string())}, f"`{name}` string")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal digits of two fingerprints, 0 to 1."""
    same = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x)
    return F.size(same) / F.lit(float(SAMPLES))


def _stretch(cut_points: list, id_type: str) -> Column:
    """How many of the ascending cut points are at or below the id, by bisection; 0 for a null id."""
    edges = F.array(*map(F.lit, cut_points)).cast(f"array<{id_type}>")

    def halve(span, _):
        middle = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        below = F.coalesce(F.get(edges, middle) <= F.col("id"), F.lit(False))
        busy = span["lo"] < span["hi"]
        return F.struct(F.when(busy & below, middle + 1).otherwise(span["lo"]).alias("lo"), F.when(busy & ~below, middle).otherwise(span["hi"]).alias("hi"))

    turns = F.sequence(F.lit(1), F.lit(len(cut_points).bit_length() + 1))
    return F.aggregate(turns, F.struct(F.lit(0).alias("lo"), F.lit(len(cut_points)).alias("hi")), halve)["lo"]


def next_documents(df: DataFrame, id_col: str, text_col: str, stretch_rows: int = STRETCH_ROWS, most_stretches: int = MOST_STRETCHES) -> DataFrame:
    """(id, body, next_body): each text beside the following one by ascending id (ties: by text), the first after the last.

    Ids are cut into stretches of about stretch_rows, each a window of its own; their number grows with the table (up to most_stretches, from
    where on they grow, and spill).  The cut points, which decide nothing but the split of the work, come from Spark's range partitioning.  The first
    row of a stretch is lent to the one before, so no stretch needs another.  A null id comes first, a null text is empty.
    """
    rows = df.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("body"))
    ids = rows.select("id")
    total = ids.count()
    cuts = min(most_stretches, max(1, total // stretch_rows))
    # the least id of each range that Spark's range partitioning makes, for ids of any type that has an order
    ranges = ids.repartitionByRange(cuts, "id").groupBy(F.spark_partition_id()).agg(F.min("id").alias("least")).select("least") if cuts > 1 else ids.limit(0)
    edges = sorted({row[0] for row in ranges.collect()} - {None})[1:]  # most_stretches at most
    stretch = _stretch(edges, ids.schema[0].dataType.simpleString()) if edges else F.lit(0)
    # every stretch but the first holds its own cut point, so none of them is empty
    firsts = ids.groupBy(stretch.alias("stretch")).agg(F.min("id").alias("least"), F.count_if(F.col("id").isNull()).alias("nulls"))
    firsts = firsts.select("stretch", F.when(F.col("nulls") == 0, F.col("least")).alias("least"))
    head = firsts.agg(F.min("stretch").alias("m")).first()["m"]
    lender = F.when(F.col("stretch") == head, len(edges)).otherwise(F.col("stretch") - 1)
    rows = rows.withColumn("stretch", stretch)
    heads = rows.alias("r").join(F.broadcast(firsts).alias("f"), (F.col("r.stretch") == F.col("f.stretch")) & F.col("r.id").eqNullSafe(F.col("f.least")))  # a row a stretch
    heads = heads.groupBy("r.stretch").agg(F.min("body").alias("body")).select(F.lit(None).cast(ids.schema[0].dataType).alias("id"), "body", lender.alias("stretch"), F.lit(True).alias("lent"))
    w = Window.partitionBy("stretch").orderBy("lent", "id", "body")
    both = rows.withColumn("lent", F.lit(False)).unionByName(heads)
    return both.withColumn("next_body", F.lead("body").over(w)).filter(~F.col("lent")).select("id", "body", "next_body")


def _like(a: str, b: str) -> float:
    return sum(map(str.__eq__, a, b)) / SAMPLES


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every whole text.

    The edited text has its last floor(n/4) code points replaced by the first as many of the next document's (ascending id; after the
    last the first; fewer if that text is shorter).  A null text counts as empty and has the fingerprint of all zeros; rows that
    share an id follow each other by text; a single row is its own next; an empty table gives none; other columns are not
    carried.
    """
    chained = next_documents(df, id_col, text_col).select(F.col("id").alias("k0"), "body", "next_body")
    kind = chained.schema[0].dataType.simpleString()
    names = ["k0", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                bodies, after = part.column(1).to_pylist(), part.column(2).to_pylist()
                edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(bodies, after, strict=True)]
                prints = fingerprints_of(unique := list(dict.fromkeys([*bodies, *after, *edited])))
                of = dict(zip(unique, prints, strict=True))
                a, b, c = ([of[t] for t in x] for x in (bodies, edited, after))
                columns = [[len(t) for t in bodies], [hashlib.sha256(t.encode()).hexdigest() for t in edited], a, b, list(map(_like, a, b)), list(map(_like, a, c))]
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns, types)], names=names)

    out = arrow_map(chained, run, f"k0 {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("k0", id_col)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, band_digits: int = BAND_DIGITS, least: float = LEAST_LIKENESS) -> DataFrame:
    """(id, fingerprint, component_id): texts whose fingerprints share a band and agree in at least the given share of digits.

    Bands sample digits of the fingerprint at fixed random places.  Equal fingerprints are one node, and colliding ones are verified
    on all digits; see bucket_links for large buckets.  component_id is the least id that links reach.  A null text is empty;
    repeated rows give repeated rows; an empty table gives none; other columns are not carried.
    """
    prints = written(with_fingerprint(df, [("id", col(id_col))], col(text_col), "print"), "prints")
    nodes = prints.groupBy("print").agg(F.min("id").alias("least_id"))
    rng = random.Random(SEED + 1)
    places = [sorted(rng.sample(range(SAMPLES), band_digits)) for _ in range(bands)]
    keys = F.array(*[F.concat(F.lit(f"{b}:"), *[F.substring("print", p + 1, 1) for p in ps]) for b, ps in enumerate(places)])
    rows = nodes.select(F.col("print").alias("node"), F.explode(keys).alias("key"))
    # a share s of equal digits is a Jaccard similarity of s / (2 - s) of the sets of (place, digit)
    digits = F.transform(F.split("print", ""), lambda c, i: (i * 16 + F.conv(c, 16, 10).cast("int")).cast("bigint"))
    edges = bucket_links(rows, nodes.select(F.col("print").alias("node"), digits.alias("items")), least / (2 - least))
    parts = connected_components(edges.distinct())
    joined = nodes.join(parts.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    named = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return prints.join(joined.join(named, "component").select("print", "component_id"), "print").select(F.col("id").alias(id_col), F.col("print").alias("fingerprint"), "component_id")

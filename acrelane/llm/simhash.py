"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is set if it is set in over half of the hashes of a text's word shingles.  For a radius r every one of the 64 bits
gets a vector of r + 1 random bits, and each non-zero vector v gives a table that masks the fingerprint to the bits whose vector has
an odd product with v.  r differing bits never span all r + 1 dimensions, so some v is orthogonal to all of them: that table drops
just those bits, and the two fingerprints meet in it, always.
"""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelane.llm.common import col, map_texts, written
from acrelane.llm.components import connected_components

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
#: In a table's bucket of up to so many fingerprints, pairs are compared; beyond it, links are found without any pair.
PAIR_BUCKET = 16


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a whole text; 0 without a word."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and white space is space, tab to carriage return
    if not words:
        return 0
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(width)))), "<u8", len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = hashes[start : start + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def covering_masks(radius: int, seed: int = SEED) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits, such that any radius differing bits are all outside of some mask."""
    rng = random.Random(seed)
    vectors = [rng.randrange(1 << (radius + 1)) for _ in range(64)]
    return [sum(((vectors[bit] & v).bit_count() & 1) << bit for bit in range(64)) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint) of every whole text; null and empty texts have 0."""
    def fn(texts: list) -> dict:
        return {"fp": pa.array([_signed(fingerprint(t)) for t in texts], pa.int64())}

    return map_texts(df, [("id", col(id_col))], col(text_col), fn, "fp bigint")


def _flips(radius: int, mask: int) -> list[int]:
    """Changes of up to half the radius (rounded up) outside a mask: two values within the radius share a changed value."""
    free = [1 << b for b in range(64) if not mask >> b & 1]
    return [_signed(sum(c)) for n in range((radius + 1) // 2 + 1) for c in combinations(free, n)]


def links(distinct: DataFrame, radius: int = RADIUS, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Edges (a, b) that connect the same distinct fingerprints fp as all pairs within radius bits would.

    Fingerprints that share a masked value in a covering table are candidates.  Small buckets compare their pairs.  In large ones
    each fingerprint is dealt to all values that it has with up to ceil(radius/2) of the bits outside the mask changed; those that meet at
    a value are within 2*ceil(radius/2) bits, and each takes the least as its link.  For an odd radius that would be one bit too many, so it is refused.
    No bucket is dropped and no large bucket is turned into pairs.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = covering_masks(radius)
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)]))
    rows = distinct.select("fp", table.alias("x")).select("fp", "x.t", "x.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = written(rows.join(sizes, ["t", "key"]), "buckets")
    small = met.filter(F.col("n") <= pair_bucket)
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")))
    pairs = pairs.filter(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    flips = None
    for t, mask in enumerate(masks):
        changed = F.explode(F.array(*[F.lit(c) for c in _flips(radius, mask)]))
        part = met.filter((F.col("n") > pair_bucket) & (F.col("t") == t)).select("fp", changed.alias("change")).select("fp", F.col("fp").bitwiseXOR(F.col("change")).alias("z"))
        flips = part if flips is None else flips.unionAll(part)
    near = flips.groupBy("z").agg(F.collect_set("fp").alias("fps")).filter("size(fps) > 1")  # bounded: all lie around z
    stars = near.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a <> b")
    return pairs.unionAll(stars).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint of 16 hex digits, component_id): component_id is the least id that links reach.

    Fingerprints link at radius or fewer differing bits.  Equal fingerprints are one node, so thousands of copies cost one row.
    Null and empty texts have fingerprint zero and link like any other; a null id gets its component but is never its name;
    repeated rows give repeated rows; an empty table gives none; other columns are not carried.
    """
    prints = written(fingerprints(df, id_col, text_col), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    parts = connected_components(links(nodes.select("fp"), radius))
    joined = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = joined.join(named, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select(F.col("id").alias(id_col), hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

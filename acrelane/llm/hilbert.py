"""Sharding along a Hilbert curve: rows that agree in several metadata columns lie in the same files, so that readers can skip the others.

Each dimension is cut into buckets of equal row counts, the buckets of a row are a cell of a cube, cells are walked along the curve, and the
walk is cut into runs.  Column expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelane.llm.common import clear_names, col
from acrelane.llm.ordering import in_ranges, running

#: Metadata columns of documents that make the cube.
DIMENSIONS = ("lang", "source", "n_chars")
#: Buckets of a dimension, as a power of two.
BITS = 6
#: Bytes of a row beside its text.
ROW_BYTES = 8


def curve_steps(n: int) -> tuple[list[int], list[int]]:
    """digit and next state by state * 2**n + corner, for a curve in n dimensions: the state is the corner at which a cube is entered and the axis
    along which it is left."""
    full = (1 << n) - 1

    def turned(x: int, by: int) -> int:  # bits moved up by so many places, around
        by %= n
        return (x << by | x >> (n - by)) & full

    def gray(x: int) -> int:
        return x ^ x >> 1

    place = {gray(w): w for w in range(1 << n)}

    def entry(w: int) -> int:
        return gray(2 * ((w - 1) // 2)) if w else 0

    def axis(w: int) -> int:  # along which subcube w is walked
        low = w if w % 2 else w - 1
        return 0 if w == 0 else ((low + 1) & -(low + 1)).bit_length() - 1

    digits, states = [], []
    for state in range((1 << n) * n):
        corner, along = divmod(state, n)
        for at in range(1 << n):
            w = place[turned(at ^ corner, n - (along + 1))]
            digits.append(w)
            states.append((corner ^ turned(entry(w), along + 1)) * n + (along + axis(w) + 1) % n)
    return digits, states


def curve_index(buckets: Sequence[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a cell whose coordinates are integers of so many bits: neighbours on the curve are neighbours in the cube."""
    n = len(buckets)
    digits, states = (F.array(*[F.lit(v) for v in table]) for table in curve_steps(n))
    levels = F.array(*[F.lit(level) for level in range(bits - 1, -1, -1)])

    def corner(level: Column) -> Column:
        out = F.lit(0)
        for i, bucket in enumerate(buckets):
            bit = F.call_function("shiftright", bucket, level).bitwiseAND(F.lit(1))
            out = out + bit * F.lit(1 << i)
        return out

    def step(a: Column, x: Column) -> Column:
        at = a["state"] * F.lit(1 << n) + x
        return F.struct((a["index"] * F.lit(1 << n) + F.get(digits, at)).cast("long").alias("index"), F.get(states, at).alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.transform(levels, corner), start, step)["index"]


def cut_values(df: DataFrame, name: str, bits: int) -> list:
    """Ascending values, at most 2**bits - 1, that part the non-null rows into buckets of equal counts, exactly and at any size; a bucket begins at
    its cut, and a value that fills several buckets makes one."""
    counts = df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    summed = running(in_ranges(counts, name), None, upto=(F.sum, F.col("n")))
    total = summed.agg(F.max("upto")).first()[0]
    if not total:
        return []
    # the values in whose counts a multiple of total / 2**bits falls
    wide = F.lit(1 << bits)
    bucket = F.floor((F.col("upto") - F.col("n")) * wide / F.lit(total))
    firsts = summed.select(name, bucket.alias("bucket")).groupBy("bucket").agg(F.min(name).alias("v"))
    return sorted(r["v"] for r in firsts.filter("bucket > 0").collect())


def bucket_of(value: Column, cuts: list) -> Column:
    """The number of cuts at or before a value by halving; null comes before all."""
    def halves(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < F.lit(cuts[mid]), halves(low, mid)).otherwise(halves(mid + 1, high))

    return F.when(value.isNull(), F.lit(0)).otherwise(halves(0, len(cuts)))


def hilbert_shards(df: DataFrame, shards: int = 24, dimensions: Sequence[str] = DIMENSIONS, law: str = "rows", bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, curve, kept columns): each row's shard and its place in it, from 0, along the curve.

    size is the UTF-8 bytes of the text plus ROW_BYTES.  Law 'rows' gives shards whose counts differ by one at most, 'bytes' such whose
    sizes differ from each other by no more than two rows; a run may be cut within a cell.  Neither keeps rows in place when shards are
    added, so grown_shard is null.  Rows of a cell stand in order of checksum and id, so equal texts of a cell are neighbours.

    Dimensions may have any ordered type; a null value is in the first bucket; a dimension of one value does nothing.  Null text has no
    bytes and no checksum but that of the empty text; null and repeated ids and repeated rows are rows like others, and any number of equal
    ones is spread.  An empty table gives no rows.  A kept column that has a result's name gets _in behind it.

    The texts are read for their sizes and are not shuffled unless kept.  What reaches the driver are the cuts, under 2**bits values a dimension.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law must be 'rows' or 'bytes'")
    chosen = df.select(*[col(name).alias(f"d{i}") for i, name in enumerate(dimensions)], col(id_col).alias("id"), (F.coalesce(F.octet_length(col(text_col)), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.coalesce(col(text_col), F.lit("")).cast("binary")).alias("crc"), *[col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    buckets = [bucket_of(F.col(f"d{i}"), cut_values(df.select(col(name).alias("v")), "v", bits)) for i, name in enumerate(dimensions)]
    placed = chosen.withColumns({f"b{i}": b for i, b in enumerate(buckets)})
    placed = placed.withColumn("curve", curve_index([F.col(f"b{i}") for i in range(len(buckets))], bits)).drop(*[f"{x}{i}" for i in range(len(buckets)) for x in "bd"])
    ranged = in_ranges(placed, "curve", "crc", "id")
    # one row a range
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    before = sizes.select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.sum("n").over(everything).alias("all_n"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes0"), F.sum("bytes").over(everything).alias("all_bytes"))
    rows = ranged.join(F.broadcast(before), "_part").withColumn("rank", F.col("n0") + F.col("_pos"))
    if law == "rows":
        rows = rows.withColumn("shard", F.floor(F.expr(f"rank * {shards} div all_n")).cast("int"))
        rows = rows.withColumn("slot", F.col("rank") - F.expr(f"(shard * all_n + {shards - 1}) div {shards}"))
    else:
        own = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
        # the middle of a row decides, so no shard is more than half a row away from its share at either end
        rows = rows.withColumn("middle", F.col("bytes0") + F.sum("size").over(own) - F.expr("size div 2"))
        rows = rows.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"cast(middle * cast({shards} as decimal(20, 0)) / all_bytes as int)")))
        firsts = rows.groupBy("shard").agg(F.min("rank").alias("first"))
        rows = rows.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("rank") - F.col("first"))
    names = [id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve"]
    out = rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", *[F.col(f"k{i}") for i in range(len(keep))])
    return out.toDF(*names, *clear_names(list(keep), names))


def write_shards(df: DataFrame, path: str, shards: int = 24, dimensions: Sequence[str] = DIMENSIONS, **options) -> DataFrame:
    """Write df as Parquet, a folder for each shard with the rows in curve order, and give the manifest: (shard, n_rows, bytes, least and greatest value
    of each dimension), from which a reader knows the shards that can hold what it looks for."""
    names = list(df.columns)
    rows = hilbert_shards(df.select(*[col(c).alias(f"c{i}") for i, c in enumerate(names)]), shards, [f"c{names.index(d)}" for d in dimensions], id_col=f"c{names.index(options.pop('id_col', 'doc_id'))}", text_col=f"c{names.index(options.pop('text_col', 'text'))}", keep=[f"c{i}" for i in range(len(names))], **options)
    kept = rows.columns[8:]
    rows = rows.select(F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), *[F.col(k).alias(n) for k, n in zip(kept, names, strict=True)])
    rows.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").drop("_slot").write.partitionBy("_shard").parquet(path)
    text = options.get("text_col", "text")
    back = df.sparkSession.read.parquet(path)
    limits = [f(col(d)).alias(f"{label}_{d}") for d in dimensions for f, label in ((F.min, "min"), (F.max, "max"))]
    return back.groupBy(F.col("_shard").alias("shard")).agg(F.count("*").alias("n_rows"), F.sum(F.coalesce(F.octet_length(col(text)), F.lit(0)) + ROW_BYTES).alias("bytes"), *limits)

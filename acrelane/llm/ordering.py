"""Rows in order over ranges: sorted parts of even size, running aggregates across them, and digests of ordered lines.

A key with any share of the rows is spread over as many ranges as it fills: the range keys end in a number of the row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelane.llm.common import arrow_map
from acrelane.shared import in_ranges  # noqa: F401


def running(ranged: DataFrame, key: str | None, **aggregates: Column) -> DataFrame:
    """Running aggregates (this row included) along rows of in_ranges that were sorted by a key first, begun anew for each key (None: never).

    An aggregate is given as a pair: the function and the column that it takes, such as (F.sum, F.lit(1)) or (F.bit_xor, F.col("h")).
    Ranges are aggregated by themselves, and what stands before is added: of that there is one row a range at most, since only its
    first key can have begun in an earlier one, so it is broadcast.
    """
    keys = [key] if key else []
    runs = ranged.groupBy(*keys, "_part").agg(*[fn(c).alias(name) for name, (fn, c) in aggregates.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select(*keys, "_part", *[fn(name).over(earlier).alias(f"_{name}") for name, (fn, _) in aggregates.items()])
    before = before.filter(F.coalesce(*[F.col(f"_{name}") for name in aggregates]).isNotNull())
    own = Window.partitionBy(*keys, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumns({name: fn(c).over(own) for name, (fn, c) in aggregates.items()}).join(F.broadcast(before), [*keys, "_part"], "left")
    both = {name: F.when(F.col(f"_{name}").isNull(), F.col(name)).otherwise(F.col(name).bitwiseXOR(F.col(f"_{name}")) if fn is F.bit_xor else F.col(name) + F.col(f"_{name}")) for name, (fn, _) in aggregates.items()}
    return rows.withColumns(both).drop(*[f"_{name}" for name in aggregates])


def line_digests(df: DataFrame, key: str, line: str, order: list[str], separator: str) -> DataFrame:
    """(key, sha256): lowercase SHA-256 of each key's lines in order, joined by the separator.

    A digest takes its bytes one after the other, so the lines of a key pass through one task; they pass as a stream that Spark has sorted,
    and the task holds the state of one digest and one batch.
    """
    glue = separator.encode()
    rows = df.select(F.col(key).alias("key"), F.col(line).cast("string").alias("line"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    rows = rows.repartition("key").sortWithinPartitions("key", *[f"o{i}" for i in range(len(order))]).select("key", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys, ends = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or k != now:
                    if state is not None:
                        keys.append(now)
                        ends.append(state.hexdigest())
                    now, state = k, hashlib.sha256()
                else:
                    state.update(glue)
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(ends, pa.string())], names=["key", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], batch.schema.field(0).type), pa.array([state.hexdigest()])], names=["key", "sha256"])

    kind = rows.schema["key"].dataType.simpleString()
    return arrow_map(rows, run, f"key {kind}, sha256 string").withColumnRenamed("key", key)

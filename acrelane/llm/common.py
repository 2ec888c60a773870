"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from acrelane.shared import col, shared_folder, ship, written  # noqa: F401

#: Texts are handled in slices of about this many bytes, so that a worker's memory does not follow the batch size.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by written()."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def arrow_map(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow by a function that needs this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most limit bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def clear_names(names: list[str], results: list[str]) -> list[str]:
    """Names of kept columns beside results: one that is a result's name gets _in behind it."""
    taken = {r.lower() for r in results}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        out.append(name)
    return out


def map_texts(df: DataFrame, keep: list[tuple[str, Column]], text: Column, fn: Callable[[list], dict], results: str) -> DataFrame:
    """Apply fn to lists of texts (None for null) and put the lists or arrays that it returns beside the kept columns (name, column) of any type.

    Columns travel under names of our own, so that those of df, whatever they are, play no part.  results is the DDL of what fn returns.
    """
    chosen = df.select(*[c.alias(f"k{i}") for i, (_, c) in enumerate(keep)], text.cast("string").alias("text"))
    n, found = len(keep), StructType.fromDDL(results)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, n):
                got = fn(part.column(n).to_pylist())
                columns = [*part.columns[:n], *(v if isinstance(v, pa.Array) else pa.array(v) for v in got.values())]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f"k{i}" for i in range(n)), *(f"r{i}" for i in range(len(got)))])

    fields = [*chosen.schema.fields[:n], *(StructField(f"r{i}", f.dataType) for i, f in enumerate(found))]
    return arrow_map(chosen, run, StructType(fields)).toDF(*[name for name, _ in keep], *found.names)

"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own where none is set and all runs on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="acrelane-"))
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


#: Bits of monotonically_increasing_id that number the rows of a partition.
_ROW_BITS = (1 << 33) - 1


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """df, sorted by the given columns (nulls first) over ranges and written, with _part (the range) and _pos (the place in it, from 0).

    Rows equal in all of them stand in the order in which they are read, and may be split over ranges.
    """
    salted = df.withColumn("_row", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(*order, "_row").sortWithinPartitions(*order, "_row").drop("_row")
    return written(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("_pos")), "ranges")


def with_ordinal(df: DataFrame, order: str, name: str) -> DataFrame:
    """Numbers from 1 in order of a column without nulls or repetitions: rows are dealt to ranges, numbered there, and the rows of the ranges before
    are added, of which there is one count a range."""
    ranged = written(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df in the shared folder and read it again: lineage ends here."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by written(), when nothing reads it any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = hadoop(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's Python files to the executors, once an application: Spark's file server hands them out."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    name = Path(tempfile.mkdtemp(prefix="acrelane-")) / "acrelane.zip"
    with zipfile.ZipFile(name, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(name))
    _shipped.add(context.applicationId)

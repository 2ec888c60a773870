"""Stored tables that are merged by folders, and checks made in one scan."""

import glob
import os

from pyspark.sql import functions as F

from acrelane.operators import ingest, quality


def files(spark, table):
    return {f: os.path.getmtime(f.removeprefix("file:").replace("///", "/")) for f in spark.table(table).inputFiles()}


def test_only_touched_folders_are_written(spark):
    old = spark.range(400).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(None).cast("string").alias("updated_at"))
    old = old.unionByName(spark.createDataFrame([(None, "none", None)], "k long, v string, updated_at string"))
    ingest.create_keyed_table(old, "stored_test", ["k"], parts=32, buckets=4)
    before = files(spark, "stored_test")
    new = spark.createDataFrame([(7, "b", 2), (7, "a", 1), (900, "x", 3), (None, "y", 4)], "k long, v string, seq long")
    assert 1 <= ingest.upsert_into(new, "stored_test", ["k"], "seq", 32, F.lit("t")) <= 3
    after = files(spark, "stored_test")
    kept = {f for f in before if after.get(f) == before[f]}
    touched = {f.rpartition("/")[0] for f in after if f not in kept}
    assert len(touched) <= 3 and all(f in kept for f in before if f.rpartition("/")[0] not in touched)
    want = [(i, "old", None) for i in range(400) if i != 7] + [(None, "none", None), (7, "b", "t"), (900, "x", "t"), (None, "y", "t")]
    got = [tuple(r) for r in spark.table("stored_test").select("k", "v", "updated_at").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert ingest.upsert_into(new.limit(0), "stored_test", ["k"], "seq", 32, F.lit("t")) == 0
    assert files(spark, "stored_test") == after


def test_base_is_not_shuffled(spark):
    old = spark.range(5000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    ingest.create_keyed_table(old, "stored_plan", ["k"], parts=4, buckets=4)
    fresh = spark.range(10, 3000).select(F.col("id").alias("k"), F.lit("new").alias("v")).withColumn("_part", ingest.keyed_part(["k"], 4))
    plan = ingest.upsert_merge(spark.table("stored_plan"), fresh, ["k"])._jdf.queryExecution().sparkPlan().toString()
    executed = ingest.upsert_merge(spark.table("stored_plan"), fresh, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan
    branch = executed[: executed.index("Range")]
    assert "Bucketed: true" in branch and branch.index("FileScan") < branch.index("Exchange")


def test_suite_scans_a_table_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (-3, None)], "n long, s string")
    rows.write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    rules = {"negative": F.col("n") < 0, "no text": F.col("s").isNull()}
    suite = quality.check_suite({"x": df, "y": df.limit(0)}, {"x": rules})
    assert sorted(map(tuple, suite.collect())) == [("x", "n_rows", 3), ("x", "negative", 1), ("x", "no text", 1), ("y", "n_rows", 0)]
    assert quality.check_suite({"x": df}, {"x": rules})._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
    watched, watch = quality.observed(df, "load", rules)
    watched.write.parquet(str(tmp_path / "y"))
    assert watch.get == {"n_rows": 3, "negative": 1, "no text": 1} and glob.glob(str(tmp_path / "y" / "*.parquet"))

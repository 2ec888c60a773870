"""Large groups of one name, and flags and merges of many small ones."""

from pyspark.sql import functions as F

from acrelane.operators import entities


def test_ids_of_a_large_group(spark):
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("company_id"), F.concat(F.lit("Grain"), F.when(F.col("id") % 2 == 0, " Co.").otherwise("")).alias("name"), F.when(F.col("id") == 777, "x.example.com").alias("website"), F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("notes"))
    ids = entities.id_map(entities.propose_companies(rows))
    # no member's row searches the whole group for its base
    assert "array_min" not in ids._jdf.queryExecution().optimizedPlan().toString()
    assert ids.agg(F.count("*"), F.count_distinct("old_id"), F.min("new_id"), F.max("new_id")).first() == (n - 1, n - 1, 777, 777)
    assert ids.filter("old_id = 777").count() == 0


def test_flags_do_not_copy_rows_for_each_field(spark):
    rows = spark.createDataFrame([("a", 1, "Mill Inc.", "x", "ACTIVE", True), ("a", 2, "Mill LLC", None, "ACTIVE", True), ("b", 3, "Mill", "x", "ACTIVE", True), ("b", 4, "Mill Co.", "y", "ACTIVE", True), ("c", 5, "Mill", "x", "ACTIVE", None), ("c", 6, "Mill Co.", "x", "ACTIVE", None), ("d", 7, "Mill", " ", None, False), ("e", 8, "Mill", "x", "ACTIVE", False), ("e", 9, " Mill", "x", "ACTIVE", False)], "group_key string, facility_id long, name string, phone string, status string, geom_from_address boolean")
    flags = entities.trivial_facilities(rows)
    assert {r["group_key"]: r["trivial"] for r in flags.collect()} == {"a": True, "b": False, "c": False, "d": False, "e": False}
    assert "Expand" not in flags._jdf.queryExecution().optimizedPlan().toString()


def test_keys_of_groups_are_worked_out_once(spark):
    rows = spark.createDataFrame([(i, i // 2, "Mill", "5 County rd 4" if i % 2 else "5  county Rd 4", "Ness", "KS", "67001", "ACTIVE") for i in range(9)], "facility_id long, company_id long, name string, address string, city string, state string, postal_code string, status string")
    groups = entities.duplicate_groups(rows)
    assert sorted((r["facility_id"], r["kind"]) for r in groups.collect()) == [(i, "address") for i in range(8)]
    assert "regexp_replace" not in groups._jdf.queryExecution().optimizedPlan().toString()

"""Data-quality checks: orphans, ranges, keys, baselines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from acrelane.functions.geo import bad_latlon


def summary_union(counts: dict[str, DataFrame]) -> DataFrame:
    """(label, n): a row for each labelled frame."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n") for label, df in counts.items()]
    return reduce(DataFrame.unionByName, rows)


def orphans(tables: dict[str, DataFrame], fks: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """(label, n) of child rows whose key no parent has; fks: (child, column, parent, column).  Null keys are no orphans."""
    found = {}
    for child, column, parent, key in fks:
        own = tables[child].filter(F.col(column).isNotNull()).select(F.col(column).alias("_k"))
        found[f"{child}.{column}"] = own.join(tables[parent].select(F.col(key).alias("_k")), "_k", "left_anti")
    return summary_union(found)


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def range_check(facility: DataFrame, drift: float = 1e-4, x: str = "x", y: str = "y") -> DataFrame:
    """One row: coordinates out of range, and points that lie off by more than drift on both axes."""
    outside = (F.abs("lat") > 90) | (F.abs("lon") > 180)
    off = (F.abs(F.col(x) - F.col("lon")) > drift) & (F.abs(F.col(y) - F.col("lat")) > drift)
    return facility.agg(F.count_if(outside).alias("n_outside"), F.count_if(off).alias("n_drifted"), F.count_if(bad_latlon(F.col("lat"), F.col("lon"))).alias("n_bad"))


def baseline(tables: dict[str, DataFrame]) -> DataFrame:
    return summary_union(tables).withColumnRenamed("label", "table_name")


def baseline_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table_name, n_before, n_after, diff) of two baselines; a table that one lacks counts as 0 there."""
    a, b = old.select("table_name", F.col("n").alias("n_before")), new.select("table_name", F.col("n").alias("n_after"))
    rows = a.join(b, "table_name", "full").na.fill(0, ["n_before", "n_after"])
    return rows.withColumn("diff", F.col("n_after") - F.col("n_before"))


def import_summary(df: DataFrame, company: str, tag_col: str, tag: str) -> DataFrame:
    """One row: records, distinct companies, and records that carry the tag."""
    return df.agg(F.count("*").alias("n_records"), F.count_distinct(company).alias("n_companies"), F.count_if(F.contains(F.coalesce(tag_col, F.lit("")), F.lit(tag))).alias("n_tagged"))


def _counts(rules: dict[str, Column]) -> list[Column]:
    return [F.count("*").alias("n_rows"), *[F.count_if(c).alias(label) for label, c in rules.items()]]


def check_suite(tables: dict[str, DataFrame], rules: dict[str, dict[str, Column]]) -> DataFrame:
    """(table_name, rule, n): the rows of each table and, for each of its rules, the rows that break it (a null condition breaks none).

    Rule n_rows is the number of rows.  A table is scanned once for all its rules, with the columns they name.
    """
    out = []
    for name, df in tables.items():
        labels = ["n_rows", *rules.get(name, {})]
        one = df.agg(*_counts(rules.get(name, {})))
        pairs = F.array(*[F.struct(F.lit(label).alias("rule"), F.col(f"`{label}`").alias("n")) for label in labels])
        out.append(one.select(F.lit(name).alias("table_name"), F.inline(pairs)))
    return reduce(DataFrame.unionAll, out)


def observed(df: DataFrame, name: str, rules: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """df, and an Observation that holds n_rows and the rows that break each rule once df has been written or read: a load is checked while it is done,
    without a scan of its own."""
    watch = Observation(name)
    return df.observe(watch, *_counts(rules)), watch

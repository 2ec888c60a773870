"""Joins of survey layers with sections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrelane.functions.survey import parcel_section_key
from acrelane.functions.text import norm_join_key


def key_table(sections: DataFrame, key_cols: Sequence[str], normalised: bool) -> DataFrame:
    """(_key, feature_id): keys of sections; of several with one key the first key column and then the lowest id."""
    parts = [sections.select((norm_join_key(F.col(c)) if normalised else F.col(c)).alias("_key"), F.lit(i).alias("_i"), "feature_id") for i, c in enumerate(key_cols)]
    rows = reduce(DataFrame.unionAll, parts).filter("_key is not null and _key <> ''")
    return rows.groupBy("_key").agg(F.min(F.struct("_i", "feature_id")).alias("_x")).select("_key", F.col("_x.feature_id").alias("_feature"))


def join_sections(layer: DataFrame, sections: DataFrame, layer_key: str, key_cols: Sequence[str] = ("section_key",)) -> DataFrame:
    """layer with feature_id: the section with the same key, else with the same normalised key, else null."""
    raw = key_table(sections, key_cols, False).withColumnsRenamed({"_key": "_k1", "_feature": "_f1"})
    loose = key_table(sections, key_cols, True).withColumnsRenamed({"_key": "_k2", "_feature": "_f2"})
    out = layer.join(raw, F.col(layer_key) == F.col("_k1"), "left").join(loose, norm_join_key(F.col(layer_key)) == F.col("_k2"), "left")
    return out.withColumn("feature_id", F.coalesce("_f1", "_f2")).drop("_k1", "_f1", "_k2", "_f2")


def join_section_ids(features: DataFrame, sections: DataFrame, id_col: str) -> DataFrame:
    """features with feature_id of the section of that id, matched, and has_point."""
    known = sections.select("feature_id").distinct()
    out = features.join(known, F.col(id_col) == F.col("feature_id"), "left")
    return out.withColumns({"matched": F.col("feature_id").isNotNull(), "has_point": F.col("lon").isNotNull() & F.col("lat").isNotNull()})


def enrich_sites(sites: DataFrame, keys: DataFrame, base: DataFrame, column: str = "plss_key") -> DataFrame:
    """sites with the column from parsed keys, else from the base table."""
    a = keys.select("feature_id", F.col(column).alias("_a"))
    b = base.select("feature_id", F.col(column).alias("_b"))
    return sites.join(a, "feature_id", "left").join(b, "feature_id", "left").withColumn(column, F.coalesce("_a", "_b")).drop("_a", "_b")


def section_sites(parcels: DataFrame, sections: DataFrame) -> DataFrame:
    """(feature_id, section_key, plss_key, lon, lat, n_parcels): the mean point of a section's parcels, for sections whose key parcels have."""
    key = parcel_section_key(F.col("plss_section"), F.col("plss_township"), F.col("plss_range"))
    means = parcels.filter("lon is not null and lat is not null").groupBy(key.alias("section_key")).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count("*").alias("n_parcels"))
    known = sections.filter(F.col("label").rlike(r"^S\d+-T\d+[NS]-R\d+[EW]$")).groupBy(F.col("label").alias("section_key")).agg(F.min("feature_id").alias("feature_id"))
    return means.join(known, "section_key").withColumn("plss_key", F.regexp_replace("section_key", "-", " "))

"""The corpus pipeline: language, near-duplicates, benchmark passages, personal data, token ids.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept.  run() writes each stage's result in the
shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelane.llm import bpe, decontamination, langid, pii, simhash
from acrelane.llm.common import col, table, written


def _others(docs: DataFrame, *without: str) -> Column:
    """All columns but some in one, so that their names cannot clash with those of results."""
    return F.struct(F.lit(0).alias("_"), *[col(c) for c in docs.columns if c not in without]).alias("others")


def _as(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(text, others) with the columns of docs."""
    return rows.select(*[F.col("text") if c == "text" else F.col("others")[c].alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is identified; models are learned from a bounded sample of the labelled rows."""
    model = langid.learn(docs.filter(~langid.held_out()))
    rows = docs.select("doc_id", "text", _others(docs, "text"))
    return _as(docs, langid.identify(rows, model, keep=("others", "text")).filter(~F.col("rejected")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component: the one with the least id, null ids last, and of rows that share it the one with the least text."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("h"))
    groups = simhash.near_duplicates(docs.select(key.alias("key"), "text"), "key").select(F.col("key").alias("_key"), F.col("component_id").alias("_first"))
    kept = groups.filter(F.col("_key").eqNullSafe(F.col("_first"))).select("_key").distinct()
    chosen = docs.join(kept, key.eqNullSafe(F.col("_key")), "left_semi")
    # of rows that share id and text one stays
    return chosen.dropDuplicates(["doc_id", "text"])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by pseudonyms; n_chars follows the text."""
    rows = pii.pseudonymise(docs.select("doc_id", "text", _others(docs, "text")), keep=("others",))
    out = _as(docs, rows)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else out


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each text and decode the ids: (doc_id, n_tokens, ids_sha256, decoded_sha256, ids), the ids themselves last."""
    return bpe.round_trip_digests(docs, with_ids=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: No stage but the third can be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

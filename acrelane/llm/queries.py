"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from acrelane.llm import chat as _chat
from acrelane.llm import decontamination as _decontamination
from acrelane.llm import sql as _sql
from acrelane.llm.common import table


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acrelane.llm.packing import pack_tokens

    return pack_tokens(table(spark, sf_dir, "documents"), end_id=50256)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acrelane.llm.bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), ranks="byte_bpe_multi_50k.tiktoken")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acrelane.llm.langid import held_out, identify, learn

    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out()))
    return identify(docs, model).withColumn("held_out", held_out())


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acrelane.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k.json", limit=1024)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acrelane.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), radius=2)


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acrelane.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents"))


def op1_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acrelane.llm.paragraph_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acrelane.llm.edit_embedding import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acrelane.llm.chat import rotate_perspectives

    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op8_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acrelane.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acrelane.llm.hilbert import hilbert_shards

    return hilbert_shards(table(spark, sf_dir, "documents"), shards=24)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acrelane.llm.repair import damaged_and_repaired

    return damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acrelane.llm.trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"), shared_starts=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_paragraph_minhash": op1_paragraph_minhash,
    "op2_edit_embedding": op2_edit_embedding,
    "op3_token_packing": op3_token_packing,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_perspective_rotation": op5_perspective_rotation,
    "op8_spaced_seed_decontamination": op8_spaced_seed_decontamination,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_language_id": op7_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_hilbert_sharding": op11_hilbert_sharding,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_conversation_trie": op13_conversation_trie,
}

#: DuckDB SQL of the queries that SQL can express.
SQL: dict[str, str] = {
    "op5_perspective_rotation": _chat.SQL,
    "op8_spaced_seed_decontamination": _decontamination.SQL,
    "op11_hilbert_sharding": _sql.SHARDS,
    "op12_conversation_repair": _sql.REPAIR,
    "op13_conversation_trie": _sql.TRIE,
}

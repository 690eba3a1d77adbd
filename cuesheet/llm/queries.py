"""Queries of the training-data operators, each over its whole table, and the SQL they are checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cuesheet.llm import (
    byte_bpe, chunk_dedup, conversation_repair, decontamination, feistel, filter_audit, mixing, near_dedup,
    secret_scan, suffix_repeats, surrogates, token_counts, toxicity)
from cuesheet.session import scratch_path
from cuesheet.sources.tables import read_table


PIECES = "piece_bpe_32k.model"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_guess_cost_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.find_secrets(read_table(spark, sf, "documents"), secret_scan.model_words(public_tokenizers.path(PIECES)))


def op2_digest_cache_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Starts from an empty cache: every distinct text is encoded."""
    return token_counts.token_counts(read_table(spark, sf, "documents"), public_tokenizers.path(PIECES),
                                     scratch_path(spark, "token-cache"))


def op3_personal_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    return surrogates.replace_personal_data(read_table(spark, sf, "documents"))


def op4_feistel_shards(spark: SparkSession, sf: str) -> DataFrame:
    return feistel.shard_documents(read_table(spark, sf, "documents"))


def op5_chunk_recipes(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_dedup.exact_duplicates(read_table(spark, sf, "documents"))


def op6_repeat_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_repeats.remove_repeats(read_table(spark, sf, "documents"))


def op7_hyperminhash_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf, "documents"))


def op8_subword_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxic_scores(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


def op9_latent_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contaminated(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


def op10_temperature_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed_plan(read_table(spark, sf, "documents"))


def op11_merge_fold_bpe(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = byte_bpe.Vocabulary.load(public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
    return byte_bpe.round_trip(read_table(spark, sf, "documents"), vocabulary)


def op12_prefix_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit_documents(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


def op13_bounded_repair(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_repair.repair_digests(conversation_repair.damaged(read_table(spark, sf, "conversations")))


QUERIES = {
    "op1_guess_cost_secrets": op1_guess_cost_secrets,
    "op2_digest_cache_counts": op2_digest_cache_counts,
    "op3_personal_surrogates": op3_personal_surrogates,
    "op4_feistel_shards": op4_feistel_shards,
    "op5_chunk_recipes": op5_chunk_recipes,
    "op6_repeat_intervals": op6_repeat_intervals,
    "op7_hyperminhash_groups": op7_hyperminhash_groups,
    "op8_subword_toxicity": op8_subword_toxicity,
    "op9_latent_leaks": op9_latent_leaks,
    "op10_temperature_mixture": op10_temperature_mixture,
    "op11_merge_fold_bpe": op11_merge_fold_bpe,
    "op12_prefix_audit": op12_prefix_audit,
    "op13_bounded_repair": op13_bounded_repair,
}

ORACLES = {
    "op4_feistel_shards": feistel.shard_sql(),
    "op5_chunk_recipes": chunk_dedup.exact_sql(),
    "op10_temperature_mixture": mixing.plan_sql(),
    "op12_prefix_audit": filter_audit.audit_sql(),
}

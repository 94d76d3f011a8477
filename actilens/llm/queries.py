"""Registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from actilens.llm import (
    conversations, decontaminate, duplicate_spans, importance, language, lm_scores, minhash, mixing, packing, quality, simhash, token_counts, token_files,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_minhash_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.edited_rows(_table(spark, folder, "documents"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.written_rows(_table(spark, folder, "documents"))


def op4_language_codes(spark: SparkSession, folder: str) -> DataFrame:
    return language.predicted_rows(_table(spark, folder, "documents"))


def op5_byte_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scored_rows(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_pfair_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.schedule_rows(_table(spark, folder, "documents"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.counted_rows(_table(spark, folder, "documents"))


def op8_backoff_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores.scored_rows(_table(spark, folder, "documents"))


def op9_duplicate_spans(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_spans.digest_rows(_table(spark, folder, "documents"))


def op10_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.digest_rows(_table(spark, folder, "documents"))


def op11_hierarchical_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_rows(_table(spark, folder, "documents"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.damaged_rows(_table(spark, folder, "conversations"))


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.drawn_rows(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_minhash_fingerprints, op2_decontamination, op3_token_files, op4_language_codes, op5_byte_quality, op6_pfair_mixing, op7_token_counts,
        op8_backoff_scores, op9_duplicate_spans, op10_simhash_groups, op11_hierarchical_packing, op12_conversation_repair, op13_importance_resampling,
    )
    return {f.__name__: f for f in made}


def oracles() -> dict[str, str]:
    return {"op6_pfair_mixing": mixing.SCHEDULE_SQL}

"""The operators' queries over their whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import chat, decontaminate, exact_dedup, jaccard, lm, merkle, mixing, negatives, pii, quality, simhash, tokens, toxicity
from .common import small_batches


def op1_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return tokens.attribute(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return lm.scores(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return chat.digests(chat.format_conversations(chat.with_forged(table(spark, sf_dir, "conversations"))))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered())


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.taking_part(table(spark, sf_dir, "embeddings")))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.fingerprinted(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_attribution, op2_pii, op3_context_tree_scores, op4_quality, op5_exact_dedup, op6_mixing, op7_toxicity, op8_chat_formatting, op9_jaccard_join, op10_decontamination, op11_merkle_manifest, op12_hard_negatives, op13_fingerprints)}
ORACLES: dict[str, str] = {"op5_exact_dedup": exact_dedup.ORACLE, "op6_mixing": mixing.ORACLE, "op8_chat_formatting": chat.ORACLE, "op9_jaccard_join": jaccard.ORACLE, "op10_decontamination": decontaminate.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_hard_negatives": negatives.ORACLE}

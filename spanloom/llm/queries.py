"""Queries of the problems on language-model text, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import conversations, langid, leakage, mixing, pairs, pii
from spanloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found(table(spark, d, "traces"))


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every label above its cutoff, with its posterior."""
    return pairs.labelled(table(spark, d, "traces")).select("delivery_id", F.explode("labels").alias("x")).select("delivery_id", "x.defect", F.round("x.posterior", 6).alias("posterior"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.found(table(spark, d, "session_log"))


def p3_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "session_log"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "traces"), table(spark, d, "session_log"))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its details replaced by typed placeholders."""
    return pii.redact(table(spark, d, "traces"), table(spark, d, "session_log"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached beside their targets."""
    return mixing.draw(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_draw(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix and how often each appears."""
    return mixing.draw(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.found(table(spark, d, "documents"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of one language with its confidence."""
    return langid.segments(table(spark, d, "documents")).drop("label")


QUERIES = {
    "p1_found": p1_found, "p1_labels": p1_labels, "p3_found": p3_found, "p3_conversations": p3_conversations, "p6_found": p6_found, "p6_redacted": p6_redacted, "p8_found": p8_found,
    "p9_draw": p9_draw, "p9_shares": p9_shares, "p10_found": p10_found, "p10_segments": p10_segments,
}

ORACLE: dict[str, str] = {}

"""Dimension tables, all of a few rows and safe to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Key, kind, on by default, aggregation, lower is better, has reasoning.
METRICS = (
    ("wer", "deterministic", True, "pooled", True, False),
    ("cer", "deterministic", True, "pooled", True, False),
    ("intent_entity", "llm", True, "mean", False, True),
    ("llm_wer", "llm", True, "pooled", True, True),
    ("llm_cer", "llm", True, "pooled", True, True),
    ("semantic_wer", "llm", True, "pooled", True, True),
    ("critical_fields", "llm", False, "pooled", False, True),
    ("semantic_match", "llm", False, "mean", False, True),
)

#: List rates in USD a minute. Other providers cost 0.
RATES = (("deepgram", 0.0043), ("openai", 0.0060), ("google", 0.0160), ("sarvam", 0.0050), ("elevenlabs", 0.0067), ("mock", 0.0))

#: Reading levels, and error-rate bands as [low, high).
LEVELS = ("Beginner", "Letter", "Word", "Paragraph", "Story")
BANDS = (("exact match", 0.0, 0.0001), ("near match", 0.0001, 0.10), ("diverging", 0.10, 0.30), ("poor", 0.30, 1.01))

#: Signal thresholds of the error rate, the semantic error and the meaning score.
WER_LIMIT, SEMANTIC_ERROR_LIMIT, MEANING_SCORE_LIMIT = 0.25, 0.15, 0.80

#: Share of the weight that each tier of a use-case plan gets.
TIER_SHARES = (("primary", 0.60), ("secondary", 0.25), ("baseline", 0.15))


def metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(METRICS), "metric string, kind string, default_on boolean, aggregation string, lower_is_better boolean, has_reasoning boolean")


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RATES), "provider string, rate_usd_per_minute double")


def bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *b) for k, b in enumerate(BANDS)], "band_order int, band string, low double, high double")


def levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LEVELS)), "level int, name string")

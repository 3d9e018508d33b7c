"""Judging in stages: which results the judge gets, what the others are marked with, progress and the judge's cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonorant.operators.results import band, sampling_plan, value

#: An entry of `metrics` that holds nothing.
NO_ENTRY = "named_struct('value', CAST(NULL AS DOUBLE), 'error', CAST(NULL AS STRING), 'errors', CAST(NULL AS DOUBLE), 'length', CAST(NULL AS DOUBLE))"


def judge_stage(results: DataFrame, judged: Sequence[str], rate: float, least: int, seed: int) -> DataFrame:
    """The ok results that lack a value of one of the judged metrics, with `selected`: those that the plan samples, by bands of
    the error rate, go to the judge. The others are marked: every judged metric is emptied, also one that had a value, and
    `sampled` is false. Without judged metrics nothing is staged."""
    lacking = F.lit(False)
    for m in judged:
        lacking = lacking | value(m).isNull()
    key = F.concat_ws("|", "run_id", "clip_id", "provider").alias("key")
    rows = results.where((F.col("status") == "ok") & lacking).select("*", key, band(value("wer")).alias("band"))
    emptied = F.map_concat(F.map_filter("metrics", lambda k, _: ~k.isin(*judged)), F.create_map(*(x for m in judged for x in (F.lit(m), F.expr(NO_ENTRY))))) if judged else F.col("metrics")
    plan = sampling_plan(rows, rate, least, seed)
    return plan.withColumn("metrics", F.when(F.col("selected"), F.col("metrics")).otherwise(emptied)).withColumn("sampled", F.col("selected") & F.col("sampled"))


def isolated(results: DataFrame) -> DataFrame:
    """A failure of `llm_wer` counts for `llm_cer` too, which is computed from the same verdicts; other metrics keep theirs."""
    failed = F.try_element_at("metrics", F.lit("llm_wer"))["error"]
    copied = F.expr("named_struct('value', CAST(NULL AS DOUBLE), 'error', metrics['llm_wer'].error, 'errors', CAST(NULL AS DOUBLE), 'length', CAST(NULL AS DOUBLE))")
    changed = F.transform_values("metrics", lambda k, v: F.when(k == "llm_cer", copied).otherwise(v))
    return results.withColumn("metrics", F.when(F.coalesce(failed, F.lit("")) != "", changed).otherwise(F.col("metrics")))


def progress(counts: DataFrame) -> DataFrame:
    """counts (transcribed, skipped, scored, total, to_score) with fraction: the work done of all, 1 at most and over no work."""
    units = F.col("total") + F.col("to_score")
    done = (F.col("transcribed") + F.col("skipped") + F.col("scored")) / F.nullif(units, F.lit(0))
    return counts.withColumn("fraction", F.coalesce(F.least(F.lit(1.0), done), F.lit(1.0)))


def judge_usage(calls: DataFrame, prices: DataFrame, by: str = "model") -> DataFrame:
    """calls (by, input_tokens, output_tokens, cost), prices (by, input_rate, output_rate: USD a million tokens; a dimension) ->
    sums and cost_usd: what the provider reported where that is not 0, else by the rates, 0 without rates."""
    used = calls.groupBy(by).agg(
        F.count("*").alias("calls"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.sum(F.coalesce("cost", F.lit(0.0))).alias("reported"),
    )
    rated = (F.col("input_tokens") * F.coalesce("input_rate", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("output_rate", F.lit(0.0))) / 1e6
    cost = F.when(F.col("reported") != 0, F.col("reported")).otherwise(rated)
    return used.join(prices, by, "left").select(by, "calls", "input_tokens", "output_tokens", cost.alias("cost_usd"))


def band_description(counts: DataFrame) -> DataFrame:
    """One row: `name: sampled/total` of the bands that hold anything, in the order of the bands."""
    from sonorant.dims import BANDS

    order = F.create_map(*(F.lit(x) for k, b in enumerate(BANDS) for x in (b[0], k)))
    text = F.format_string("%s: %d/%d", "band", "sampled", "total")
    parts = F.array_sort(F.collect_list(F.struct(order[F.col("band")].alias("o"), text.alias("t"))))
    return counts.where("total > 0").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " · ").alias("description"))

"""The use-case layer: category accuracy, plan weights, weighted scores and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonorant.dims import METRICS, TIER_SHARES

#: Metrics of which less is better.
ERROR_METRICS = {m[0] for m in METRICS if m[4]}

#: The accuracy metric that each critical-field type counts for. Other types count for entities.
GROUPS = {"number": "number_accuracy", "amount": "number_accuracy", "date": "date_accuracy", "time": "date_accuracy"}


def field_group(kind: Column) -> Column:
    out = F.lit("entity_accuracy")
    for k, g in GROUPS.items():
        out = F.when(kind == k, g).otherwise(out)
    return out


def category_accuracy(fields: DataFrame, by: str = "provider") -> DataFrame:
    """fields (by, category, preserved) -> the share preserved and the fields lost of each group; absent groups are absent."""
    return fields.groupBy(by, "category").agg(F.avg(F.col("preserved").cast("double")).alias("accuracy"), F.count_if(~F.col("preserved")).cast("long").alias("lost"), F.count("*").alias("fields"))


def plan_weights(plan: DataFrame, by: list[str] | None = None) -> DataFrame:
    """plan (metric, tier, any `by`) with weight: a tier's share over its members, critical_fields at 0, then scaled to sum to 1
    over the plan. A plan has a handful of rows."""
    by = by or []
    share = F.create_map(*(F.lit(x) for t in TIER_SHARES for x in t))
    counts = F.col("metric") != "critical_fields"
    members = F.sum(F.when(counts, 1).otherwise(0)).over(Window.partitionBy(*by, "tier"))
    raw = plan.withColumn("w", F.when(counts, share[F.col("tier")] / members).otherwise(0.0))
    return raw.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy(*by))).drop("w")


def goodness(metric: str, value: Column) -> Column:
    """A metric's value where more is better: error metrics count as what is left of 1, at least 0."""
    return F.greatest(F.lit(0.0), 1 - value) if metric in ERROR_METRICS else value


def scores(values: DataFrame, plan: DataFrame, by: list[str]) -> DataFrame:
    """values (by, metric, value), one row for each metric -> score, the weighted mean of the goodness of the plan's metrics of
    positive weight that have a value, 0 over nothing, and missing, those that have none. The plan is a handful of rows, so it
    becomes columns of one aggregation."""
    asked = sorted((r.metric, r.weight) for r in plan.where("weight > 0").select("metric", "weight").collect())
    held = values.groupBy(*by).agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"m_{k}") for k, (m, _) in enumerate(asked)))
    total, weight = F.lit(0.0), F.lit(0.0)
    for k, (m, w) in enumerate(asked):
        have = F.col(f"m_{k}").isNotNull()
        total, weight = total + F.when(have, goodness(m, F.col(f"m_{k}")) * w).otherwise(0.0), weight + F.when(have, w).otherwise(0.0)
    missing = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(F.col(f"m_{k}").isNull(), F.lit(m)) for k, (m, _) in enumerate(asked))))
    return held.select(*by, F.when(weight > 0, total / weight).otherwise(0.0).alias("score"), F.array_join(missing, ",").alias("missing"))


def dataset_scores(rows: DataFrame) -> DataFrame:
    """rows (provider, clip_id, score, lost: how many fields) -> each provider's clips, mean score and fields lost in all."""
    return rows.groupBy("provider").agg(F.count("*").alias("clips"), F.avg("score").alias("score"), F.sum("lost").alias("lost"))


def worst_clip(rows: DataFrame) -> DataFrame:
    """rows (provider, clip_id, score) -> each provider's clip of the least score, ties by clip."""
    return rows.groupBy("provider").agg(F.min_by("clip_id", F.struct("score", "clip_id")).alias("clip_id"), F.min("score").alias("score"))


def comparison(values: DataFrame, providers: list[str]) -> DataFrame:
    """values (metric, provider, value) as a table of metrics by providers."""
    return values.groupBy("metric").pivot("provider", providers).agg(F.first("value"))


def podium(values: DataFrame) -> DataFrame:
    """values (metric, provider, value), one row for each pair -> each metric's winner, its runner-up (null without one) and the
    lead, by goodness, ties by name. Two small aggregations over one row for each provider."""
    good = F.when(F.col("metric").isin(*ERROR_METRICS), F.greatest(F.lit(0.0), 1 - F.col("value"))).otherwise(F.col("value"))
    best = F.array_sort(F.collect_list(F.struct((-good).alias("v"), "provider")))
    by = values.where("value IS NOT NULL").groupBy("metric").agg(best.alias("b"))
    first, second = F.get("b", F.lit(0)), F.get("b", F.lit(1))
    return by.select("metric", first["provider"].alias("winner"), second["provider"].alias("runner_up"), (second["v"] - first["v"]).alias("lead"))

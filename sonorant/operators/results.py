"""Operators over results, a row for each (run, clip, provider) version.

Results have run_id, clip_id, provider, status, latency_seconds, duration_seconds, sampled and `metrics`, a map from a metric
to struct(value, error, errors, length)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonorant import dims

MEANING_SCORES, MEANING_ERRORS = ("intent_entity", "semantic_match"), ("semantic_wer", "llm_wer")


def value(metric: str) -> Column:
    return F.try_element_at("metrics", F.lit(metric))["value"]


def newness(rows: DataFrame, version: Sequence[str]) -> Column:
    """What the newest row of a key is the largest in: the version columns, nulls oldest, then a hash of the row, so that rows of
    one version have an order of their own, the same on every run."""
    hashed = (F.map_entries(c) if t.startswith("map<") else F.col(c) for c, t in rows.dtypes)
    return F.struct(*version, F.xxhash64(*hashed))


def latest(results: DataFrame, keys: Sequence[str] = ("run_id", "clip_id", "provider"), version: str | Sequence[str] = "updated_at") -> DataFrame:
    """One row for each key: the newest version. A null version is the oldest; of rows that share a version one stays, so a row
    that is written twice is read once. One scan and one aggregation that combines before the shuffle, so a key with many versions
    costs a row for each task. Columns that aren't selected before are carried along."""
    rest = [c for c in results.columns if c not in keys]
    picked = results.groupBy(*keys).agg(F.max_by(F.struct(*rest), newness(results, [version] if isinstance(version, str) else version)).alias("r"))
    return picked.select(*keys, "r.*").select(*results.columns)


def latest_run(runs: DataFrame, version: str | Sequence[str] = "updated_at") -> DataFrame:
    """The newest attributes of each run, with the creation time that it first had."""
    rest = [c for c in runs.columns if c not in ("run_id", "created_at")]
    picked = runs.groupBy("run_id").agg(F.max_by(F.struct(*rest), newness(runs, [version] if isinstance(version, str) else version)).alias("r"), F.min("created_at").alias("created_at"))
    return picked.select("run_id", "created_at", "r.*")


def complete(required: Sequence[str]) -> Column:
    """Whether a result is ok and has a value for each of the metrics."""
    out = F.col("status") == "ok"
    for m in required:
        out = out & value(m).isNotNull()
    return F.coalesce(out, F.lit(False))


def pending(clips: DataFrame, providers: DataFrame, results: DataFrame, required: Sequence[str]) -> DataFrame:
    """The (clip_id, provider) pairs that a run still owes: all pairs, less those complete. `providers` is a dimension."""
    done = results.where(complete(required)).select("clip_id", "provider")
    return clips.select("clip_id").crossJoin(F.broadcast(providers.select("provider"))).join(done, ["clip_id", "provider"], "left_anti")


def metric_rows(results: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """A row for each metric of each ok result: the keys, metric and the fields of its struct. Metrics without a
    specification are dropped."""
    keep = metrics or [m[0] for m in dims.METRICS]
    rows = results.where("status = 'ok'").select("run_id", "clip_id", "provider", F.explode("metrics").alias("metric", "m"))
    return rows.where(F.col("metric").isin(list(keep))).select("run_id", "clip_id", "provider", "metric", "m.*")


def pooled(rows: DataFrame, by: Sequence[str] = ("provider", "metric")) -> DataFrame:
    """Of metric rows: the pooled or mean value of each group, and how many rows have an error. Pooled metrics are summed
    errors over summed length, null where the length is 0; those without a length, and mean metrics, are averaged, and
    where a group has both the mean stands."""
    spec = F.broadcast(dims.metrics(rows.sparkSession).select("metric", "aggregation"))
    r = rows.join(spec, "metric")
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    good = ~failed & F.col("value").isNotNull()
    pool = good & (F.col("aggregation") == "pooled") & F.col("length").isNotNull()
    out = r.groupBy(*by).agg(
        F.sum(F.when(pool, F.coalesce("errors", F.lit(0.0)))).alias("errors"),
        F.sum(F.when(pool, F.col("length"))).alias("length"),
        F.avg(F.when(good & ~pool, F.col("value"))).alias("mean"),
        F.count_if(failed).cast("long").alias("metric_errors"),
        F.count_if(good).cast("long").alias("n"),
    )
    rate = F.when(F.col("length") > 0, F.col("errors") / F.col("length"))
    return out.select(*by, F.coalesce("mean", rate).alias("value"), "metric_errors", "n")


#: Of the rows of a group, about this share lies between the two guesses at a percentile.
NEAR_RANK = 1e-3


def nearest_rank(values: DataFrame, by: Sequence[str], column: str, shares: Sequence[tuple[str, float]] = (("p50", 0.50), ("p95", 0.95), ("p99", 0.99))) -> DataFrame:
    """Nearest-rank percentiles: of n ascending values the one at round_half_even(share * n + 0.5), at least the first and at
    most the last. Two guesses that enclose a rank come from a sketch of the group, which is combined before the shuffle; values
    below them are only counted, and a window ranks the distinct values between them. Where the sketch's error bound were
    broken the result would be null, not wrong."""
    name = [n for n, _ in shares]
    some = values.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("v"))
    guesses = [F.lit(min(max(f + d, 0.0), 1.0)) for _, f in shares for d in (-NEAR_RANK / 2, NEAR_RANK / 2)]
    enclosed = some.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("v", F.array(*guesses), F.lit(round(8 / NEAR_RANK))).alias("q"))
    sides = F.array(*(F.struct(F.lit(n).alias("share"), F.greatest(F.lit(1), F.least(F.col("n"), F.bround(F.lit(f) * F.col("n") + 0.5, 0).cast("long"))).alias("k"), F.get("q", F.lit(2 * i)).alias("lo"), F.get("q", F.lit(2 * i + 1)).alias("hi")) for i, (n, f) in enumerate(shares)))
    # Group by group a handful of bounds; a value below a rank's bounds counts at the lower one, so that it moves as a count.
    placed = some.join(enclosed.select(*by, sides.alias("s")), list(by)).select(*by, "v", F.explode("s").alias("s")).where("v <= s.hi")
    counted = placed.groupBy(*by, "s.share", "s.k", F.when(F.col("v") >= F.col("s.lo"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "share").orderBy(F.col("v").asc_nulls_first()))
    found = counted.withColumn("upto", upto).where("upto >= k").groupBy(*by).pivot("share", name).agg(F.min("v"))
    return enclosed.select(*by).join(found, list(by), "left")


def provider_counts(results: DataFrame) -> DataFrame:
    """provider, clips_scored, clips_failed, audio_minutes, pooled real-time factor and estimated cost."""
    ok = F.col("status") == "ok"
    timed = ok & F.col("latency_seconds").isNotNull() & (F.coalesce("duration_seconds", F.lit(0.0)) != 0)
    out = results.groupBy("provider").agg(
        F.count_if(ok).cast("long").alias("clips_scored"),
        F.count_if(~ok).cast("long").alias("clips_failed"),
        (F.coalesce(F.sum(F.when(ok, F.coalesce("duration_seconds", F.lit(0.0)))), F.lit(0.0)) / 60).alias("audio_minutes"),
        F.sum(F.when(timed, F.col("latency_seconds"))).alias("l"),
        F.sum(F.when(timed, F.col("duration_seconds"))).alias("d"),
    )
    out = out.withColumn("rtf", F.when(F.col("d") > 0, F.col("l") / F.col("d"))).drop("l", "d")
    rate = F.broadcast(dims.rates(results.sparkSession))
    return out.join(rate, "provider", "left").withColumn("cost_usd", F.col("audio_minutes") * F.coalesce("rate_usd_per_minute", F.lit(0.0))).drop("rate_usd_per_minute")


def ranked(summary: DataFrame, metric: str, tie: str = "provider") -> DataFrame:
    """summary, a row for each provider, with rank: best first by the metric's own direction, nulls last, ties by `tie`."""
    lower = next((m[4] for m in dims.METRICS if m[0] == metric), True)
    key = F.col(metric).asc_nulls_last() if lower else F.col(metric).desc_nulls_last()
    return summary.withColumn("rank", F.row_number().over(Window.orderBy(key, tie)).cast("long"))


def leaderboard(results: DataFrame, metric: str = "wer") -> DataFrame:
    """Of the latest results: counts, minutes, cost, the pooled metric, latency percentiles, real-time factor and rank of
    each provider. Ties rank by the provider's first clip."""
    rows = pooled(metric_rows(results, [metric])).select("provider", F.col("value").alias(metric))
    times = nearest_rank(results.where("status = 'ok'"), ["provider"], "latency_seconds")
    seen = results.groupBy("provider").agg(F.min("clip_id").alias("first_clip"))
    out = provider_counts(results).join(rows, "provider", "left").join(times, "provider", "left").join(seen, "provider")
    lower = next((m[4] for m in dims.METRICS if m[0] == metric), True)
    key = F.col(metric).asc_nulls_last() if lower else F.col(metric).desc_nulls_last()
    return out.withColumn("rank", F.row_number().over(Window.orderBy(key, "first_clip", "provider")).cast("long")).drop("first_clip")


def leaderboard_rows(board: DataFrame, metric: str = "wer") -> DataFrame:
    """A leaderboard as it is shown: minutes, latencies and the real-time factor to 3 places, costs and the metric to 4."""
    places = {"audio_minutes": 3, "cost_usd": 4, metric: 4} | {c: 3 for c in ("rtf", "p50", "p95", "p99")}
    return board.withColumns({c: F.round(c, n) for c, n in places.items()})


def winners(values: DataFrame) -> DataFrame:
    """Of (provider, metric, value): the best provider of each metric, ties by name. min_by keeps one candidate for each task."""
    spec = F.broadcast(dims.metrics(values.sparkSession).select("metric", "lower_is_better"))
    signed = values.where("value IS NOT NULL").join(spec, "metric", "left").withColumn("v", F.when(F.coalesce("lower_is_better", F.lit(True)), F.col("value")).otherwise(-F.col("value")))
    return signed.groupBy("metric").agg(F.min_by("provider", F.struct("v", "provider")).alias("provider"))


def clip_rows(results: DataFrame, metrics: Sequence[str], places: int = 3) -> DataFrame:
    """One flat row for each result: durations and times to `places`, metrics to 4; the real-time factor is null where either
    part is null or 0."""
    latency, duration = F.col("latency_seconds"), F.col("duration_seconds")
    both = (F.coalesce(latency, F.lit(0.0)) != 0) & (F.coalesce(duration, F.lit(0.0)) != 0)
    cols = [F.round(value(m), 4).alias(m) for m in metrics]
    errors = [F.try_element_at("metrics", F.lit(m))["error"].alias(f"{m}_error") for m in metrics]
    return results.select(
        F.col("clip_id").alias("id"), "provider", "status", F.round(F.coalesce(duration, F.lit(0.0)), places).alias("audio_duration_seconds"),
        F.round(latency, places).alias("latency_seconds"), F.round(F.when(both, latency / duration), places).alias("rtf"), *cols, *errors,
    )


def band(wer: Column) -> Column:
    """The error-rate band's name: null is unknown, and what no band holds is poor."""
    out = F.when(wer.isNull(), "unknown")
    for name, low, high in dims.BANDS:
        out = out.when((wer >= low) & (wer < high), name)
    return out.otherwise("poor")


def sampling_plan(rows: DataFrame, rate: float, least: int, seed: int) -> DataFrame:
    """rows (key, band) with `selected`: in each band the first max(least, round_half_even(n * rate)) by md5 of the seed and the
    key, at most n; a rate of 1 or more selects all. The order depends on seed and key alone, not on partitions.

    A band is never one task's: a histogram of the order's first four digits, 65,536 counts for a band, gives how many rows come
    before each range, and ranks are counted within a range."""
    if rate >= 1:
        return rows.withColumn("selected", F.lit(True))
    placed = rows.withColumn("s_order", F.md5(F.concat(F.lit(f"{seed}|"), F.col("key")))).withColumn("s_range", F.substring("s_order", 1, 4))
    ranges = placed.groupBy("band", "s_range").agg(F.count("*").alias("s_count"))
    before = Window.partitionBy("band").orderBy("s_range").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("s_count").over(Window.partitionBy("band"))
    k = F.least(n, F.greatest(F.lit(least), F.bround(n * F.lit(rate), 0).cast("long")))
    left = ranges.select(F.col("band").alias("s_band"), F.col("s_range").alias("s_of"), (k - F.coalesce(F.sum("s_count").over(before), F.lit(0))).alias("s_left"))
    ranked = placed.withColumn("s_rank", F.row_number().over(Window.partitionBy("band", "s_range").orderBy("s_order", "key")))
    out = ranked.join(left, F.col("band").eqNullSafe(F.col("s_band")) & (F.col("s_range") == F.col("s_of")))
    return out.select(*rows.columns, (F.col("s_rank") <= F.col("s_left")).alias("selected"))


def band_counts(plan: DataFrame) -> DataFrame:
    """band, sampled, total for each of the four bands, empty ones included, unknown left out."""
    counts = plan.groupBy("band").agg(F.count_if("selected").alias("sampled"), F.count("*").alias("total"))
    return F.broadcast(dims.bands(plan.sparkSession)).select("band", "band_order").join(counts, "band", "left").select("band", F.coalesce("sampled", F.lit(0)).cast("long").alias("sampled"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def verdict() -> Column:
    """struct(preserved, decided_by): the first meaning metric with a value decides, scores before errors."""
    checks = [F.when(value(m).isNotNull(), F.struct((value(m) >= 0.5).alias("preserved"), F.lit(m).alias("decided_by"))) for m in MEANING_SCORES]
    checks += [F.when(value(m).isNotNull(), F.struct((value(m) <= 0.30).alias("preserved"), F.lit(m).alias("decided_by"))) for m in MEANING_ERRORS]
    return F.coalesce(*checks)


def divergences(results: DataFrame, limit: float = dims.WER_LIMIT) -> DataFrame:
    """Ok results whose wording and meaning disagree: kind meaning_broken or wording_only, with place, the order by error
    rate within the kind (ascending for the first, descending for the second)."""
    r = results.where("status = 'ok'").select("clip_id", "provider", value("wer").alias("wer"), verdict().alias("v")).where("wer IS NOT NULL AND v IS NOT NULL")
    kind = F.when((F.col("wer") <= limit) & ~F.col("v.preserved"), "meaning_broken").when((F.col("wer") > limit) & F.col("v.preserved"), "wording_only")
    return r.select("clip_id", "provider", "wer", F.col("v.decided_by").alias("decided_by"), kind.alias("kind")).where("kind IS NOT NULL")


def threshold_signals(results: DataFrame) -> DataFrame:
    """(severity, severity_order, provider, signal, amount), a row for each signal: the two divergences over all providers,
    and each provider's pooled metrics and failures beyond their limits."""
    d = divergences(results).groupBy("kind").agg(F.count("*").cast("double").alias("amount"))
    over_all = d.select(F.when(F.col("kind") == "meaning_broken", "critical").otherwise("info").alias("severity"), F.lit("").alias("provider"), F.col("kind").alias("signal"), "amount")
    v = pooled(metric_rows(results)).select("provider", "metric", "value").where("value IS NOT NULL")
    high = F.when(F.col("metric") == "wer", F.col("value") > dims.WER_LIMIT).when(F.col("metric").isin(*MEANING_ERRORS), F.col("value") > dims.SEMANTIC_ERROR_LIMIT).when(F.col("metric").isin(*MEANING_SCORES), F.col("value") < dims.MEANING_SCORE_LIMIT)
    limits = v.where(high).select(F.lit("warning").alias("severity"), "provider", F.col("metric").alias("signal"), F.col("value").alias("amount"))
    failed = results.groupBy("provider").agg(F.count_if(F.col("status") != "ok").cast("double").alias("amount")).where("amount > 0")
    failed = failed.select(F.lit("warning").alias("severity"), "provider", F.lit("clips_failed").alias("signal"), "amount")
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2).cast("long")
    return over_all.unionByName(limits).unionByName(failed).withColumn("severity_order", order)


def coverage(results: DataFrame) -> DataFrame:
    """One row: judged, sampled ok results with a meaning metric, and total, all ok results."""
    some = F.lit(False)
    for m in (*MEANING_SCORES, *MEANING_ERRORS):
        some = some | value(m).isNotNull()
    ok = F.col("status") == "ok"
    return results.agg(F.count_if(ok & F.col("sampled") & some).cast("long").alias("judged"), F.count_if(ok).cast("long").alias("total"))

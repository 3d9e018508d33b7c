"""Queries over result versions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.operators import results as ops
from sonorant.queries.registry import query, rounded
from sonorant.sources import views
from sonorant.streaming import latency, utterances

RESULTS = """raw AS (
  SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
), v AS (
  SELECT 'run' || (user_id % 3) AS run_id, 'clip' || (event_id // 40) AS clip_id, event_type AS provider,
    CASE WHEN event_id % 17 = 0 THEN 'failed' ELSE 'ok' END AS status, value / 100 AS latency_seconds,
    CAST(CASE WHEN event_id % 97 = 0 THEN 0 ELSE 1 + event_id % 30 END AS DOUBLE) AS duration_seconds,
    event_id % 4 <> 0 AS sampled, CAST(k % 7 AS DOUBLE) AS wer_errors,
    CAST(CASE WHEN event_id % 53 = 0 THEN 0 ELSE 5 + k % 20 END AS DOUBLE) AS wer_length,
    CASE WHEN event_id % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS semantic_match, event_id AS updated_at
  FROM raw
), r AS (
  SELECT *, CASE WHEN wer_length = 0 THEN (CASE WHEN wer_errors = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) ELSE wer_errors / wer_length END AS wer
  FROM v QUALIFY row_number() OVER (PARTITION BY run_id, clip_id, provider ORDER BY updated_at DESC) = 1
)"""

RANK = "list_sort(list(latency_seconds))[CAST(greatest(1, least(count(*), round_even({f} * count(*) + 0.5, 0))) AS INT)]"
TIMES = "times AS (SELECT provider, " + ", ".join(f"{RANK.format(f=f)} AS {n}" for n, f in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + " FROM r WHERE status = 'ok' AND latency_seconds IS NOT NULL GROUP BY provider)"
COUNTS = """counts AS (
  SELECT provider, count(*) FILTER (status = 'ok') AS clips_scored, count(*) FILTER (status <> 'ok') AS clips_failed,
    coalesce(sum(duration_seconds) FILTER (status = 'ok'), 0) / 60 AS audio_minutes,
    sum(latency_seconds) FILTER (status = 'ok' AND duration_seconds <> 0) / nullif(sum(duration_seconds) FILTER (status = 'ok' AND duration_seconds <> 0), 0) AS rtf
  FROM r GROUP BY provider)"""
POOLED = """pooled AS (
  SELECT provider, 'wer' AS metric, CASE WHEN sum(wer_length) > 0 THEN sum(wer_errors) / sum(wer_length) END AS value, count(*) AS n FROM r WHERE status = 'ok' GROUP BY provider
  UNION ALL
  SELECT provider, 'semantic_match', avg(semantic_match), count(semantic_match) FROM r WHERE status = 'ok' GROUP BY provider)"""


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.latest_results(spark, sf_dir)


@query(f"""WITH {RESULTS}, {TIMES}, {COUNTS}, {POOLED}, first_clip AS (SELECT provider, min(clip_id) AS c FROM r GROUP BY provider)
SELECT provider, clips_scored, clips_failed, round(audio_minutes, 6) AS audio_minutes, round(rtf, 6) AS rtf, 0.0::DOUBLE AS cost_usd, round(value, 6) AS wer,
  round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, row_number() OVER (ORDER BY value NULLS LAST, c, provider) AS rank
FROM counts LEFT JOIN (SELECT provider, value FROM pooled WHERE metric = 'wer') USING (provider) LEFT JOIN times USING (provider) JOIN first_clip USING (provider)""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.leaderboard(read(spark, sf_dir)))


@query(f"WITH {RESULTS} SELECT run_id, clip_id, provider, status, updated_at, round(wer, 6) AS wer FROM r")
def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(read(spark, sf_dir).select("run_id", "clip_id", "provider", "status", "updated_at", ops.value("wer").alias("wer")))


@query(f"""WITH {RESULTS}, clips AS (SELECT DISTINCT 'clip' || (event_id // 40) AS clip_id FROM events), providers AS (SELECT DISTINCT provider FROM r)
SELECT clip_id, provider FROM clips CROSS JOIN providers
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.clip_id = clips.clip_id AND r.provider = providers.provider AND status = 'ok' AND semantic_match IS NOT NULL AND run_id = 'run0')""")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir)
    clips = views.results(spark, sf_dir).select("clip_id").distinct()
    return ops.pending(clips, r.select("provider").distinct(), r.where("run_id = 'run0'"), ["wer", "semantic_match"])


@query(f"WITH {RESULTS}, {POOLED} SELECT provider, metric, round(value, 6) AS value, 0::BIGINT AS metric_errors, n FROM pooled")
def pooled_rate_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.pooled(ops.metric_rows(read(spark, sf_dir))))


@query(f"WITH {RESULTS}, {TIMES} SELECT provider, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM times")
def latency_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.nearest_rank(read(spark, sf_dir).where("status = 'ok'"), ["provider"], "latency_seconds"))


@query(f"WITH {RESULTS}, {COUNTS} SELECT provider, round(rtf, 6) AS rtf FROM counts")
def pooled_rtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.provider_counts(read(spark, sf_dir)).select("provider", "rtf"))


@query(f"""WITH {RESULTS}, {COUNTS}, minutes AS (SELECT 'all' AS scope, audio_minutes FROM counts)
SELECT p.provider, round(m.total * p.rate, 6) AS cost_usd FROM (SELECT sum(audio_minutes) AS total FROM minutes) m
CROSS JOIN (VALUES ('deepgram', 0.0043::DOUBLE), ('openai', 0.0060), ('google', 0.0160), ('sarvam', 0.0050), ('elevenlabs', 0.0067), ('mock', 0.0)) p(provider, rate)""")
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonorant.dims import rates

    total = ops.provider_counts(read(spark, sf_dir)).agg(F.sum("audio_minutes").alias("total"))
    return rounded(rates(spark).crossJoin(F.broadcast(total)).select("provider", (F.col("total") * F.col("rate_usd_per_minute")).alias("cost_usd")))


@query(f"""WITH {RESULTS} SELECT run_id, clip_id AS id, provider, status, round(duration_seconds, 9) AS audio_duration_seconds, round(latency_seconds, 9) AS latency_seconds,
  round(CASE WHEN latency_seconds <> 0 AND duration_seconds <> 0 THEN latency_seconds / duration_seconds END, 9) AS rtf, round(semantic_match, 4) AS semantic_match FROM r""")
def per_clip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Nine places: at fewer, values halfway between two steps round by engine.
    r = read(spark, sf_dir).withColumn("clip_id", F.concat_ws("|", "run_id", "clip_id"))
    parts = F.split("id", r"\|")
    flat = ops.clip_rows(r, ["semantic_match"], 9).drop("semantic_match_error")
    return flat.withColumns({"run_id": parts[0], "id": parts[1]})


@query(f"""WITH {RESULTS}, {POOLED} SELECT metric, arg_min(provider, (CASE WHEN metric = 'wer' THEN value ELSE -value END, provider)) AS provider FROM pooled WHERE value IS NOT NULL GROUP BY metric""")
def winners_per_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.winners(ops.pooled(ops.metric_rows(read(spark, sf_dir))).select("provider", "metric", "value"))


BAND = "CASE WHEN wer IS NULL THEN 'unknown' WHEN wer >= 0 AND wer < 0.0001 THEN 'exact match' WHEN wer >= 0.0001 AND wer < 0.1 THEN 'near match' WHEN wer >= 0.1 AND wer < 0.3 THEN 'diverging' ELSE 'poor' END"
PLAN = f"""keyed AS (SELECT run_id || '|' || clip_id || '|' || provider AS key, {BAND} AS band FROM r WHERE status = 'ok'),
plan AS (SELECT key, band, row_number() OVER (PARTITION BY band ORDER BY md5('7|' || key), key)
  <= least(count(*) OVER (PARTITION BY band), greatest(5, round_even(count(*) OVER (PARTITION BY band) * 0.1, 0))) AS selected FROM keyed)"""


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir).where("status = 'ok'")
    return ops.sampling_plan(r.select(F.concat_ws("|", "run_id", "clip_id", "provider").alias("key"), ops.band(ops.value("wer")).alias("band")), 0.1, 5, 7)


@query(f"""WITH {RESULTS}, {PLAN} SELECT b.band, count(*) FILTER (selected) AS sampled, count(key) AS total
FROM (VALUES ('exact match'), ('near match'), ('diverging'), ('poor')) b(band) LEFT JOIN plan USING (band) GROUP BY b.band""")
def error_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.band_counts(plan(spark, sf_dir))


@query(f"WITH {RESULTS}, {PLAN} SELECT key, band FROM plan WHERE selected")
def sampling_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).where("selected").select("key", "band")


@query(f"""WITH {RESULTS}, d AS (SELECT run_id, clip_id, provider, wer, semantic_match >= 0.5 AS preserved FROM r WHERE status = 'ok' AND semantic_match IS NOT NULL)
SELECT clip_id, provider, round(wer, 6) AS wer, 'semantic_match' AS decided_by, CASE WHEN preserved THEN 'wording_only' ELSE 'meaning_broken' END AS kind
FROM d WHERE (wer <= 0.25 AND NOT preserved) OR (wer > 0.25 AND preserved)""")
def divergence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.divergences(read(spark, sf_dir)))


@query(f"""WITH {RESULTS}, {POOLED}, d AS (SELECT wer, semantic_match >= 0.5 AS preserved FROM r WHERE status = 'ok' AND semantic_match IS NOT NULL),
s AS (
  SELECT 'critical' AS severity, '' AS provider, 'meaning_broken' AS signal, count(*)::DOUBLE AS amount FROM d WHERE wer <= 0.25 AND NOT preserved HAVING count(*) > 0
  UNION ALL SELECT 'info', '', 'wording_only', count(*)::DOUBLE FROM d WHERE wer > 0.25 AND preserved HAVING count(*) > 0
  UNION ALL SELECT 'warning', provider, metric, value FROM pooled WHERE (metric = 'wer' AND value > 0.25) OR (metric = 'semantic_match' AND value < 0.8)
  UNION ALL SELECT 'warning', provider, 'clips_failed', count(*)::DOUBLE FROM r WHERE status <> 'ok' GROUP BY provider)
SELECT severity, provider, signal, round(amount, 6) AS amount, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END::BIGINT AS severity_order FROM s""")
def threshold_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.threshold_signals(read(spark, sf_dir)))


@query(f"WITH {RESULTS} SELECT count(*) FILTER (status = 'ok' AND sampled AND semantic_match IS NOT NULL) AS judged, count(*) FILTER (status = 'ok') AS total FROM r")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.coverage(read(spark, sf_dir))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def metrics_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k")).where("k >= 50")


# --- streams

STREAM = """s AS (SELECT user_id AS utterance, event_id AS seq, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS arrival,
    value, event_id, event_type IN ('purchase', 'signup') AS is_final, 'w' || (event_id % 50) AS text FROM events),
e AS (SELECT *, greatest(0.0, arrival - (arrival - value / 100 + CASE WHEN event_id % 10 = 0 THEN 10.0 ELSE 0.0 END)) AS latency FROM s)"""


@query(f"""WITH {STREAM}, p AS (SELECT utterance, list_sort(list(latency))[CAST(greatest(1, least(count(*), round_even(0.95 * count(*) + 0.5, 0))) AS INT)] AS final_p95 FROM e WHERE is_final GROUP BY utterance)
SELECT utterance, count(*) FILTER (NOT is_final) AS partials, count(*) FILTER (is_final) AS finals, round(min(arrival) FILTER (NOT is_final), 4) AS first_partial,
  round(median(latency) FILTER (NOT is_final), 4) AS partial_median, round(median(latency) FILTER (is_final), 4) AS final_median, round(any_value(final_p95), 4) AS final_p95
FROM e LEFT JOIN p USING (utterance) GROUP BY utterance""")
def stream_latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(latency.summary(views.stream(spark, sf_dir)), 4)


@query(f"""WITH {STREAM}, p AS (SELECT utterance, list_sort(list(latency))[CAST(greatest(1, least(count(*), round_even(0.95 * count(*) + 0.5, 0))) AS INT)] AS final_p95,
  string_agg(text, ' ' ORDER BY arrival, seq) AS transcript FROM e WHERE is_final GROUP BY utterance)
SELECT utterance, count(*) FILTER (NOT is_final) AS partials, count(*) FILTER (is_final) AS finals, round(min(arrival) FILTER (NOT is_final), 4) AS first_partial,
  round(median(latency) FILTER (NOT is_final), 4) AS partial_median, round(median(latency) FILTER (is_final), 4) AS final_median, round(any_value(final_p95), 4) AS final_p95, any_value(transcript) AS transcript
FROM e LEFT JOIN p USING (utterance) GROUP BY utterance""")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events replayed through keyed state in several micro-batches, late and repeated ones among them."""
    return rounded(utterances.replayed(spark, views.stream(spark, sf_dir)).drop("closed"), 4)


@query(f"WITH {STREAM} SELECT utterance, string_agg(text, ' ' ORDER BY arrival, seq) AS transcript FROM e WHERE is_final GROUP BY utterance")
def transcript_from_finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.transcripts(views.stream(spark, sf_dir))


@query(f"""WITH {STREAM}, t AS (SELECT utterance, seq, arrival AS start, arrival + (seq % 5) / 10.0::DOUBLE AS stop FROM e),
p AS (SELECT *, lead(start) OVER (PARTITION BY utterance ORDER BY start, seq) - stop AS pause FROM t),
g AS (SELECT utterance, count(*) AS words, min(start) AS a, arg_max(stop, (start, seq)) AS b, max(pause) AS longest_pause FROM p GROUP BY utterance)
SELECT utterance, words, round(CASE WHEN words >= 2 AND b - a > 0 THEN 60 * words / (b - a) END, 4) AS wpm, round(longest_pause, 4) AS longest_pause FROM g""")
def pauses_wpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.stream(spark, sf_dir).select("utterance", "seq", F.col("arrival").alias("start"), (F.col("arrival") + (F.col("seq") % 5) / F.lit(10.0)).alias("stop"))
    return rounded(latency.pauses(t), 4)


@query(f"""WITH {RESULTS}, {TIMES}, {COUNTS}, {POOLED} SELECT provider, round(audio_minutes, 3) AS audio_minutes, round(rtf, 3) AS rtf, round(value, 4) AS wer, round(p50, 3) AS p50, round(p95, 3) AS p95, round(p99, 3) AS p99
FROM counts LEFT JOIN (SELECT provider, value FROM pooled WHERE metric = 'wer') USING (provider) LEFT JOIN times USING (provider)""")
def leaderboard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = ops.leaderboard_rows(ops.leaderboard(read(spark, sf_dir)))
    return board.select("provider", "audio_minutes", "rtf", "wer", "p50", "p95", "p99")

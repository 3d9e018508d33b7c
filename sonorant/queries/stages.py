"""Queries over stages of judging, plans of agents, tasks of readers, datasets and the text of verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.functions import acoustic, verdicts
from sonorant.operators import dataset, plans, reading, results, staging, tasks, usecase
from sonorant.queries.events import PLAN, RESULTS, plan, read
from sonorant.queries.reading import EMISSIONS, emissions
from sonorant.queries.registry import query, rounded
from sonorant.session import tasks_for
from sonorant.sources import views
from sonorant.streaming import latency

JUDGED = ("semantic_match", "intent_entity")


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.judge_stage(read(spark, sf_dir), JUDGED, 0.1, 5, 7)


@query(f"""WITH {RESULTS}, {PLAN} SELECT run_id, clip_id, provider, band, selected, selected AND sampled AS sampled, CASE WHEN selected THEN semantic_match END AS semantic_match, round(wer, 6) AS wer
FROM r JOIN plan ON plan.key = run_id || '|' || clip_id || '|' || provider""")
def judge_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No result has an intent score, so all ok ones are candidates; those not sampled lose their verdict of meaning."""
    return rounded(staged(spark, sf_dir).select("run_id", "clip_id", "provider", "band", "selected", "sampled", results.value("semantic_match").alias("semantic_match"), results.value("wer").alias("wer")))


@query(f"""WITH {RESULTS}, {PLAN} SELECT run_id, round(least(1.0, (count(*) FILTER (status = 'ok') + count(*) FILTER (status <> 'ok') + count(*) FILTER (selected AND semantic_match IS NOT NULL)) / (count(*) + count(*) FILTER (selected))), 6)::DOUBLE AS fraction
FROM r LEFT JOIN plan ON plan.key = run_id || '|' || clip_id || '|' || provider GROUP BY run_id""")
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run: everything transcribed or failed, and the sampled results that have a verdict of meaning."""
    scored = staged(spark, sf_dir).groupBy("run_id").agg(F.count_if("selected").alias("to_score"), F.count_if(F.col("selected") & results.value("semantic_match").isNotNull()).alias("scored"))
    ok = F.col("status") == "ok"
    counts = read(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(ok).alias("transcribed"), F.count_if(~ok).alias("skipped"))
    return rounded(staging.progress(counts.join(scored, "run_id", "left").na.fill(0)).select("run_id", "fraction"))


@query(f"""WITH {RESULTS}, {PLAN}, b AS (SELECT o, band, count(*) FILTER (selected) AS s, count(*) AS t FROM (VALUES (0, 'exact match'), (1, 'near match'), (2, 'diverging'), (3, 'poor')) v(o, band) JOIN plan USING (band) GROUP BY ALL)
SELECT string_agg(band || ': ' || s || '/' || t, ' · ' ORDER BY o) AS description FROM b""")
def band_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.band_description(results.band_counts(plan(spark, sf_dir)))


@query("""WITH c AS (SELECT event_type AS model, 50 + event_id % 900 AS i, CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id % 70 END AS o, CASE WHEN event_type = 'purchase' THEN value / 1000 END AS cost FROM events),
p(model, i, o) AS (VALUES ('click', 0.5::DOUBLE, 1.5::DOUBLE), ('view', 3.0, 15.0), ('purchase', 1.0, 2.0)),
s AS (SELECT model, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(coalesce(o, 0))::BIGINT AS output_tokens, sum(coalesce(cost, 0)) AS reported FROM c GROUP BY model)
SELECT model, calls, input_tokens, output_tokens, round(CASE WHEN reported <> 0 THEN reported ELSE (input_tokens * coalesce(i, 0) + output_tokens * coalesce(o, 0)) / 1e6 END, 6) AS cost_usd FROM s LEFT JOIN p USING (model)""")
def judge_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    calls = e.select(F.col("event_type").alias("model"), (50 + F.col("event_id") % 900).alias("input_tokens"), F.when(F.col("event_id") % 13 != 0, F.col("user_id") % 70).alias("output_tokens"), F.when(F.col("event_type") == "purchase", F.col("value") / 1000).alias("cost"))
    prices = spark.createDataFrame([("click", 0.5, 1.5), ("view", 3.0, 15.0), ("purchase", 1.0, 2.0)], "model string, input_rate double, output_rate double")
    return rounded(staging.judge_usage(calls, prices))


# --- plans of agents: an order is an agent, its lines are the fields that it must capture

KINDS = "CASE l_linenumber WHEN 1 THEN 'number' WHEN 2 THEN 'amount' WHEN 3 THEN 'date' WHEN 4 THEN 'time' ELSE 'name' END"
AGENT_PLAN = f"""f AS (SELECT l_orderkey AS agent, l_linenumber AS ordinal, {KINDS} AS kind FROM lineitem),
a AS (SELECT o_orderkey AS agent, o_orderkey % 2 = 0 AS semantic, o_custkey % 3 = 0 AS exact FROM orders),
g AS (SELECT agent, CASE WHEN kind IN ('number', 'amount') THEN 'number_accuracy' WHEN kind IN ('date', 'time') THEN 'date_accuracy' ELSE 'entity_accuracy' END AS metric, min(ordinal) AS first, count(*) AS fields FROM f SEMI JOIN a USING (agent) GROUP BY ALL),
i AS (SELECT agent, metric, 'primary' AS tier, 0 AS part, first, fields FROM g
  UNION ALL SELECT agent, 'critical_fields', 'secondary', 1, 0, sum(fields)::BIGINT FROM g GROUP BY agent
  UNION ALL SELECT agent, 'semantic_match', 'secondary', 2, 0, 0 FROM a WHERE semantic UNION ALL SELECT agent, 'intent_entity', 'secondary', 3, 0, 0 FROM a WHERE semantic
  UNION ALL SELECT agent, 'llm_wer', 'primary', 4, 0, 0 FROM a WHERE exact
  UNION ALL SELECT agent, 'wer', 'baseline', 5, 0, 0 FROM a UNION ALL SELECT agent, 'cer', 'baseline', 6, 0, 0 FROM a)"""


def agent_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    kind = F.when(line == 1, "number").when(line == 2, "amount").when(line == 3, "date").when(line == 4, "time").otherwise("name")
    lines = views.table(spark, sf_dir, "lineitem")
    fields = lines.select(F.col("l_orderkey").alias("agent"), line.alias("ordinal"), kind.alias("kind"))
    agents = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("agent"), (F.col("o_orderkey") % 2 == 0).alias("semantic"), (F.col("o_custkey") % 3 == 0).alias("exact"))
    tasks = tasks_for(lines)
    return plans.select_plan(agents.repartition(tasks, "agent"), fields.repartition(tasks, "agent"), "agent")


@query(f"WITH {AGENT_PLAN} SELECT agent, metric, tier, row_number() OVER (PARTITION BY agent ORDER BY part, first, metric) AS place, fields FROM i")
def plan_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent_plan(spark, sf_dir)


@query(f"""WITH {AGENT_PLAN}, w AS (SELECT agent, metric, CASE WHEN metric = 'critical_fields' THEN 0 ELSE CASE tier WHEN 'primary' THEN 0.6 WHEN 'secondary' THEN 0.25 ELSE 0.15 END::DOUBLE
  / nullif(count(*) FILTER (metric <> 'critical_fields') OVER (PARTITION BY agent, tier), 0) END AS w0 FROM i),
n AS (SELECT agent, metric, w0 / sum(w0) OVER (PARTITION BY agent) AS w1 FROM w), c AS (SELECT agent, metric, CASE metric WHEN 'semantic_match' THEN 0.4 WHEN 'cer' THEN 0 ELSE w1 END AS w2 FROM n)
SELECT agent, metric, round(w2 / sum(w2) OVER (PARTITION BY agent), 6) AS weight FROM c""")
def plan_changed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meaning is given 0.4 of each plan, character errors less than nothing."""
    weighted = usecase.plan_weights(agent_plan(spark, sf_dir), ["agent"])
    return rounded(plans.set_weights(weighted, {"semantic_match": 0.4, "cer": -1.0}, "agent").select("agent", "metric", "weight"))


@query(f"WITH {AGENT_PLAN} SELECT DISTINCT agent, CASE WHEN metric LIKE '%_accuracy' THEN 'critical_fields' ELSE metric END AS metric FROM i")
def plan_runnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.runnable(agent_plan(spark, sf_dir), "agent")


@query("""WITH s AS (SELECT l_orderkey AS clip_id, l_returnflag AS provider, max(l_suppkey % 11) < 9 AS ok, avg((l_quantity > 10)::INT) AS score, list(DISTINCT 'f' || l_linenumber) FILTER (l_quantity <= 10) AS lost FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY clip_id, ok ORDER BY score DESC, provider) AS n FROM s)
SELECT clip_id, max(provider) FILTER (ok AND n = 1) AS winner, max(provider) FILTER (ok AND n = 2) AS runner_up, round(max(score) FILTER (ok AND n = 1) - max(score) FILTER (ok AND n = 2), 6) AS lead,
  CASE WHEN bool_or(ok) THEN coalesce(array_to_string(list_sort(any_value(lost) FILTER (ok AND n = 1)), ','), '') END AS lost, coalesce(string_agg(provider, ',' ORDER BY provider) FILTER (NOT ok), '') AS failed FROM r GROUP BY clip_id""")
def clip_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.max(F.col("l_suppkey") % 11) < 9, "ok").otherwise("failed")
    lost = F.collect_set(F.when(F.col("l_quantity") <= 10, F.concat(F.lit("f"), F.col("l_linenumber").cast("string"))))
    by = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("clip_id"), F.col("l_returnflag").alias("provider"))
    return rounded(plans.clip_winners(by.agg(status.alias("status"), F.avg((F.col("l_quantity") > 10).cast("double")).alias("score"), lost.alias("lost"))))


SAID = {k: v.replace("'", "''") for k, v in plans.SENTENCES.items()}
LISTED = "CASE len({0}) WHEN 0 THEN 'nothing' WHEN 1 THEN '**' || {0}[1] || '**' ELSE '**' || array_to_string({0}[:-2], '**, **') || '** and **' || {0}[-1] || '**' END"
PERCENT = "round_even({0} * 100, 0)::BIGINT::VARCHAR"
TENTHS = "(round_even({0} * 100 * 10, 0)::BIGINT // 10)::VARCHAR || '.' || (round_even({0} * 100 * 10, 0)::BIGINT % 10)::VARCHAR"


@query(f"""WITH s AS (SELECT l_orderkey AS clip_id, l_returnflag AS provider, max(l_suppkey % 11) < 9 AS ok, avg((l_quantity > 10)::INT) AS score, avg(l_linenumber % 4) / 4 AS wer, list_sort(coalesce(list(DISTINCT 'f' || l_linenumber) FILTER (l_quantity <= 10), [])) AS lost FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY clip_id, ok ORDER BY score DESC, provider) AS n FROM s),
c AS (SELECT clip_id, max(provider) FILTER (ok AND n = 1) AS p1, max(provider) FILTER (ok AND n = 2) AS p2, max(score) FILTER (ok AND n = 1) AS s1, max(score) FILTER (ok AND n = 2) AS s2, max(wer) FILTER (ok AND n = 1) AS w1, max(wer) FILTER (ok AND n = 2) AS w2,
  any_value(lost) FILTER (ok AND n = 1) AS l1, any_value(lost) FILTER (ok AND n = 2) AS l2, list_sort(list(provider) FILTER (NOT ok)) AS f FROM r GROUP BY clip_id)
SELECT clip_id, p1 AS winner, p2 AS runner_up, CASE WHEN p1 IS NULL THEN '{SAID["none"]}' ELSE concat_ws(' ', printf('{SAID["winner"]}', p1, 'this use case', {PERCENT.format("s1")}),
  CASE WHEN p2 IS NULL THEN NULL WHEN w1 > w2 AND len(l2) > 0 THEN printf('{SAID["higher"]}', p2, {TENTHS.format("w1")}, {TENTHS.format("w2")}, p2, {LISTED.format("l2")})
    WHEN len(l2) > 0 THEN printf('{SAID["lost"]}', p2, {PERCENT.format("s2")}, {LISTED.format("l2")}) ELSE printf('{SAID["close"]}', p2, {PERCENT.format("s2")}) END,
  CASE WHEN len(l1) > 0 THEN printf('{SAID["note"]}', p1, {LISTED.format("l1")}) END, CASE WHEN len(f) > 0 THEN printf('{SAID["failed"]}', {LISTED.format("f")}) END) END AS explanation FROM c""")
def winner_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.max(F.col("l_suppkey") % 11) < 9, "ok").otherwise("failed")
    lost = F.array_sort(F.collect_set(F.when(F.col("l_quantity") <= 10, F.concat(F.lit("f"), F.col("l_linenumber").cast("string")))))
    by = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("clip_id"), F.col("l_returnflag").alias("provider"))
    return plans.explained(by.agg(status.alias("status"), F.avg((F.col("l_quantity") > 10).cast("double")).alias("score"), (F.avg(F.col("l_linenumber") % 4) / 4).alias("wer"), lost.alias("lost")))


# --- tasks of readers: a customer's orders are a reader's tasks

@query("""SELECT o_custkey AS reader, sum(o_orderkey % 4)::BIGINT AS mistakes, sum(20 + o_orderkey % 9)::BIGINT AS correct, sum(20 + o_orderkey % 9 + o_orderkey % 4)::BIGINT AS ref_len,
  round(avg(CASE WHEN o_orderkey % 5 <> 0 THEN 40 + o_orderkey % 37 END), 4) AS wpm, max(CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 31) / 10.0::DOUBLE END) AS longest_pause FROM orders GROUP BY o_custkey""")
def task_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    items = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("reader"), (k % 4).alias("mistakes"), (20 + k % 9).alias("correct"), (20 + k % 9 + k % 4).alias("ref_len"), F.when(k % 5 != 0, 40 + k % 37).alias("wpm"), F.when(k % 7 != 0, (k % 31) / F.lit(10.0)).alias("longest_pause"))
    return rounded(tasks.totals(items, "reader"), 4)


@query("""WITH e AS (SELECT l_orderkey AS reader, chr((97 + l_partkey % 6)::INT) AS letter, 's' || (l_suppkey % 5) AS sound, 'w' || l_linenumber AS word FROM lineitem)
SELECT reader, letter, count(*) AS times, string_agg(DISTINCT sound, ',' ORDER BY sound) AS sounds, string_agg(DISTINCT word, ',' ORDER BY word) AS words FROM e GROUP BY ALL""")
def wrong_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "lineitem")
    named = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return tasks.wrong_letters(e.select(F.col("l_orderkey").alias("reader"), F.char(97 + F.col("l_partkey") % 6).alias("letter"), named("s", F.col("l_suppkey") % 5).alias("sound"), named("w", F.col("l_linenumber")).alias("word")), "reader")


@query("SELECT l_suppkey AS reader, l_returnflag AS sound, sum(l_linenumber)::BIGINT AS times FROM lineitem GROUP BY ALL")
def sound_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles hold other kinds too, which are no sounds."""
    profile = F.create_map(F.concat(F.lit("sound:"), F.col("l_returnflag")), F.col("l_linenumber").cast("long"), F.lit("word:different"), F.lit(1).cast("long"))
    return tasks.sound_bars(views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("reader"), profile.alias("profile")), "reader")


@query("""SELECT l_orderkey AS reader, count(*) FILTER (l_linenumber % 4 = 0) AS match, count(*) FILTER (l_linenumber % 4 = 1) AS substitution, count(*) FILTER (l_linenumber % 4 = 2) AS deletion, count(*) FILTER (l_linenumber % 4 = 3) AS insertion FROM lineitem GROUP BY ALL""")
def op_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("match", "substitution", "deletion", "insertion")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return tasks.op_kinds(views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("reader"), kind.alias("kind")), "reader", kinds)


@query("""WITH o AS (SELECT vec_id, i, CASE WHEN i < 14 AND i % 7 <> 3 THEN list_min(embedding[i * 4 + 1 : i * 4 + 4]) END AS llr, (i + vec_id) % 5 = 0 AS mistake, i % 6 = 1 AS heard FROM embeddings CROSS JOIN range(16) t(i)),
d AS (SELECT *, NOT mistake AND NOT heard AND coalesce(llr < -0.15, false) AS doubt FROM o)
SELECT vec_id, coalesce(string_agg('w' || i, ',' ORDER BY i) FILTER (doubt), '') AS doubts, count(*) FILTER (mistake OR doubt) AS mistakes, count(*) FILTER (doubt) AS acoustic FROM d GROUP BY vec_id""")
def audio_doubts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations without a place in the text and words without evidence are never in doubt."""
    i, vec = F.sequence(F.lit(0), F.lit(15)), F.col("vec_id")
    op = lambda x: F.struct(F.when(x % 7 != 3, x).alias("ref_index"), F.concat(F.lit("w"), x.cast("string")).alias("ref"), ((x + vec) % 5 == 0).alias("mistake"), (x % 6 == 1).alias("heard"))
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", F.transform(i, op).alias("ops"), F.transform(F.slice(acoustic.frames(F.col("embedding"), 4), 1, 14), F.array_min).alias("llr"))
    out = tasks.audio_doubts(rows, -0.15, True)
    return out.select("vec_id", F.array_join("doubts", ",").alias("doubts"), F.size(F.filter("ops", lambda o: o["mistake"])).cast("long").alias("mistakes"), F.size(F.filter("ops", lambda o: o["category"] == "acoustic")).cast("long").alias("acoustic"))


@query(f"""WITH {EMISSIONS}, s AS (SELECT vec_id, f, 4 * f + id AS a FROM b)
SELECT vec_id AS utt_id, f AS letter, coalesce((lag(a) OVER w + 1 + a) // 2, 0) AS lo, coalesce((a + 1 + lead(a) OVER w) // 2, 64) AS hi FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY f)""")
def letter_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best token of every fourth frame as a letter of one frame."""
    spans = F.transform("ids", lambda x, k: F.struct((4 * k + x.cast("int")).alias("start"), (4 * k + x.cast("int") + 1).alias("end")))
    w = emissions(spark, sf_dir).select("utt_id", F.posexplode(acoustic.windows(spans, F.lit(64))).alias("letter", "w"))
    return w.select("utt_id", F.col("letter").cast("long").alias("letter"), F.col("w.lo").cast("long").alias("lo"), F.col("w.hi").cast("long").alias("hi"))


@query("""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), m AS (SELECT vec_id, x, list_avg(x) AS m, list_var_pop(x) AS v FROM x)
SELECT vec_id, round((list_min(x) - m) / sqrt(v + 1e-7), 5) AS least, round((list_max(x) - m) / sqrt(v + 1e-7), 5) AS most FROM m""")
def standardized_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = acoustic.standardized(F.col("embedding").cast("array<double>"))
    w = views.table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"))
    return rounded(w.select("vec_id", F.array_min("x").alias("least"), F.array_max("x").alias("most")), 5)


CHOICES = """g AS (SELECT vec_id, k, f, sum(embedding[f * 4 + 1 + k]::DOUBLE - embedding[f * 4 + 1]::DOUBLE) OVER (PARTITION BY vec_id, k ORDER BY f) AS d FROM embeddings CROSS JOIN range(16) t(f) CROSS JOIN range(1, 4) u(k)),
m AS (SELECT vec_id, k, d - least(0, coalesce(min(d) OVER (PARTITION BY vec_id, k ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS s FROM g), s AS (SELECT vec_id, k, max(s) AS s FROM m GROUP BY ALL)"""


@query(f"""WITH {CHOICES} SELECT vec_id AS utt_id, chr((97 + vec_id % 3)::INT) AS expected, chr((96 + arg_max(k, s))::INT) AS best, round(max(s) FILTER (k = 1 + vec_id % 3) - max(s) FILTER (k <> 1 + vec_id % 3), 6) AS margin FROM s GROUP BY vec_id""")
def letter_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three letters of one token each and one that the model cannot emit. In SQL the best path of a letter is the stretch of
    frames where it gains most over the blank."""
    e, other = emissions(spark, sf_dir), lambda k: ((F.col("utt_id") + k) % 3).cast("int")
    one = lambda k: F.struct(F.char(97 + other(k)).alias("name"), F.array(1 + other(k)).alias("form"))
    none = F.struct(F.lit("z").alias("name"), F.lit(None).cast("array<int>").alias("form"))
    asked = e.select("utt_id", acoustic.log_softmax(F.col("log_probs")).alias("log_probs"), F.char(97 + other(0)).alias("expected"), F.array(one(0), one(1), none, one(2)).alias("candidates"))
    return rounded(acoustic.closed_set(asked))


@query("""WITH w AS (SELECT conv_id, turn, generate_subscripts(x, 1) - 1 AS word, unnest(x) AS text FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> '') AS x FROM conversations)),
k AS (SELECT conv_id, turn, word, regexp_replace(text, '[yz]', '', 'g') AS kept, regexp_replace(text, '[^yz]', '', 'g') AS unknown FROM w),
e AS (SELECT *, sum(length(kept)) OVER (PARTITION BY conv_id, turn ORDER BY word)::BIGINT + word AS e FROM k)
SELECT conv_id, turn, word, e - length(kept) AS first_id, e AS end_id, kept AS ids, unknown FROM e""")
def word_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns as tokens of letters; the vocabulary lacks y and z. Ids are written as their letters again."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda x: x != "")
    rows = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(words).alias("word", "text"))
    out = acoustic.target_rows(rows, ["conv_id", "turn"], {chr(97 + k): k for k in range(24)} | {"|": 24})
    letters = F.array_join(F.transform("ids", lambda k: F.char(97 + k)), "")
    return out.select("conv_id", "turn", F.col("word").cast("long").alias("word"), F.col("start").cast("long").alias("first_id"), F.col("end").cast("long").alias("end_id"), letters.alias("ids"), F.array_join("unknown", "").alias("unknown"))


@query("""WITH u AS (SELECT vec_id, f // 3 AS word, f, embedding[f * 4 + 1]::DOUBLE AS gop, embedding[f * 4 + 2]::DOUBLE AS llr FROM embeddings CROSS JOIN range(16) t(f) WHERE (f // 3 + vec_id) % 4 <> 0)
SELECT e.vec_id AS utt_id, w AS word, round(min(f) * 0.02::DOUBLE, 6) AS start_s, round((max(f) + 1) * 0.02::DOUBLE, 6) AS end_s, round(min(gop), 6) AS gop, round(min(llr), 6) AS llr FROM embeddings e CROSS JOIN range(6) t(w) LEFT JOIN u ON u.vec_id = e.vec_id AND word = w GROUP BY ALL""")
def word_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of three units; of every fourth word the model knows no letter."""
    e = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("utt_id"), F.transform(F.slice("embedding", 1, 64), lambda x: x.cast("double")).alias("x"))
    f = F.col("first")
    units = e.select("utt_id", "x", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("first")).select("utt_id", F.expr("first div 3").alias("word"), "first", f.alias("last"), F.get("x", f * 4).alias("gop"), F.get("x", f * 4 + 1).alias("llr"))
    words = e.select("utt_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("word"))
    return rounded(acoustic.word_evidence(words, units.where((F.col("word") + F.col("utt_id")) % 4 != 0), ["utt_id"], 0.02))


@query("""WITH p AS (SELECT chr((97 + l_partkey % 9)::INT) AS a, chr((97 + l_suppkey % 7)::INT) AS b, l_orderkey * 10 + l_linenumber AS o FROM lineitem WHERE l_quantity < 5),
f AS (SELECT letter, partner, min(o) AS o FROM (SELECT a AS letter, b AS partner, o FROM p UNION ALL SELECT b, a, o FROM p) WHERE letter <> partner GROUP BY ALL)
SELECT letter, string_agg(partner, '' ORDER BY o, partner) AS partners FROM f GROUP BY letter""")
def letter_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "lineitem").where("l_quantity < 5")
    pairs = e.select(F.char(97 + F.col("l_partkey") % 9).alias("a"), F.char(97 + F.col("l_suppkey") % 7).alias("b"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return reading.letter_partners(pairs).select("letter", F.array_join("partners", "").alias("partners"))


@query("""WITH p AS (SELECT (l_linenumber % 6)::BIGINT AS level, l_suppkey % 4 AS we, 8 + l_partkey % 9 AS wn, l_suppkey % 6 AS ce, 40 + l_partkey % 50 AS cn, l_suppkey % 12 = 0 AS exact, l_suppkey % 3 AS m, 6 + l_partkey % 7 AS n FROM lineitem),
a AS (SELECT level, count(*) AS samples, sum(we) / sum(wn) AS wer, sum(ce) / sum(cn) AS cer, avg(exact::INT) AS exact, sum(m) / sum(n) AS forgiving FROM p GROUP BY level)
SELECT i AS level, coalesce(samples, 0) AS samples, round(wer, 6) AS wer, round(cer, 6) AS cer, round(exact, 6) AS exact, round(forgiving, 6) AS forgiving, samples IS NULL AS missing FROM range(1, 8) g(i) LEFT JOIN a ON level = i""")
def level_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the levels 1 to 7 that are expected two have no samples; level 0 is not asked for."""
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    pairs = views.table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 6).cast("long").alias("level"), (s % 4).alias("word_errors"), (8 + p % 9).alias("word_length"), (s % 6).alias("char_errors"), (40 + p % 50).alias("char_length"), (s % 12 == 0).alias("exact"), (s % 3).alias("mistakes"), (6 + p % 7).alias("neutral"))
    return rounded(reading.level_report(pairs, "level", spark.range(1, 8).select(F.col("id").alias("level"))))


@query("""WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, chr((97 + l_partkey % 5)::INT) || chr((97 + l_suppkey % 5)::INT) || 'q' AS ref, l_suppkey % 4 AS form, l_orderkey % 5 = 0 AS checked, l_quantity / 10 - 3 AS gop, chr((97 + l_suppkey % 5)::INT) AS wrong FROM lineitem),
e AS (SELECT k AS reading, n, ref[1] AS word, ref[1] AS letter, gop AS score, ref[1] = wrong AS ok, 'letter_check' AS source FROM r WHERE checked
  UNION ALL SELECT k, n, ref, ref[1], gop, gop >= -1, 'gop' FROM r WHERE NOT checked AND form = 1 UNION ALL SELECT k, n, ref, ref[i::BIGINT], NULL, ref[i::BIGINT] <> wrong, 'text' FROM r CROSS JOIN range(1, 3) t(i) WHERE NOT checked AND form > 1)
SELECT reading, word, letter, round(score, 6)::DOUBLE AS score, ok, source, count(*) AS times FROM e GROUP BY ALL""")
def letter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as words of a reading: left out, scored by a unit, or spelled; q is silent; some readings were checked."""
    e, c = views.table(spark, sf_dir, "lineitem"), lambda name: F.char(97 + F.col(name) % 5)
    form, gop = F.col("l_suppkey") % 4, F.col("l_quantity").cast("double") / 10 - 3
    units = F.when(form == 1, F.array(F.struct(c("l_partkey").alias("letter"), gop.alias("gop"), F.lit("").alias("heard")), F.struct(F.lit("q").alias("letter"), gop.alias("gop"), F.lit("").alias("heard"))))
    op = F.struct(F.concat(c("l_partkey"), c("l_suppkey"), F.lit("q")).alias("ref"), F.when(form == 0, "deletion").otherwise("substitution").alias("kind"), units.alias("units"), F.array(c("l_suppkey")).alias("wrong"))
    check = F.when(F.col("l_orderkey") % 5 == 0, F.struct(c("l_partkey").alias("letter"), c("l_suppkey").alias("heard"), gop.alias("margin")))
    readings = e.groupBy(F.col("l_orderkey").alias("reading")).agg(F.collect_list(check).alias("checks"), F.collect_list(op).alias("ops"))
    return rounded(reading.letter_events(readings, "reading", -1.0, ["q"])).groupBy("reading", "word", "letter", "score", "ok", "source").agg(F.count("*").alias("times"))


# --- datasets and text

@query("""WITH c AS (SELECT source, doc_id AS clip_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN '' END AS language, n_chars / 1000.0::DOUBLE AS duration, doc_id % 10 = 0 AS upsampled, doc_id % 401 = 400 AS bad FROM documents),
n AS (SELECT source, clip_id, row_number() OVER (PARTITION BY source ORDER BY clip_id) AS n FROM c WHERE upsampled), u AS (SELECT source, string_agg(clip_id::VARCHAR, ', ' ORDER BY clip_id::VARCHAR) FILTER (n <= 5) AS names, count(*) AS k FROM n GROUP BY source)
SELECT source, count(*) FILTER (NOT bad) AS clips, round(coalesce(sum(duration) FILTER (NOT bad), 0) / 60, 6) AS minutes, count(DISTINCT coalesce(nullif(language, ''), 'xx')) AS languages, count(DISTINCT nullif(language, '')) > 1 AS multilingual,
  count(*) FILTER (duration < 0.2) AS too_short, any_value(names) || CASE WHEN any_value(k) > 5 THEN ' and ' || (any_value(k) - 5) || ' more' ELSE '' END AS upsampled, count(*) FILTER (NOT bad) > 0 AND count(*) FILTER (bad) = 0 AS runnable
FROM c LEFT JOIN u USING (source) GROUP BY source""")
def dataset_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    clips = views.table(spark, sf_dir, "documents").select("source", i.alias("clip_id"), F.when(i % 3 == 0, F.col("lang")).when(i % 3 == 1, "").alias("language"), (F.col("n_chars") / F.lit(1000.0)).alias("duration_seconds"), (i % 10 == 0).alias("upsampled"), F.when(i % 401 == 400, "no transcript").alias("error"))
    return rounded(dataset.overview(clips, "source", "xx"))


@query(r"""SELECT event_id, event_id % 4 = 3 AS failed, CASE event_id % 4 WHEN 2 THEN event_id % 100 WHEN 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 4 = 2 THEN 'a } and " {' END AS said FROM events""")
def verdict_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects bare, in a code fence, in prose with braces and quotes in a string and another object behind, and cut off."""
    form, fence = F.col("event_id") % 4, "`" * 3
    prose = F.concat(F.lit('My verdict: {"k": '), (F.col("event_id") % 100).cast("string"), F.lit(', "said": "a } and \\" {", "in": {"x": 1}} and not '), F.col("props"))
    text = F.when(form == 0, F.col("props")).when(form == 1, F.concat(F.lit(f"{fence}json\n"), F.col("props"), F.lit(f"\n{fence}"))).when(form == 2, prose).otherwise(F.concat(F.lit("cut off: "), F.rtrim(F.col("props"), F.lit("}"))))
    found = views.table(spark, sf_dir, "events").select("event_id", verdicts.json_object(text).alias("o"))
    return found.select("event_id", F.col("o").isNull().alias("failed"), F.get_json_object("o", "$.k").cast("long").alias("k"), F.get_json_object("o", "$.said").alias("said"))


@query("SELECT CASE lang WHEN 'en' THEN 'en-US' WHEN 'de' THEN 'de-DE' ELSE lang END AS code, lang AS bare, count(*) AS n FROM documents GROUP BY ALL")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = verdicts.language_code(F.col("lang"), {"en": "en-US", "de": "de-DE"})
    return views.table(spark, sf_dir, "documents").groupBy(code.alias("code"), verdicts.bare_code(code).alias("bare")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT p_brand AS provider, list(DISTINCT p_type) FILTER (p_size <= 5 AND p_partkey % 4 <> 0) AS languages FROM part WHERE p_brand <> 'Brand#11' GROUP BY p_brand)
SELECT DISTINCT p_brand AS provider, p_type AS language, coalesce(p_brand <> 'Brand#11' AND (languages IS NULL OR list_contains(languages, p_type)), false) AS supported FROM part LEFT JOIN s ON provider = p_brand""")
def language_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One brand is not known; those without a small part name no language."""
    p = views.table(spark, sf_dir, "part").select(F.col("p_brand").alias("provider"), F.col("p_type").alias("language"), ((F.col("p_size") <= 5) & (F.col("p_partkey") % 4 != 0)).alias("named"))
    support = p.where("provider <> 'Brand#11'").groupBy("provider").agg(F.collect_set(F.when(F.col("named"), F.col("language"))).alias("languages"))
    return dataset.supported(p.select("provider", "language").distinct(), support)


@query("""WITH b AS (SELECT DISTINCT source AS provider FROM documents) SELECT provider, row_number() OVER (ORDER BY CASE provider WHEN 'web' THEN 1 WHEN 'books' THEN 2 ELSE 3 END, provider) AS place FROM b""")
def provider_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.preferred(views.table(spark, sf_dir, "documents").select(F.col("source").alias("provider")).distinct(), "provider", ["web", "books"])


@query("""SELECT user_id AS utterance, round(CASE WHEN user_id % 3 <> 0 AND sum(event_id % 5) > 0 THEN sum(value) / sum(event_id % 5) END, 6) AS rtf FROM events GROUP BY user_id""")
def stream_real_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    pacing = F.when(F.col("user_id") % 3 == 0, "realtime").otherwise("fast")
    s = views.table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.col("event_id") % 5).alias("audio_seconds"), F.sum("value").alias("wall_seconds"))
    return rounded(latency.real_time(s.select(F.col("user_id").alias("utterance"), pacing.alias("pacing"), "audio_seconds", "wall_seconds")).select("utterance", "rtf"))


@query("""WITH c AS (SELECT l_returnflag AS provider, l_orderkey AS clip_id, avg((l_quantity > 10)::INT) AS score, count(*) FILTER (l_quantity <= 10) AS lost FROM lineitem GROUP BY ALL)
SELECT provider, count(*) AS clips, round(avg(score), 6) AS score, sum(lost)::BIGINT AS lost FROM c GROUP BY provider""")
def usecase_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("provider"), F.col("l_orderkey").alias("clip_id"))
    return rounded(usecase.dataset_scores(by.agg(F.avg((F.col("l_quantity") > 10).cast("double")).alias("score"), F.count_if(F.col("l_quantity") <= 10).alias("lost"))))


@query("SELECT page_id, sha1(html) AS content_id FROM pages")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", F.sha1("html").alias("content_id"))

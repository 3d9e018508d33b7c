"""Queries over levels, mistakes, sessions, fields and emissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.functions import acoustic
from sonorant.operators import reading, usecase
from sonorant.queries.registry import query, rounded
from sonorant.session import tasks_for
from sonorant.sources import views

LEVELS = "p AS (SELECT l_returnflag AS grp, (l_linenumber % 5)::BIGINT AS h, greatest(0, least(4, l_linenumber % 5 + CAST(l_quantity AS BIGINT) % 3 - 1))::BIGINT AS s FROM lineitem)"


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    human = (F.col("l_linenumber") % 5).cast("long")
    system = F.greatest(F.lit(0), F.least(F.lit(4), human + F.col("l_quantity").cast("long") % 3 - 1))
    return views.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), human.alias("human"), system.alias("system"))


@query(f"""WITH {LEVELS}, t AS (SELECT grp, count(*) AS n, sum(h) AS sh, sum(s) AS ss, sum(h * h) AS hh, sum(s * s) AS qq, sum((h - s) * (h - s)) AS o,
  count(*) FILTER (h = s) AS same, count(*) FILTER (s < h) AS low, count(*) FILTER (s > h) AS high FROM p GROUP BY grp)
SELECT grp, n, round(same / n, 6) AS accuracy, round(1 - (n * o)::DOUBLE / (n * (hh + qq) - 2 * sh * ss)::DOUBLE, 6) AS weighted_kappa, round(low / n, 6) AS false_fail_rate, round(high / n, 6) AS false_pass_rate FROM t""")
def level_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reading.level_agreement(levels(spark, sf_dir), "grp"))


@query(f"WITH {LEVELS} SELECT g.i AS human, " + ", ".join(f"count(*) FILTER (s = {k}) AS system_{k}" for k in range(5)) + " FROM range(5) g(i) LEFT JOIN p ON p.h = g.i GROUP BY g.i")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.confusion(levels(spark, sf_dir))


@query("""WITH i AS (SELECT (k + doc_id) % 7 = 0 AS h, (k + doc_id) % 5 = 0 AS s FROM documents CROSS JOIN range(1, 21) t(k)),
c AS (SELECT count(*) FILTER (h AND s) AS tp, count(*) FILTER (s AND NOT h) AS fp, count(*) FILTER (h AND NOT s) AS fn FROM i)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1 FROM c""")
def mistake_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.sequence(F.lit(1), F.lit(20))
    marked = lambda m: F.filter(places, lambda i: (i + F.col("doc_id")) % m == 0)
    return rounded(reading.mistake_scores(views.table(spark, sf_dir, "documents").select(marked(7).alias("human"), marked(5).alias("system"))))


SESSIONS = """t AS (SELECT o_orderkey AS session_id, o_orderkey % 7 <= 3 AS p, (o_orderkey // 7) % 7 <= 3 AS s, o_custkey % 6 >= 4 AS w, (o_orderkey % 11) % 6 >= 4 AS l FROM orders)"""


@query(f"WITH {SESSIONS} SELECT session_id, CASE WHEN p THEN (CASE WHEN s THEN 4 ELSE 3 END) WHEN w THEN 2 WHEN l THEN 1 ELSE 0 END::BIGINT AS level, CASE WHEN p THEN NULL WHEN w THEN NULL ELSE 1 END::BIGINT AS next_after_word FROM t")
def aser_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    p, s = F.col("o_orderkey") % 7 <= 3, F.expr("(o_orderkey div 7) % 7 <= 3")
    w, letter = F.col("o_custkey") % 6 >= 4, (F.col("o_orderkey") % 11) % 6 >= 4
    after = reading.next_task(p, s, w, F.lit(None).cast("boolean"))
    return o.select(F.col("o_orderkey").alias("session_id"), reading.placement(p, s, w, letter).alias("level"), after.alias("next_after_word"))


FIELDS = "f AS (SELECT l_returnflag AS provider, CASE WHEN l_linenumber IN (1, 2) THEN 'number_accuracy' WHEN l_linenumber = 3 THEN 'date_accuracy' ELSE 'entity_accuracy' END AS category, l_quantity > 10 AS preserved, l_orderkey FROM lineitem)"


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber").isin(1, 2), "number").when(F.col("l_linenumber") == 3, "date").otherwise("name")
    return views.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("provider"), F.col("l_orderkey").alias("clip_id"), usecase.field_group(kind).alias("category"), (F.col("l_quantity") > 10).alias("preserved"))


@query(f"WITH {FIELDS} SELECT provider, category, round(avg(preserved::INT), 6) AS accuracy, count(*) FILTER (NOT preserved) AS lost, count(*) AS fields FROM f GROUP BY ALL")
def category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(usecase.category_accuracy(fields(spark, sf_dir)))


PLAN = (("number_accuracy", "primary"), ("date_accuracy", "primary"), ("critical_fields", "secondary"), ("semantic_match", "secondary"), ("wer", "baseline"), ("cer", "baseline"))


def plan(spark: SparkSession) -> DataFrame:
    return usecase.plan_weights(spark.createDataFrame(list(PLAN), "metric string, tier string"))


@query(f"""WITH {FIELDS}, v AS (SELECT provider, l_orderkey AS clip_id, category AS metric, avg(preserved::INT) AS value FROM f GROUP BY ALL),
e AS (SELECT l_returnflag AS provider, l_orderkey AS clip_id, avg(l_linenumber % 4) / 2 AS wer, CASE WHEN count(*) > 1 THEN avg(l_linenumber % 3) / 2 END AS cer FROM lineitem GROUP BY ALL),
m AS (SELECT * FROM v UNION ALL SELECT provider, clip_id, 'wer', wer FROM e UNION ALL SELECT provider, clip_id, 'cer', cer FROM e WHERE cer IS NOT NULL),
g AS (SELECT provider, clip_id, metric, CASE WHEN metric IN ('wer', 'cer') THEN greatest(0, 1 - value) ELSE value END AS value FROM m),
keys AS (SELECT DISTINCT provider, clip_id FROM m), plan(metric, weight) AS (VALUES ('number_accuracy', 0.3::DOUBLE), ('date_accuracy', 0.3), ('semantic_match', 0.25), ('wer', 0.075), ('cer', 0.075))
SELECT provider, clip_id, round(coalesce(sum(value * weight) / sum(CASE WHEN value IS NOT NULL THEN weight END), 0), 6) AS score, coalesce(string_agg(plan.metric, ',' ORDER BY plan.metric) FILTER (value IS NULL), '') AS missing
FROM keys CROSS JOIN plan LEFT JOIN g USING (provider, clip_id, metric) GROUP BY provider, clip_id""")
def usecase_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracies of fields, and error rates beyond 1 among the others, so that clipping shows."""
    keys, lines = ("provider", "clip_id"), views.table(spark, sf_dir, "lineitem")
    tasks = tasks_for(lines)
    v = fields(spark, sf_dir).repartition(tasks, *keys).groupBy(*keys, F.col("category").alias("metric")).agg(F.avg(F.col("preserved").cast("double")).alias("value"))
    e = lines.select(F.col("l_returnflag").alias("provider"), F.col("l_orderkey").alias("clip_id"), "l_linenumber").repartition(tasks, *keys)
    e = e.groupBy(*keys).agg((F.avg(F.col("l_linenumber") % 4) / 2).alias("wer"), F.when(F.count("*") > 1, F.avg(F.col("l_linenumber") % 3) / 2).alias("cer"))
    errors = e.unpivot(list(keys), ["wer", "cer"], "metric", "value").where("value IS NOT NULL")
    return rounded(usecase.scores(v.unionByName(errors).repartition(tasks, *keys), plan(spark), list(keys)))


@query(f"""WITH {FIELDS}, v AS (SELECT provider, l_orderkey AS clip_id, avg(preserved::INT) AS score FROM f GROUP BY ALL)
SELECT provider, arg_min(clip_id, (score, clip_id)) AS clip_id, round(min(score), 6) AS score FROM v GROUP BY provider""")
def worst_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fields(spark, sf_dir).groupBy("provider", "clip_id").agg(F.avg(F.col("preserved").cast("double")).alias("score"))
    return rounded(usecase.worst_clip(v))


@query(f"""WITH {FIELDS}, v AS (SELECT provider, category, avg(preserved::INT) AS a FROM f GROUP BY ALL)
SELECT category AS metric, round(max(a) FILTER (provider = 'A'), 6) AS "A", round(max(a) FILTER (provider = 'N'), 6) AS "N", round(max(a) FILTER (provider = 'R'), 6) AS "R" FROM v GROUP BY category""")
def comparison_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = usecase.category_accuracy(fields(spark, sf_dir)).select(F.col("category").alias("metric"), "provider", F.col("accuracy").alias("value"))
    return rounded(usecase.comparison(v, ["A", "N", "R"]))


@query(f"""WITH {FIELDS}, v AS (SELECT provider, category AS metric, avg(preserved::INT) AS a FROM f GROUP BY ALL
  UNION ALL SELECT l_returnflag, 'wer', avg(l_linenumber % 4) / 2 FROM lineitem GROUP BY ALL),
r AS (SELECT *, CASE WHEN metric = 'wer' THEN greatest(0, 1 - a) ELSE a END AS g, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'wer' THEN greatest(0, 1 - a) ELSE a END DESC, provider) AS n FROM v)
SELECT metric, max(provider) FILTER (n = 1) AS winner, max(provider) FILTER (n = 2) AS runner_up, round(max(g) FILTER (n = 1) - max(g) FILTER (n = 2), 6) AS lead FROM r GROUP BY metric""")
def category_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = usecase.category_accuracy(fields(spark, sf_dir)).select(F.col("category").alias("metric"), "provider", F.col("accuracy").alias("value"))
    wer = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("provider")).agg((F.avg(F.col("l_linenumber") % 4) / 2).alias("value"))
    return rounded(usecase.podium(v.unionByName(wer.select(F.lit("wer").alias("metric"), "provider", "value"))))


@query(f"""WITH {FIELDS}, c AS (SELECT provider, category AS metric, avg(preserved::INT) AS kept FROM f GROUP BY ALL),
t AS (SELECT provider, metric, CASE WHEN kept < 0.8 THEN 'primary' ELSE 'secondary' END AS tier FROM c
  UNION ALL SELECT DISTINCT provider, m, 'baseline' FROM c CROSS JOIN (VALUES ('wer'), ('cer')) b(m)
  UNION ALL SELECT DISTINCT provider, 'critical_fields', 'secondary' FROM c),
w AS (SELECT *, CASE WHEN metric = 'critical_fields' THEN 0 ELSE CASE tier WHEN 'primary' THEN 0.6 WHEN 'secondary' THEN 0.25 ELSE 0.15 END::DOUBLE
  / count(*) FILTER (metric <> 'critical_fields') OVER (PARTITION BY provider, tier) END AS raw FROM t)
SELECT provider, metric, tier, round(raw / sum(raw) OVER (PARTITION BY provider), 6) AS weight FROM w""")
def usecase_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each provider's own plan: its weak kinds of field are primary, its strong ones secondary."""
    c = usecase.category_accuracy(fields(spark, sf_dir)).select("provider", F.col("category").alias("metric"), F.when(F.col("accuracy") < 0.8, "primary").otherwise("secondary").alias("tier"))
    more = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(t).alias("tier")) for m, t in (("wer", "baseline"), ("cer", "baseline"), ("critical_fields", "secondary"))))
    return rounded(usecase.plan_weights(c.unionByName(c.select("provider").distinct().select("provider", F.explode(more).alias("x")).select("provider", "x.*")), ["provider"]))


# --- emissions

EMISSIONS = """b AS (SELECT vec_id, f, list_position(x, list_max(x)) - 1 AS id FROM (SELECT vec_id, f, embedding[f * 4 + 1 : f * 4 + 4] AS x FROM embeddings CROSS JOIN range(16) t(f)))"""


def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("utt_id"), acoustic.frames(F.col("embedding"), 4).alias("log_probs"))
    return e.withColumn("ids", acoustic.best_tokens(F.col("log_probs")))


@query(f"""WITH {EMISSIONS}, c AS (SELECT *, lag(id) OVER (PARTITION BY vec_id ORDER BY f) AS before FROM b)
SELECT vec_id AS utt_id, coalesce(string_agg(id::VARCHAR, ' ' ORDER BY f) FILTER (id <> 0 AND (before IS NULL OR before <> id)), '') AS decoded FROM c GROUP BY vec_id""")
def greedy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = acoustic.collapsed(F.col("ids"), 0)
    return emissions(spark, sf_dir).select("utt_id", F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").alias("decoded"))


@query(f"WITH {EMISSIONS} SELECT id::BIGINT AS blank FROM b GROUP BY id ORDER BY count(*) DESC, id LIMIT 1")
def blank_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acoustic.most_frequent(emissions(spark, sf_dir)).select(F.col("blank").cast("long").alias("blank"))


@query()
def ctc_gop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each utterance aligned to all of its own greedy decoding; tests hold the path against all paths of short cases."""
    e = emissions(spark, sf_dir)
    e = e.select("utt_id", acoustic.log_softmax(F.col("log_probs")).alias("log_probs"), acoustic.collapsed(F.col("ids"), 0).alias("targets"))
    return rounded(acoustic.align(e.where(F.size("targets") > 0)))

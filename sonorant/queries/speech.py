"""Queries over reference and heard texts, uploads and languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.functions import align, text
from sonorant.operators import dataset, ladder, reading, wordops
from sonorant.queries.registry import query, rounded
from sonorant.sources import views

PAIRS = """t AS (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> '') AS r FROM {table}),
w AS (SELECT *, list_filter(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN (i + {n}) % 7 = 0 THEN NULL WHEN (i + {n}) % 5 = 0 THEN r[i] || 'x' ELSE r[i] END), lambda x: x IS NOT NULL) AS h FROM t)"""
TURNS = PAIRS.format(key="conv_id, turn, role", table="conversations", n="turn")
PAIRS = PAIRS.format(key="doc_id, lang", table="documents", n="doc_id")
#: One row of the edit table for each reference token, over whole turns of conversations; texts of documents are too long for it.
DISTANCE = f"""WITH RECURSIVE {TURNS}, dp(conv_id, turn, i, row) AS (
  SELECT conv_id, turn, 0, range(0, len(h) + 1) FROM w
  UNION ALL
  SELECT conv_id, turn, i, list_transform(range(0, len(x)), lambda j: j + list_min(x[1 : j + 1])) FROM (
    SELECT dp.conv_id, dp.turn, dp.i + 1 AS i, list_transform(range(0, len(w.h) + 1), lambda k:
      CASE WHEN k = 0 THEN dp.i + 1 ELSE least(dp.row[k + 1] + 1, dp.row[k] + CASE WHEN w.r[dp.i + 1] = w.h[k] THEN 0 ELSE 1 END) END - k) AS x
    FROM dp JOIN w USING (conv_id, turn) WHERE dp.i < len(w.r))
), d AS (SELECT w.*, dp.row[len(w.h) + 1]::BIGINT AS errors, len(w.r)::BIGINT AS length FROM dp JOIN w USING (conv_id, turn) WHERE dp.i = len(w.r))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.pairs(spark, sf_dir)
    return p.select("doc_id", "lang", text.edit_count(F.col("r"), F.col("h")).alias("errors"), F.size("r").cast("long").alias("length"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g')), '[^a-z0-9_'' ]', ' ', 'g'), ' +', ' ', 'g')) AS normal FROM documents")
def tokenize_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    ascii_text = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "")
    return views.table(spark, sf_dir, "documents").select("doc_id", text.normalize(ascii_text).alias("normal"))


@query()
def wer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates over whole texts, too long for SQL; tests hold them against the whole edit table."""
    return rounded(scored(spark, sf_dir).select("doc_id", "errors", "length", text.error_rate(F.col("errors"), F.col("length")).alias("wer")))


@query()
def wer_pooled_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = scored(spark, sf_dir).groupBy("lang").agg(F.sum("errors").alias("errors"), F.sum("length").alias("length"))
    return rounded(by.withColumn("wer", F.when(F.col("length") > 0, F.col("errors") / F.col("length"))))


def scored_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.turns(spark, sf_dir)
    chars = [F.array_join(c, "") for c in ("r", "h")]
    return t.select("conv_id", "turn", "role", text.edit_count(F.col("r"), F.col("h")).alias("word_errors"), F.size("r").cast("long").alias("word_length"), F.levenshtein(*chars).cast("long").alias("char_errors"), F.length(chars[0]).cast("long").alias("char_length"))


@query(DISTANCE + " SELECT conv_id, turn, errors, length, round(CASE WHEN length > 0 THEN errors / length WHEN errors > 0 THEN 1 ELSE 0 END, 6) AS wer FROM d")
def turn_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_turns(spark, sf_dir).select("conv_id", "turn", F.col("word_errors").alias("errors"), F.col("word_length").alias("length"))
    return rounded(s.withColumn("wer", text.error_rate(F.col("errors"), F.col("length"))))


@query(f"""WITH {TURNS}, c AS (SELECT conv_id, turn, array_to_string(r, '') AS a, array_to_string(h, '') AS b FROM w)
SELECT conv_id, turn, levenshtein(a, b) AS errors, length(a) AS length, round(CASE WHEN length(a) > 0 THEN levenshtein(a, b) / length(a) WHEN length(b) > 0 THEN 1 ELSE 0 END, 6) AS cer FROM c""")
def turn_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_turns(spark, sf_dir).select("conv_id", "turn", F.col("char_errors").alias("errors"), F.col("char_length").alias("length"))
    return rounded(s.withColumn("cer", text.error_rate(F.col("errors"), F.col("length"))))


@query(DISTANCE + """, e AS (SELECT *, levenshtein(array_to_string(r, ''), array_to_string(h, '')) AS ce, length(array_to_string(r, '')) AS cl FROM d)
SELECT role, count(*) AS samples, round(sum(errors) / greatest(sum(length), 1), 6) AS wer, round(sum(ce) / greatest(sum(cl), 1), 6) AS cer, round(avg((errors = 0)::INT), 6) AS exact FROM e GROUP BY role""")
def turn_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reading.level_benchmark(scored_turns(spark, sf_dir).withColumn("exact", F.col("word_errors") == 0), "role"))


@query()
def edit_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit counts by kind and segments; tests hold their sums against the distance."""
    a = align.align(views.pairs(spark, sf_dir))
    differing = F.filter("alignment.segments", lambda s: s["op"] != "equal")
    shown = F.transform(differing, lambda s: F.concat(F.array_join(s["ref"], " "), F.lit(" > "), F.array_join(s["hyp"], " ")))
    return a.select("doc_id", "alignment.sub", "alignment.del", "alignment.ins", F.array_join(shown, " | ").alias("differing"))


@query()
def level_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled rates over whole texts; `turn_benchmark` is the same with character rates and with SQL."""
    s = scored(spark, sf_dir).select("lang", F.col("errors").alias("word_errors"), F.col("length").alias("word_length"), F.lit(0).alias("char_errors"), F.lit(0).alias("char_length"), (F.col("errors") == 0).alias("exact"))
    return rounded(reading.level_benchmark(s, "lang").drop("cer"))


LETTERS = """x AS (SELECT substr(r[i], 1, 1) AS expected, substr(h[i], 1, 1) AS heard FROM (SELECT r, h, unnest(range(1, least(len(r), len(h)) + 1)) AS i FROM w)),
c AS (SELECT expected, heard, count(*) AS count FROM x WHERE expected <> heard GROUP BY ALL), s AS (SELECT expected, count(*) AS seen FROM x GROUP BY expected)"""


def confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.pairs(spark, sf_dir).select(F.explode(F.arrays_zip("r", "h")).alias("z")).where("z.r IS NOT NULL AND z.h IS NOT NULL")
    return reading.letter_confusions(p.select(F.substring("z.r", 1, 1).alias("expected"), F.substring("z.h", 1, 1).alias("heard")))


@query(f"WITH {PAIRS}, {LETTERS} SELECT expected, heard, count, seen, round(count / seen, 6) AS rate FROM c JOIN s USING (expected)")
def letter_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(confusions(spark, sf_dir))


@query(f"WITH {PAIRS}, {LETTERS} SELECT expected, heard, count, place FROM (SELECT *, row_number() OVER (PARTITION BY expected ORDER BY count DESC, heard) AS place FROM c WHERE count >= 2 AND heard <> '') WHERE place <= 4")
def top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.top_confusions(confusions(spark, sf_dir))


LISTED = (("t", "d"), ("e", "a"), ("q", "z"))


@query(f"""WITH {PAIRS}, {LETTERS}, seen AS (SELECT least(expected, heard) AS a, greatest(expected, heard) AS b, sum(count) AS n FROM c GROUP BY ALL), known(a, b) AS (VALUES ('d', 't'), ('a', 'e'), ('q', 'z'))
SELECT a, b, 'unlisted' AS finding FROM seen ANTI JOIN known USING (a, b) WHERE n >= 2 UNION ALL SELECT a, b, 'unseen' FROM known ANTI JOIN seen USING (a, b)""")
def confusion_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.confusion_audit(confusions(spark, sf_dir), spark.createDataFrame(list(LISTED), "a string, b string"))


@query("""WITH u AS (SELECT s_suppkey AS id, count(*) AS n FROM (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 0 UNION ALL SELECT s_suppkey FROM supplier WHERE s_suppkey % 13 = 1 AND s_suppkey % 10 <> 0) GROUP BY ALL),
t AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT coalesce(u.id, t.id) AS id, CASE WHEN t.id IS NULL THEN 'no_transcript' WHEN u.id IS NULL THEN 'no_audio' WHEN n > 1 THEN 'duplicate_upload' ELSE 'ok' END AS status FROM u FULL JOIN t ON u.id = t.id""")
def dataset_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text"), F.col("s_suppkey").alias("ordinal"))
    first = s.where("id % 10 <> 0").select("id", "ordinal")
    return dataset.validated(first.unionByName(first.where("id % 13 = 1")), s.where("id % 7 <> 0"))


@query("""WITH s AS (SELECT DISTINCT p_brand AS provider, p_type AS language FROM part WHERE p_size <= 25), u AS (SELECT DISTINCT p_type AS language FROM part WHERE p_type IN ('ECONOMY', 'STANDARD'))
SELECT provider FROM s JOIN u USING (language) GROUP BY provider HAVING count(*) = (SELECT count(*) FROM u)""")
def provider_language_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    return dataset.supporting_all(p.where("p_size <= 25").select(F.col("p_brand").alias("provider"), F.col("p_type").alias("language")), p.where("p_type IN ('ECONOMY', 'STANDARD')").select(F.col("p_type").alias("language")))


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS size, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY lang")
def language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dataset.language_mix(views.table(spark, sf_dir, "documents").select("lang", F.col("n_chars").alias("size"))))


def scored_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordops.score(views.pairs(spark, sf_dir), "hi", matches=False)


@query()
def reading_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mistakes and words read of each text; tests hold the operations against cases for each rule."""
    t = wordops.totals(scored_readings(spark, sf_dir))
    return t.select("doc_id", "mistakes", "correct", F.array_join(F.transform("mistake_places", lambda x: x.cast("string")), ",").alias("places"))


@query()
def mistake_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordops.mistake_profile(scored_readings(spark, sf_dir), ["lang"])


@query()
def forgiven_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates after verdicts that forgive every other segment; tests hold them against a plain rescoring."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    verdicts = views.damaged(docs, "doc_id").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.size("r").cast("long"))).alias("segment")).withColumn("equivalent", (F.col("segment") + F.col("doc_id")) % 2 == 0)
    f = ladder.rescored(views.damaged(ladder.judged(docs, verdicts, "doc_id"), "doc_id"), "doc_id")
    return rounded(f.select("doc_id", "forgiven", "segments", F.col("llm_wer.value").alias("llm_wer"), F.col("llm_cer.value").alias("llm_cer")))

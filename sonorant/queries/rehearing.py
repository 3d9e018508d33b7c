"""Queries over units of words and words heard again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.operators import rehearing
from sonorant.queries.registry import query, rounded
from sonorant.sources import views


@query("""WITH RECURSIVE w AS (SELECT p_partkey AS part, replace(p_name, ' ', '') AS word FROM part),
u AS (SELECT part, word, list_filter(string_split(CASE WHEN part % 5 = 0 THEN reverse(word) ELSE word END, ''), lambda c: c NOT IN ('a', 'e', 'l')) AS units FROM w),
walk(part, k, upto, places) AS (SELECT part, 0, 0, []::BIGINT[] FROM u
  UNION ALL SELECT part, k + 1, upto + instr(substr(word, upto + 1), units[k + 1]), list_append(places, upto + instr(substr(word, upto + 1), units[k + 1]) - 1)
  FROM walk JOIN u USING (part) WHERE k < len(units) AND instr(substr(word, upto + 1), units[k + 1]) > 0)
SELECT part, word, CASE WHEN k = len(units) THEN array_to_string(places, ',') END AS places FROM u JOIN (SELECT part, max(k) AS k, arg_max(places, k) AS places FROM walk GROUP BY part) USING (part)""")
def unit_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units are a name's letters without some that a model lacks; of every fifth part they come in the wrong order."""
    word = F.replace("p_name", F.lit(" "), F.lit(""))
    units = F.filter(F.split(F.when(F.col("part") % 5 == 0, F.reverse("word")).otherwise(F.col("word")), ""), lambda c: ~c.isin("", "a", "e", "l"))
    w = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), word.alias("word"))
    return w.select("part", "word", F.array_join(rehearing.unit_places(F.col("word"), units), ",").alias("places"))


THRESHOLD, FOLDS = -2.0, ("ce", "ba")

HEARD = """w AS (SELECT l_orderkey AS reading, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k, l_linenumber = 7 AS strange,
  CAST(l_quantity AS BIGINT) % 4 = 0 AS wrong, l_partkey AS p, l_suppkey AS s, [chr((97 + l_partkey % 5)::INT), chr((97 + l_suppkey % 5)::INT), chr((97 + l_linenumber % 5)::INT)] AS c FROM lineitem),
x AS (SELECT *, c[1] || c[2] || 'q' || c[3] AS ref, [CASE WHEN (p + i * s) % 11 - 5 < -2 THEN CASE WHEN (s + i) % 3 = 0 THEN '' ELSE chr((97 + (p + i) % 5)::INT) END ELSE c[i] END FOR i IN [1, 2, 3]] AS d FROM w),
y AS (SELECT *, CASE WHEN NOT wrong AND NOT strange THEN d[1] || d[2] || 'q' || d[3] ELSE ref END AS heard FROM x),
o AS (SELECT reading, k, ref, wrong, heard <> ref AS redone, CASE WHEN heard <> ref THEN heard WHEN wrong THEN 'zzz' ELSE ref END AS hyp,
  CASE WHEN heard = ref THEN wrong ELSE translate(ref, 'ce', 'ba') <> translate(heard, 'ce', 'ba') END AS mistake,
  CASE WHEN heard = ref THEN NULL WHEN translate(ref, 'ce', 'ba') = translate(heard, 'ce', 'ba') THEN 'forgiven' WHEN 2 * levenshtein(ref, heard) <= length(ref) THEN 'near' ELSE 'different' END AS category FROM y)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a reading and its lines are words of four letters, of which the audio has units of three; every seventh word's
    units belong to another word."""
    letter = lambda c: F.char(97 + c % 5)
    p, s, n = (F.col(f"l_{c}").cast("long") for c in ("partkey", "suppkey", "linenumber"))
    c, wrong = (letter(p), letter(s), letter(n)), F.col("l_quantity").cast("long") % 4 == 0
    unit = lambda i: F.struct(F.when((n == 7) & F.lit(i == 1), "z").otherwise(c[i - 1]).alias("unit"), ((p + i * s) % 11 - 5).cast("double").alias("llr"), F.when((s + i) % 3 == 0, "").otherwise(letter(p + i)).alias("heard"))
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.concat(c[0], c[1], F.lit("q"), c[2]).alias("ref"), wrong.alias("wrong"), F.array(*map(unit, (1, 2, 3))).alias("units"))
    rows = F.array_sort(F.collect_list(row))
    op = lambda x, k: F.struct(k.alias("ref_index"), x["ref"].alias("ref"), F.when(x["wrong"], "zzz").otherwise(x["ref"]).alias("hyp"), F.when(x["wrong"], "substitution").otherwise("match").alias("kind"), x["wrong"].alias("mistake"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("note"))
    grouped = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("reading")).agg(rows.alias("x"))
    return grouped.select("reading", F.transform("x", op).alias("ops"), F.transform("x", lambda x: x["units"]).alias("units"))


def heard_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rehearing.reheard(readings(spark, sf_dir), "reading", THRESHOLD, rehearing.plain_score(FOLDS))


@query(f"""WITH {HEARD} SELECT reading, k, ref, hyp, mistake, category, CASE WHEN redone THEN 'audio: ' || hyp || '; transcript: ' || ref END AS note FROM o""")
def reheard_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = heard_again(spark, sf_dir).select("reading", F.posexplode("ops").alias("k", "o"))
    return ops.select("reading", (F.col("k") + 1).cast("long").alias("k"), "o.ref", "o.hyp", "o.mistake", "o.category", "o.note")


@query(f"""WITH {HEARD} SELECT reading, count(*) AS words, count(*) FILTER (wrong) AS mistakes_before, count(*) FILTER (mistake) AS mistakes, count(*) FILTER (NOT wrong) AS correct_before, count(*) FILTER (NOT mistake) AS correct,
  count(*) FILTER (redone) AS rechecked FROM o GROUP BY reading""")
def reheard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rehearing.task_counts(heard_again(spark, sf_dir), "reading")
    return out.select("reading", *(F.col(c).cast("long").alias(c) for c in out.columns[1:]))


@query()
def aligned_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of aligned words of whole turns; tests hold the counts against plain alignments."""
    return rounded(rehearing.aligned_letters(views.turns(spark, sf_dir)))

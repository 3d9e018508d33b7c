"""Queries over readings in Devanagari, made of the documents' whole texts, rule by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.functions import devanagari as dv
from sonorant.functions import rulebooks
from sonorant.queries.registry import query
from sonorant.sources import views

#: Letters of the documents and what a reading has in their place: letters, signs, marks, a precomposed letter with a dot, a
#: letter of another code and an invisible character. Every third word stays as it is, in Latin letters.
MADE = {
    "a": "ा", "b": "ि", "c": "क", "d": "द", "e": "\u094d", "f": "फ", "g": "ग", "h": "ह", "i": "ी", "j": "ज", "k": "ख", "l": "ल", "m": "म",
    "n": "न", "o": "\u0901", "p": "प", "q": "ष", "r": "र", "s": "स", "t": "त", "u": "ु", "v": "ड", "w": "\u093c", "x": "\u0958", "y": "\u200d",
    "z": "\u0972", ".": "।", "0": "०", "1": "१", "2": "२", "3": "३", "4": "४", "5": "५", "6": "६", "7": "७", "8": "८", "9": "९",
}
PLAIN, SCRIPT = "".join(MADE), "".join(MADE.values())
#: What stands before a reading, by doc_id: variants of spelling, a protected word, a mark of the class, invisible characters.
OPENINGS = ("गयी", "हँसी माँ", "पढ\u093cना \u0958लम", "सन्त अङ्क", "चाहिये \u0972", "ज\u200d\u094dञ १२", "pakka sita")

_q = lambda s: s.replace("'", "''")
_map = lambda kv: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in kv) + "}"
_tokens = "|".join(sorted([*dv.CONSONANTS, *dv.VOWELS], key=len, reverse=True))

READINGS = f"""raw AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'hi' WHEN 1 THEN 'mr' ELSE 'xx' END AS code,
  list_extract([{", ".join(f"'{o}'" for o in OPENINGS)}], (doc_id % {len(OPENINGS)})::INT + 1) || ' ' || array_to_string(list_transform(string_split(coalesce(text, ''), ' '), lambda w, i: CASE WHEN i % 3 = 1 THEN w ELSE translate(w, '{PLAIN}', '{SCRIPT}') END), ' ') AS text FROM documents)"""

# Of a run of one consonant every second one is joined to the one before it.
STAGES = f"""s1 AS (SELECT *, nfc_normalize(text) AS t1 FROM raw),
tok AS (SELECT doc_id, lower(u.tok) AS tok, u.raw AS raw, u.i AS i FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(t1, '(?is){_tokens}|[^A-Za-z]'), lambda x, i: struct_pack(tok := x, raw := x, i := i))) AS u FROM s1 WHERE code <> 'xx')),
mapped AS (SELECT *, {_map(dv.CONSONANTS.items())}[tok] AS c, {_map((k, v[0]) for k, v in dv.VOWELS.items())}[tok] AS letter, {_map((k, v[1] or "-") for k, v in dv.VOWELS.items())}[tok] AS sign FROM tok),
near AS (SELECT *, lag(c) OVER w AS c1, lag(coalesce(c, letter), 2) OVER w AS any2, lead(coalesce(c, letter)) OVER w AS next FROM mapped WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT *, sum((c IS DISTINCT FROM c1)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM near),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS k FROM runs),
spelt AS (SELECT doc_id, string_agg(CASE WHEN c IS NOT NULL THEN CASE WHEN k % 2 = 0 THEN '{dv.VIRAMA}' ELSE '' END || c
    WHEN letter IS NULL THEN raw WHEN c1 IS NULL THEN letter WHEN tok = 'a' AND next IS NULL AND any2 IS NOT NULL THEN 'ा' ELSE replace(sign, '-', '') END, '' ORDER BY i) AS t2 FROM placed GROUP BY doc_id),
s2 AS (SELECT s1.*, coalesce(t2, t1) AS t2 FROM s1 LEFT JOIN spelt USING (doc_id)),
s3 AS (SELECT *, CASE WHEN code = 'xx' THEN t2 ELSE translate(t2, '०१२३४५६७८९', '0123456789') END AS t3 FROM s2),
s4 AS (SELECT *, CASE WHEN code = 'xx' THEN trim(regexp_replace(translate(t3, '{rulebooks.PLAIN_INVISIBLE}', ''), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g'))
  ELSE trim(regexp_replace(translate(t3, '{dv.INVISIBLE}', ''), '[^\\x{{0900}}-\\x{{0963}}\\x{{0966}}-\\x{{096F}}\\x{{0971}}-\\x{{097F}}\\p{{Nd}}\\p{{No}}]+', ' ', 'g')) END AS t4 FROM s3),
s5 AS (SELECT *, CASE code WHEN 'hi' THEN replace(replace(replace(replace(replace(t4, 'ड़', '<'), 'ढ़', '>'), '{dv.NUKTA}', ''), '<', 'ड़'), '>', 'ढ़') WHEN 'mr' THEN replace(t4, '{dv.NUKTA}', '') ELSE t4 END AS t5 FROM s4),
s6 AS (SELECT *, CASE code WHEN 'hi' THEN array_to_string(list_transform(string_split(t5, ' '), lambda w: CASE WHEN w IN ({", ".join(f"'{p}'" for p in dv.PROTECTED)}) THEN w ELSE replace(w, '{dv.CHANDRABINDU}', '{dv.ANUSVARA}') END), ' ')
  WHEN 'mr' THEN replace(t5, '{dv.CHANDRABINDU}', '{dv.ANUSVARA}') ELSE t5 END AS t6 FROM s5),
s8 AS (SELECT *, CASE WHEN code = 'xx' THEN t6 ELSE {"regexp_replace(" * len(dv.NASAL_CLASSES)}t6{"".join(f", '{n}{dv.VIRAMA}([{stops}])', '{dv.ANUSVARA}{chr(92)}1', 'g')" for n, stops in dv.NASAL_CLASSES.items())} END AS t8 FROM s6),
s9 AS (SELECT *, CASE WHEN code = 'xx' THEN t8 ELSE translate(t8, 'ॲऱ', 'ऍर') END AS t9 FROM s8),
s10 AS (SELECT *, CASE WHEN code = 'hi' THEN array_to_string(list_transform(string_split(t9, ' '), lambda w: coalesce({_map(dv.SPELLINGS.items())}[w], w)), ' ') ELSE t9 END AS t10 FROM s9),
steps AS (SELECT doc_id, code, unnest([{", ".join(f"struct_pack(rule := upper(code) || '-{n:02d}', old := {b}, new := t{n})" for b, n in zip(("text", "t1", "t2", "t3", "t4", "t5", "t6", "t8", "t9"), (1, 2, 3, 4, 5, 6, 8, 9, 10), strict=True))}]) AS s FROM s10)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.coalesce("text", F.lit("")), " ", -1)
    said = F.array_join(F.transform(words, lambda w, i: F.when(i % 3 == 0, w).otherwise(F.translate(w, PLAIN, SCRIPT))), " ")
    opening = F.get(F.array(*map(F.lit, OPENINGS)), (F.col("doc_id") % len(OPENINGS)).cast("int"))
    code = F.get(F.array(*map(F.lit, ("hi", "mr", "xx"))), (F.col("doc_id") % 3).cast("int"))
    return views.table(spark, sf_dir, "documents").select("doc_id", code.alias("code"), F.concat(opening, F.lit(" "), said).alias("text"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulebooks.traced(readings(spark, sf_dir), "text", "code")


@query(f"WITH {READINGS}, {STAGES} SELECT doc_id, code, t10 AS normalized FROM s10")
def normalized_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole readings after all rules of their rulebook."""
    return traces(spark, sf_dir).select("doc_id", "code", "normalized")


@query(f"WITH {READINGS}, {STAGES} SELECT doc_id, s.rule AS rule, md5(s.old) AS before_md5, md5(s.new) AS after_md5 FROM steps WHERE s.old <> s.new")
def rule_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each rule that changed a reading, with the texts before and after it as hashes."""
    steps = rulebooks.entries(traces(spark, sf_dir), "doc_id")
    return steps.select("doc_id", "rule", F.md5("before").alias("before_md5"), F.md5("after").alias("after_md5"))


@query(f"WITH {READINGS}, {STAGES} SELECT s.rule AS rule, count(*) AS rows FROM steps WHERE s.old <> s.new GROUP BY s.rule")
def rule_firings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulebooks.firings(traces(spark, sf_dir))

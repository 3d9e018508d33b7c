"""Queries over metrics of turns, run by the registry in two attempts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.functions.text import error_rate
from sonorant.operators import registry
from sonorant.queries.registry import query, rounded
from sonorant.queries.speech import DISTANCE, scored_turns
from sonorant.sources import views

KEYS, JUDGED = ("conv_id", "turn"), ("intent_entity", "semantic_match")

#: The judge's answer in an attempt: cut off in one of five, missing in one of eleven, without a verdict of meaning in one of 13.
ANSWERS = DISTANCE + """, k AS (SELECT *, array_to_string(r, '') AS a, array_to_string(h, '') AS b FROM d),
x AS (SELECT conv_id, turn, errors, length, levenshtein(a, b) AS ce, length(a) AS cl, t.attempt,
  CASE WHEN (conv_id * 7 + turn * 3 + t.attempt) % 11 = 0 THEN 'no answer' WHEN (conv_id * 7 + turn * 3 + t.attempt) % 5 = 0 THEN 'not an object' END AS bad, conv_id % 13 = 0 AS silent, (conv_id + turn) % 10 AS s FROM k, (VALUES (1), (2)) t(attempt)),
o AS (SELECT conv_id, turn, attempt, 'wer' AS metric, CASE WHEN length > 0 THEN errors / length WHEN errors > 0 THEN 1 ELSE 0 END AS value, NULL AS error FROM x
  UNION ALL SELECT conv_id, turn, attempt, 'cer', CASE WHEN cl > 0 THEN ce / cl WHEN ce > 0 THEN 1 ELSE 0 END, NULL FROM x
  UNION ALL SELECT conv_id, turn, attempt, 'intent_entity', CASE WHEN bad IS NULL THEN s / 10 END, bad FROM x
  UNION ALL SELECT conv_id, turn, attempt, 'semantic_match', CASE WHEN bad IS NULL AND NOT silent THEN (s >= 5)::INT END, CASE WHEN bad IS NOT NULL THEN 'ValueError: ' || bad WHEN silent THEN 'KeyError: ''same''' END FROM x)"""


def answered(spark: SparkSession, sf_dir: str, attempt: int) -> DataFrame:
    """Turns with their edit counts and the judge's answer in an attempt."""
    at, s = F.col("conv_id") * 7 + F.col("turn") * 3 + attempt, (F.col("conv_id") + F.col("turn")) % 10
    whole = F.concat(F.lit('{"score": 0.'), s.cast("string"), F.when(F.col("conv_id") % 13 == 0, "").otherwise(F.concat(F.lit(', "same": '), (s >= 5).cast("string"))), F.lit("}"))
    answer = F.when(at % 11 == 0, None).when(at % 5 == 0, F.substring(whole, 1, 12)).otherwise(whole)
    return scored_turns(spark, sf_dir).withColumn("answer", answer)


def meaning(answer: str | None) -> tuple[float, None, None]:
    if answer is None:
        raise ValueError("no answer")
    try:
        verdict = json.loads(answer)
    except json.JSONDecodeError:
        raise ValueError("not an object") from None
    return float(verdict["same"]), None, None


def rate(kind: str):
    errors, length = F.col(f"{kind}_errors"), F.col(f"{kind}_length")
    return registry.entry(error_rate(errors, length), errors, length)


METRICS = (
    registry.Metric("wer", lambda: rate("word"), needs=("word_errors", "word_length")),
    registry.Metric("cer", lambda: rate("char"), needs=("char_errors", "char_length")),
    registry.Metric(
        "intent_entity", lambda: registry.entry(F.get_json_object("answer", "$.score").cast("double")), needs=("answer",), judged=True,
        problem=lambda: F.when(F.col("answer").isNull(), "no answer").when(F.try_parse_json("answer").isNull(), "not an object"),
    ),
    registry.Metric("semantic_match", lambda: registry.guarded(meaning, F.col("answer")), needs=("answer",), judged=True),
)


def first_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.outcomes(registry.evaluated(answered(spark, sf_dir, 1), JUDGED, METRICS), KEYS)


@query(f"{ANSWERS} SELECT conv_id, turn, metric, round(value, 6)::DOUBLE AS value, error FROM o WHERE attempt = 1")
def metric_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric that fails in a turn leaves the turn's others."""
    return rounded(first_run(spark, sf_dir).select(*KEYS, "metric", "value", "error"))


@query(f"""{ANSWERS} SELECT conv_id, turn, metric, round(if(p.error IS NULL, p.value, q.value), 6)::DOUBLE AS value, if(p.error IS NULL, NULL, q.error) AS error, if(p.error IS NULL, 1, 2) AS attempts
FROM (SELECT * FROM o WHERE attempt = 1) p JOIN (SELECT * FROM o WHERE attempt = 2) q USING (conv_id, turn, metric)""")
def metric_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a second run, which tries the failed outcomes alone."""
    after = registry.again(answered(spark, sf_dir, 2), KEYS, JUDGED, METRICS, first_run(spark, sf_dir))
    return rounded(after.select(*KEYS, "metric", "value", "error", "attempts"))

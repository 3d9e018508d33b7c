"""Queries over JSON of judges and readers: the events' `props`, set into deeper objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.functions import payloads
from sonorant.queries.registry import query
from sonorant.sources import views

#: An answer about an agent; `{}` are the event's parts. Of 11 answers one is cut off, of 13 one is a list, of 17 one has no list of fields.
PARTS = (
    'Answer: {"use_case": "', "@use", '", "user_actions": ["say ', "@type", '", " ", null], "semantic_matters": ', "@truth", ', "fields": ', "@fields", ', "props": ', "@props", "}",
)
TRUTHS = ("true", "false", "null", "0", '"no"')


def glued(spark_: bool):
    """The same answer text for both engines, as a Spark column or as SQL."""
    if spark_:
        e, k = F.col("event_id"), F.get_json_object("props", "$.k")
        fields = F.when(e % 17 == 0, '"none"').otherwise(F.concat(F.lit('[{"name": " f'), k, F.lit(' ", "type": "'), F.when(e % 3 == 0, "Number").otherwise("colour"), F.lit('", "why": " w"}, {"name": " ", "type": "date"}, 7, {"why": "x"}, {"name": "p", "type": " DATE ", "why": '), k, F.lit("}]")))
        named = {"@use": F.when(e % 4 == 0, "  ").otherwise("Billing "), "@type": F.col("event_type"), "@truth": F.get(F.array(*map(F.lit, TRUTHS)), (e % 5).cast("int")), "@fields": fields, "@props": F.col("props")}
        whole = F.concat(*(named.get(p, F.lit(p)) for p in PARTS))
        return F.when(e % 11 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).when(e % 13 == 0, '["x"]').otherwise(whole)
    k = "json_extract_string(props, '$.k')"
    fields = f"""CASE WHEN event_id % 17 = 0 THEN '"none"' ELSE '[{{"name": " f' || {k} || ' ", "type": "' || CASE WHEN event_id % 3 = 0 THEN 'Number' ELSE 'colour' END || '", "why": " w"}}, {{"name": " ", "type": "date"}}, 7, {{"why": "x"}}, {{"name": "p", "type": " DATE ", "why": ' || {k} || '}}]' END"""
    truths = ", ".join(f"'{t}'" for t in TRUTHS)
    named = {"@use": "CASE WHEN event_id % 4 = 0 THEN '  ' ELSE 'Billing ' END", "@type": "event_type", "@truth": f"([{truths}])[(event_id % 5)::INT + 1]", "@fields": fields, "@props": "props"}
    whole = " || ".join(f"({named[p]})" if p in named else f"'{p}'" for p in PARTS)
    return f"CASE WHEN event_id % 11 = 0 THEN left({whole}, length({whole}) - 1) WHEN event_id % 13 = 0 THEN '[\"x\"]' ELSE {whole} END"


KINDS = ", ".join(f"'{k}'" for k in payloads.FIELD_KINDS)
PARSED = f"""t AS (SELECT event_id, regexp_extract({glued(False)}, '(?s)\\{{.*\\}}') AS body FROM events),
j AS (SELECT event_id, CASE WHEN json_valid(body) THEN body::JSON END AS v FROM t),
c AS (SELECT event_id, v, CASE WHEN v IS NULL THEN 'no object' WHEN json_type(v, '$.fields') NOT IN ('ARRAY', 'NULL') THEN 'fields are no list' END AS error,
  list_filter(list_transform(json_extract(v, '$.fields[*]'), lambda f: struct_pack(name := trim(coalesce(json_extract_string(f, '$.name'), '')), type := lower(trim(coalesce(json_extract_string(f, '$.type'), ''))), why := trim(coalesce(json_extract_string(f, '$.why'), '')))), lambda f: f.name <> '') AS fields,
  list_filter(list_transform(json_extract(v, '$.user_actions[*]'), lambda a: trim(coalesce(json_extract_string(a, '$'), ''))), lambda a: a <> '') AS actions FROM j)"""


@query(f"""WITH {PARSED} SELECT event_id, error, CASE WHEN error IS NULL THEN coalesce(nullif(trim(json_extract_string(v, '$.use_case')), ''), 'Unclassified') END AS use_case,
  CASE WHEN error IS NULL THEN array_to_string(actions, '|') END AS actions,
  CASE WHEN error IS NULL THEN CASE json_type(v, '$.semantic_matters') WHEN 'BOOLEAN' THEN json_extract_string(v, '$.semantic_matters') = 'true' WHEN 'VARCHAR' THEN json_extract_string(v, '$.semantic_matters') <> '' WHEN 'NULL' THEN false ELSE json_extract_string(v, '$.semantic_matters') <> '0' END END AS semantic_matters,
  CASE WHEN error IS NULL THEN array_to_string(list_transform(fields, lambda f: f.name || ':' || CASE WHEN f.type IN ({KINDS}) THEN f.type ELSE 'other' END || ':' || f.why), '|') END AS fields FROM c""")
def cleaned_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.table(spark, sf_dir, "events").select("event_id", payloads.requirements(glued(True)).alias("r"))
    text = lambda f: F.concat_ws(":", f["name"], f["type"], f["why"])
    return r.select("event_id", "r.error", "r.use_case", F.array_join("r.user_actions", "|").alias("actions"), "r.semantic_matters", F.array_join(F.transform("r.fields", text), "|").alias("fields"))


def request(e: Column) -> Column:
    level = F.get(F.array(*map(F.lit, ("", '"level": "word", ', '"level": "Story", ', '"level": "novel", ', '"level": null, '))), (e % 5).cast("int"))
    limit = F.when(e % 7 == 0, F.lit('"gop_threshold": "low", ')).when(e % 7 < 4, F.concat(F.lit('"gop_threshold": -'), (e % 4).cast("string"), F.lit(".5, "))).otherwise("")
    return F.concat(F.lit("{"), level, limit, F.lit('"text": " '), F.col("event_type"), F.lit(' ", "audio_decides": '), F.when(e % 2 == 0, "true").otherwise("[]"), F.when(e % 9 == 0, "").otherwise("}"))


@query("""WITH t AS (SELECT event_id AS e, event_type FROM events), x AS (SELECT *, CASE WHEN e % 9 = 0 THEN 'no object' WHEN e % 5 = 3 THEN 'unknown level: novel' WHEN e % 7 = 0 THEN 'threshold is no number' END AS error FROM t)
SELECT e AS event_id, error, CASE WHEN error IS NULL THEN '{"level":"' || CASE e % 5 WHEN 1 THEN 'word' WHEN 2 THEN 'story' ELSE 'paragraph' END || '","text":" ' || event_type || ' ","threshold":' || CASE WHEN e % 7 < 4 THEN '-' || (e % 4) || '.5' ELSE '-2.0' END || ',"audio_decides":' || (e % 2 = 0) || '}' END AS reply FROM x""")
def reading_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to score readings, in and out as JSON; those that can't be read are rows with their error."""
    r = views.table(spark, sf_dir, "events").select("event_id", payloads.reading_request(request(F.col("event_id"))).alias("r"))
    reply = F.when(F.col("r.error").isNull(), payloads.document(F.struct("r.level", "r.text", "r.threshold", "r.audio_decides")))
    return r.select("event_id", "r.error", reply.alias("reply"))

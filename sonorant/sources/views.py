"""Speech-shaped views over the given tables, in Spark. The catalogue's SQL has the same views for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result versions from events; forty events share a clip, so keys collide and grow with the events."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", k.alias("k"))
    errors, length = (F.col("k") % 7).cast("double"), F.when(F.col("event_id") % 53 == 0, 0).otherwise(5 + F.col("k") % 20).cast("double")
    entry = lambda v, n, m: F.struct(v.alias("value"), F.lit(None).cast("string").alias("error"), n.alias("errors"), m.alias("length"))
    none = F.lit(None).cast("double")
    wer = F.when(length == 0, F.when(errors == 0, 0.0).otherwise(1.0)).otherwise(errors / F.nullif(length, F.lit(0.0)))
    match = F.when(F.col("event_id") % 5 == 0, None).when(F.col("k") % 3 == 0, 0.0).otherwise(1.0)
    return e.select(
        F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string")).alias("run_id"),
        F.concat(F.lit("clip"), F.expr("event_id div 40").cast("string")).alias("clip_id"),
        F.col("event_type").alias("provider"),
        F.when(F.col("event_id") % 17 == 0, "failed").otherwise("ok").alias("status"),
        (F.col("value") / 100).alias("latency_seconds"),
        F.when(F.col("event_id") % 97 == 0, 0).otherwise(1 + F.col("event_id") % 30).cast("double").alias("duration_seconds"),
        (F.col("event_id") % 4 != 0).alias("sampled"),
        F.create_map(F.lit("wer"), entry(wer, errors, length), F.lit("semantic_match"), entry(match, none, none)).alias("metrics"),
        F.col("event_id").alias("updated_at"),
    )


def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonorant.operators.results import latest

    return latest(results(spark, sf_dir))


def damaged(texts: DataFrame, n: str) -> DataFrame:
    """texts (text, n, others) with r and h in place of text: all tokens of the text, and a damaged copy of them."""
    tokens = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda x: x != "")
    heard = F.transform("r", lambda x, i: F.when((i + 1 + F.col(n)) % 7 == 0, None).when((i + 1 + F.col(n)) % 5 == 0, F.concat(x, F.lit("x"))).otherwise(x))
    return texts.withColumn("r", tokens).withColumn("h", F.filter(heard, lambda x: x.isNotNull())).drop("text")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, r and h of whole documents."""
    return damaged(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, r and h of whole turns of conversations."""
    return damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "turn")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utterance, seq, arrival, audio_end, is_final, text, ts: a transcription stream from events."""
    e = table(spark, sf_dir, "events").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    begun = e.groupBy("user_id").agg(F.min("micros").alias("begun"))
    end = F.col("arrival") - F.col("value") / 100 + F.when(F.col("event_id") % 10 == 0, 10.0).otherwise(0.0)
    out = e.join(begun, "user_id").withColumn("arrival", (F.col("micros") - F.col("begun")) / 1e6).withColumn("audio_end", end)
    return out.select(F.col("user_id").alias("utterance"), F.col("event_id").alias("seq"), "arrival", "audio_end", F.col("event_type").isin("purchase", "signup").alias("is_final"), F.concat(F.lit("w"), (F.col("event_id") % 50).cast("string")).alias("text"), F.timestamp_micros("micros").alias("ts"))

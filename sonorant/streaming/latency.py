"""Latency of partial and final transcripts, over tables or streams.

Events have utterance, seq, arrival, audio_end (seconds), is_final and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonorant.operators.results import nearest_rank


def with_latency(events: DataFrame) -> DataFrame:
    """A projection, so it runs on streams as it is: latency, never below 0."""
    return events.withColumn("latency", F.greatest(F.lit(0.0), F.col("arrival") - F.col("audio_end")))


def summary(events: DataFrame) -> DataFrame:
    """For each utterance: partials, finals, arrival of the first partial, median latency of partials and of finals, and the
    finals' nearest-rank 95th percentile."""
    e = with_latency(events)
    final = F.col("is_final")
    out = e.groupBy("utterance").agg(
        F.count_if(~final).cast("long").alias("partials"),
        F.count_if(final).cast("long").alias("finals"),
        F.min(F.when(~final, F.col("arrival"))).alias("first_partial"),
        F.percentile(F.when(~final, F.col("latency")), 0.5).alias("partial_median"),
        F.percentile(F.when(final, F.col("latency")), 0.5).alias("final_median"),
    )
    p95 = nearest_rank(e.where("is_final"), ["utterance"], "latency", [("final_p95", 0.95)])
    return out.join(p95, "utterance", "left")


def real_time(sessions: DataFrame) -> DataFrame:
    """sessions (utterance, pacing, audio_seconds, wall_seconds) with rtf, which only audio sent as fast as possible has: paced
    as it was spoken, the clock tells nothing of the engine. A projection, so it runs on streams."""
    fast = (F.col("pacing") == "fast") & (F.col("audio_seconds") > 0)
    return sessions.withColumn("rtf", F.when(fast, F.col("wall_seconds") / F.col("audio_seconds")))


def transcripts(events: DataFrame) -> DataFrame:
    """The finals of each utterance, joined in the order of arrival."""
    parts = F.array_sort(F.collect_list(F.struct("arrival", "seq", "text")))
    return events.where("is_final").groupBy("utterance").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("transcript"))


def pauses(timed: DataFrame) -> DataFrame:
    """Timed words (utterance, seq, start, stop) -> words, words a minute (null below two words or without a span) and the
    longest pause between a word and the next."""
    from pyspark.sql import Window

    by = Window.partitionBy("utterance").orderBy("start", "seq")
    p = timed.withColumn("pause", F.lead("start").over(by) - F.col("stop"))
    t = p.groupBy("utterance").agg(F.count("*").alias("words"), F.min_by("start", F.struct("start", "seq")).alias("a"), F.max_by("stop", F.struct("start", "seq")).alias("b"), F.max("pause").alias("longest_pause"))
    span = F.col("b") - F.col("a")
    return t.select("utterance", "words", F.when((F.col("words") >= 2) & (span > 0), 60 * F.col("words") / span).alias("wpm"), "longest_pause")


def session_summary(events: DataFrame, watermark: str = "10 minutes", gap: str = "5 minutes") -> DataFrame:
    """For streams with an event time `ts`: counts and the latency sum of each session of an utterance, emitted once the
    watermark has passed it; later events are dropped."""
    e = with_latency(events).withWatermark("ts", watermark)
    return e.groupBy(F.session_window("ts", gap), "utterance").agg(F.count("*").alias("events"), F.count_if("is_final").alias("finals"), F.sum("latency").alias("latency_sum"))


def append_new(batch: DataFrame, path: str, keys: list[str]) -> None:
    """For foreachBatch: append the rows whose keys the table at `path` lacks, so a batch that runs twice adds nothing."""
    spark = batch.sparkSession
    rows = batch.dropDuplicates(keys)
    try:
        rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").parquet(path)

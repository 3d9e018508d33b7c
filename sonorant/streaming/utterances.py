"""Summaries of utterances on unbounded streams.

Each utterance is a key of a stateful operator: the sequence numbers seen, the latencies of partials and of finals as sorted runs,
and the finals in the order of arrival. A batch's events are merged into the runs, so medians, nearest-rank percentiles and the
transcript are exact whatever the order, and repeated events change nothing. A timer on the watermark closes an utterance that has
been silent for long enough and frees its state. State is as large as the utterance, one recording; it is held in RocksDB and
checkpointed, so a lost executor loses none."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from sonorant.operators.results import latest
from sonorant.session import scratch

#: The state store that keyed state and timers need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATE = "seqs array<long>, partials array<double>, finals array<double>, first_partial double, last long, said_at array<double>, said_seq array<long>, said array<string>"
SUMMARY = "utterance long, partials long, finals long, first_partial double, partial_median double, final_median double, final_p95 double, transcript string, closed boolean"


def nearest_rank_of(run: list[float], share: float) -> float | None:
    """Of a sorted run the value at round_half_even(share * n + 0.5), at least the first and at most the last."""
    return run[max(1, min(len(run), round(share * len(run) + 0.5))) - 1] if run else None


def summarized(key: int, state: tuple, closed: bool) -> pd.DataFrame:
    _, partials, finals, first, _, _, _, said = state
    middle = lambda run: median(run) if run else None
    row = (key, len(partials), len(finals), first, middle(partials), middle(finals), nearest_rank_of(finals, 0.95), " ".join(said) if finals else None, closed)
    return pd.DataFrame([row], columns=[c.split(" ")[0] for c in SUMMARY.split(", ")])


class Utterance(StatefulProcessor):
    """Events (utterance, seq, arrival, audio_end, is_final, text, ts) of one utterance -> its summary so far, after each batch that
    has some of its events and, closed, when `silence` milliseconds of event time have passed without any."""

    def __init__(self, silence: int) -> None:
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("utterance", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = tuple(self.held.get()) if self.held.exists() else ([], [], [], None, 0, [], [], [])
        seqs, partials, finals, first, last = (list(v) if isinstance(v, (list, tuple)) else v for v in known[:5])
        said = [*zip(*known[5:], strict=True)]
        seen = set(seqs)
        for batch in rows:
            for seq, arrival, end, is_final, text, ts in zip(batch["seq"], batch["arrival"], batch["audio_end"], batch["is_final"], batch["text"], batch["ts"], strict=True):
                if seq in seen:
                    continue
                seen.add(seq)
                seqs.append(int(seq))
                (finals if is_final else partials).append(max(0.0, float(arrival - end)))
                last = max(last, int(pd.Timestamp(ts).timestamp() * 1000))
                if is_final:
                    said.append((float(arrival), int(seq), text))
                else:
                    first = float(arrival) if first is None else min(first, float(arrival))
        # Two sorted runs, nearly: sorting merges them.
        state = (sorted(seqs), sorted(partials), sorted(finals), first, last, *([list(c) for c in zip(*sorted(said), strict=True)] or [[], [], []]))
        self.held.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.silence)
        yield summarized(int(key[0]), state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            state = tuple(self.held.get())
            self.held.clear()
            yield summarized(int(key[0]), state, True)

    def close(self) -> None:
        pass


def summaries(events: DataFrame, delay: str, silence_ms: int) -> DataFrame:
    """A stream of events (with `ts`, their event time) as a stream of summaries, in update mode: the newest of an utterance holds
    all its events. Events later than `delay` behind the newest are dropped."""
    keyed = events.withWatermark("ts", delay).groupBy("utterance")
    return keyed.transformWithStateInPandas(Utterance(silence_ms), SUMMARY, "Update", "EventTime")


def replayed(spark: SparkSession, events: DataFrame, slices: int = 3, delay: str = "3650 days", silence_ms: int = 3_600_000) -> DataFrame:
    """A table of events replayed as a stream of files, a micro-batch for each slice, which may have any number of files: dealt by a
    hash, so events come late and out of order, and the first slice comes twice. The stream stops after each slice and goes on from
    its checkpoint when the next one has arrived. -> the newest summary of each utterance."""
    dealt, source, sink, check = (scratch(spark, f"replay-{n}") for n in ("dealt", "in", "out", "checkpoint"))
    events.withColumn("slice", F.pmod(F.xxhash64("seq"), F.lit(slices))).write.partitionBy("slice").parquet(dealt)
    every = spark.read.schema(StructType([*events.schema, StructField("slice", LongType())])).parquet(dealt)
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        # A folder for each batch, so that a batch that runs again replaces its rows.
        write = lambda rows, batch: rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{sink}/of={batch}")
        for k in [*range(slices), 0]:
            every.where(F.col("slice") == k).drop("slice").write.mode("append").parquet(source)
            stream = spark.readStream.schema(events.schema).parquet(source)
            summaries(stream, delay, silence_ms).writeStream.outputMode("update").option("checkpointLocation", check).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], before) if before else spark.conf.unset(PROVIDER[0])
    return latest(spark.read.parquet(sink).drop("of"), ["utterance"], "batch").drop("batch")

"""Keyed state of utterances: files that arrive one by one, closing by the watermark."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sonorant.streaming import latency, utterances

SCHEMA = "utterance long, seq long, arrival double, audio_end double, is_final boolean, text string, ts timestamp"
START = datetime(2024, 1, 1)


def event(u, seq, at, end, final, text="x"):
    return (u, seq, float(at), float(end), final, text, START + timedelta(seconds=at))


def test_replay_equals_the_table(spark):
    rows = [event(u, u * 100 + k, 3 * k + u, 3 * k + u - (k * 7 % 5), k % 3 == 0, f"w{k}") for u in range(6) for k in range(10 + u)] + [event(9, 1, 1, 5, False)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = utterances.replayed(spark, df).drop("closed")
    want = latency.summary(df).join(latency.transcripts(df), "utterance", "left").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_silent_utterances_close_and_late_events_are_dropped(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    files = [
        [event(1, 1, 1, 0, False), event(1, 2, 2, 1, True, "b"), event(2, 1, 2, 2, True, "z")],
        [event(1, 3, 1.5, 1, True, "a"), event(1, 2, 2, 1, True, "b")],  # earlier and repeated
        [event(3, 1, 1000, 999, False)],  # the watermark passes the others
        [event(3, 2, 1001, 999, False)],
        [event(1, 4, 3, 1, True, "late"), event(3, 3, 1002, 1000, True, "c")],
    ]
    for f in files:
        spark.createDataFrame(f, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    spark.conf.set(*utterances.PROVIDER)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    out = utterances.summaries(stream, "10 seconds", 60_000).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
    q = out.foreachBatch(lambda b, k: b.withColumn("batch", F.lit(k)).write.mode("append").parquet(sink)).trigger(availableNow=True).start()
    q.awaitTermination(200)
    spark.conf.unset(utterances.PROVIDER[0])
    got = spark.read.parquet(sink).orderBy("batch").collect()
    closed = {r.utterance: r for r in got if r.closed}
    assert set(closed) == {1, 2}
    assert (closed[1].partials, closed[1].finals, closed[1].transcript, closed[1].final_median) == (1, 2, "a b", 0.75)
    assert not any("late" in (r.transcript or "") for r in got)
    last = [r for r in got if r.utterance == 3][-1]
    assert (last.partials, last.finals, last.first_partial, last.closed) == (2, 1, 1000.0, False)


def test_ranks_of_short_runs():
    assert utterances.nearest_rank_of([], 0.95) is None
    assert [utterances.nearest_rank_of([1.0, 2.0, 3.0, 4.0], s) for s in (0.0, 0.5, 1.0)] == [1.0, 2.0, 4.0]


def test_a_slice_is_written_by_several_tasks(spark, monkeypatch):
    folders, scratch = {}, utterances.scratch
    monkeypatch.setattr(utterances, "scratch", lambda spark, name: folders.setdefault(name, scratch(spark, name)))
    rows = [event(u, u * 100 + k, k, k, k % 3 == 0) for u in range(8) for k in range(20)]
    assert utterances.replayed(spark, spark.createDataFrame(rows, SCHEMA).repartition(4)).count() == 8
    assert len(spark.read.parquet(folders["replay-in"]).inputFiles()) > 4  # one for each of the four batches before
    assert spark.read.parquet(folders["replay-out"]).select("batch").distinct().count() >= 4

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonorant.operators import ladder
from sonorant.sources import store, truth, wav
from sonorant.streaming import latency


def test_truth_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text("\ufeff ID ,Transcript\na.wav,\na.wav,one\na.mp3,two\n,three\nb,\"four, five\"\n", "utf-8")
    good, bad = truth.read_truth(spark, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, good.collect())) == [("a", "one"), ("b", "four, five")]
    assert sorted((r.line, r.reason) for r in bad.collect()) == [(2, "empty_text"), (4, "duplicate_id"), (5, "empty_id")]
    (tmp_path / "u.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        truth.read_truth(spark, str(tmp_path / "u.csv"))


def test_lines_of_several_files(spark, tmp_path):
    for name, rows in (("a", "x,\ny,yes\nz,\"two\nlines\"\n,none\n"), ("b", "y,again\nw,\nv,ok\nz,again\n"), ("c", "w,late\nx,\n")):
        (tmp_path / f"{name}.csv").write_text("id,text\n" + rows)
    good, bad = truth.read_truth(spark, str(tmp_path))
    assert sorted(r.id for r in good.collect()) == ["v", "w", "y", "z"]
    got = sorted((r.file[-5:], r.line, r.reason) for r in bad.collect())
    assert got == [("a.csv", 2, "empty_text"), ("a.csv", 5, "empty_id"), ("b.csv", 2, "duplicate_id"), ("b.csv", 3, "empty_text"), ("b.csv", 5, "duplicate_id"), ("c.csv", 3, "empty_text")]


def test_export_has_all_columns(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2, 3.0)], "a int, c double")
    truth.export_csv([a, b], str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["a", "b", "c"]


def test_store_keeps_the_newest(spark, tmp_path):
    path = str(tmp_path)
    old = "run_id string, clip_id string, provider string, status string, updated_at long"
    store.append(spark.createDataFrame([("r1", "c", "p", "failed", 1), ("r2", "c", "p", "ok", 1)], old), path)
    store.append(spark.createDataFrame([("r1", "c", "p", "ok", 2, False)], old + ", sampled boolean"), path)
    got = {r.run_id: (r.status, r.sampled, r.language) for r in store.results(spark, path).collect()}
    assert got == {"r1": ("ok", False, ""), "r2": ("ok", True, "")}
    store.drop_run(spark, path, "r1")
    assert [r.run_id for r in store.results(spark, path).collect()] == ["r2"] and store.results(spark, path, "r1").count() == 0
    runs = spark.createDataFrame([("r1", 5.0, "a", 1), ("r1", 9.0, "b", 2), ("r2", 7.0, "c", 1)], "run_id string, created_at double, language string, updated_at long")
    store.append_runs(runs, path)
    assert [(r.run_id, r.created_at, r.language) for r in store.runs(spark, path).collect()] == [("r2", 7.0, "c"), ("r1", 5.0, "b")]


def test_wav(spark, tmp_path):
    t = np.arange(8000 * 3)
    x = np.where((t > 15_000) & (t < 17_000), 0, 9000 * np.sin(t / 5))
    (tmp_path / "one.wav").write_bytes(wav.encode(x, 8000))
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    clips = {r.clip_id: r for r in wav.read(spark, str(tmp_path)).collect()}
    assert clips["one"].duration_seconds == 3.0 and clips["one"].upsampled and clips["bad"].error
    f = wav.frames(wav.read(spark, str(tmp_path))).orderBy("frame").collect()
    assert len(f) == 30 and f[1].audio_start == 0.1 and len(f[0].pcm) == 3200
    parts = [wav.decode(p)[0] for p in wav.pieces(wav.encode(x, 8000), 2.5)]
    assert len(parts) == 2 and sum(map(len, parts)) == len(x) and 15_000 < len(parts[0]) < 17_000


def test_verdict_metrics(spark):
    df = spark.createDataFrame([((1.7, 3, 2, " ok "), (0, -2, "x"))], "i struct<score:double,entities_total:int,entities_preserved:int,reasoning:string>, s struct<reference_words:int,semantic_errors:int,reasoning:string>")
    r = df.select(ladder.intent_entity(F.col("i")).alias("i"), ladder.semantic_wer(F.col("s"), F.lit(4)).alias("s"), ladder.semantic_match(F.lit(True), F.lit("")).alias("m"), ladder.without_judge(["llm_wer"]).alias("n")).first()
    assert r.i.value == 1.0 and r.i.reasoning == "2/3 key entities preserved. ok" and (r.s.value, r.s.length) == (0.0, 4.0) and r.m.value == 1.0
    assert r.n["llm_wer"].error == "No judge configured."


def test_forgiven_segments(spark):
    pairs = spark.createDataFrame([(1, ["a", "b", "c", "d"], ["x", "b", "y", "d", "z"]), (2, ["a"], ["a"])], "id int, r array<string>, h array<string>")
    verdicts = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 9, True)], "id int, segment long, equivalent boolean")
    got = {r.id: r for r in ladder.forgiven_wer(pairs, verdicts, "id").collect()}
    assert (got[1].forgiven, got[1].segments, got[1].llm_wer.errors, got[1].llm_wer.value) == (1, 3, 2.0, 0.5)
    assert got[2].llm_wer.value == 0.0 and got[2].segments == 0


def test_critical_fields(spark):
    fields = spark.createDataFrame([(1, "amount", "number"), (1, "day", "date")], "id int, name string, type string")
    verdicts = spark.createDataFrame([(1, "amount", True, "5", "same")], "id int, name string, preserved boolean, heard_as string, reason string")
    r = ladder.critical_fields(fields, verdicts, ["id"]).first()
    assert (r.critical_fields.value, r.critical_fields.errors, r.critical_fields.length) == (0.5, 1.0, 2.0)
    assert not r.fields["day"].preserved and r.fields["day"].reason == "not reported by the judge"


def test_stream_equals_table(spark, tmp_path):
    rows = [(k % 3, k, float(k), k - 0.5 * (k % 4), k % 2 == 0, f"w{k}") for k in range(60)]
    df = spark.createDataFrame(rows, "utterance long, seq long, arrival double, audio_end double, is_final boolean, text string")
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        df.where(f"seq div 20 = {k}").coalesce(1).write.mode("append").parquet(source)
    stream = latency.with_latency(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source))

    def batch(b, _):
        latency.append_new(b, sink, ["seq"])
        latency.append_new(b, sink, ["seq"])  # a batch that runs again adds nothing

    q = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(batch).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(sink)
    assert got.count() == 60
    assert sorted(map(tuple, latency.summary(got.drop("latency")).collect())) == sorted(map(tuple, latency.summary(df).collect()))
    assert latency.transcripts(df).count() == 3

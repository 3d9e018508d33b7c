"""The result store: ties, null versions, repeated writes, dropped runs, compaction, streams of batches."""

from pyspark.sql import functions as F

from sonorant.operators.results import latest
from sonorant.sources import store

SCHEMA = "run_id string, clip_id string, provider string, status string, updated_at long, metrics map<string, double>"


def rows(spark, *values):
    return spark.createDataFrame([(*v, {"wer": 0.5}) for v in values], SCHEMA)


def seen(df):
    return sorted(((r.run_id, r.clip_id, r.provider, r.status, r.updated_at) for r in df.collect()), key=str)


def test_latest_gives_each_key_once(spark):
    df = rows(spark, ("r", "a", "p", "ok", 2), ("r", "a", "p", "ok", 2), ("r", "a", "p", "failed", 1), ("r", "b", "p", "ok", None), ("r", "c", "p", "x", 5), ("r", "c", "p", "y", 5), (None, "a", "p", "ok", 1))
    got = seen(latest(df.repartition(3)))
    assert len(got) == 4 and ("r", "a", "p", "ok", 2) in got and ("r", "b", "p", "ok", None) in got and (None, "a", "p", "ok", 1) in got
    assert got == seen(latest(df.orderBy(F.desc("status")).repartition(2)))  # the same of two rows that tie
    assert latest(df.where("false")).count() == 0 and latest(df).columns == df.columns


def test_a_write_that_is_repeated_is_read_once(spark, tmp_path):
    path = str(tmp_path)
    one = rows(spark, ("r1", "a", "p", "failed", None), ("r1", "b", "p", "ok", None))
    store.append(one, path)
    store.append(one, path)
    assert seen(store.results(spark, path)) == seen(one)
    store.append(rows(spark, ("r1", "a", "p", "ok", None)), path, "retry")
    store.append(rows(spark, ("r1", "a", "p", "lost", None)), path, "retry")  # the name is known: not written
    assert seen(store.results(spark, path)) == [("r1", "a", "p", "ok", None), ("r1", "b", "p", "ok", None)]
    assert store.results(spark, path, "r2").count() == 0


def test_a_late_old_version_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    store.append(rows(spark, ("r1", "a", "p", "ok", 9), ("r1", "b", "p", "ok", 1)), path)
    store.compact(spark, path)
    store.append(rows(spark, ("r1", "a", "p", "old", 3), ("r1", "b", "p", "new", 2), ("r1", "c", "p", "ok", 1)), path)
    want = [("r1", "a", "p", "ok", 9), ("r1", "b", "p", "new", 2), ("r1", "c", "p", "ok", 1)]
    assert seen(store.results(spark, path)) == want
    store.compact(spark, path)
    assert seen(store.results(spark, path)) == want


def test_a_compacted_store_is_read_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path)
    for k in range(3):
        store.append(rows(spark, *(("r1", f"c{i}", "p", f"s{k}", k) for i in range(20))), path)
    assert "Exchange" in store.results(spark, path)._jdf.queryExecution().executedPlan().toString()
    store.compact(spark, path)
    got = store.results(spark, path)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert got.count() == 20 and {r.status for r in got.collect()} == {"s2"}


def test_dropped_runs_are_gone_and_can_come_back(spark, tmp_path):
    path = str(tmp_path)
    runs = lambda *r: spark.createDataFrame(list(r), "run_id string, created_at double, updated_at long, title string")
    store.append(rows(spark, ("r1", "a", "p", "ok", 1), ("r2", "a", "p", "ok", 1)), path)
    store.append_runs(runs(("r1", 5.0, 1, "x"), ("r2", 7.0, 1, "y"), ("r1", 9.0, 2, "z")), path)
    store.drop_run(spark, path, "r1")
    assert [r.run_id for r in store.results(spark, path).collect()] == ["r2"] == [r.run_id for r in store.runs(spark, path).collect()]
    store.compact(spark, path)
    assert [r.run_id for r in store.results(spark, path).collect()] == ["r2"] == [r.run_id for r in store.runs(spark, path).collect()]
    store.append(rows(spark, ("r1", "b", "p", "ok", 1)), path)
    store.append_runs(runs(("r1", 11.0, 1, "again")), path)
    assert seen(store.results(spark, path, "r1")) == [("r1", "b", "p", "ok", 1)]
    assert [(r.run_id, r.created_at, r.title) for r in store.runs(spark, path).collect()] == [("r1", 11.0, "again"), ("r2", 7.0, "y")]


def test_a_stream_of_batches(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "store")
    for status, version in (("failed", 1), ("ok", 2), ("ok", 2)):
        rows(spark, *(("r1", f"c{i}", "p", status, version) for i in range(10))).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    write = store.sink(path, "s")

    def twice(batch, number):
        write(batch, number)
        write(batch, number)

    q = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(twice).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.kind for r in store.log(spark, path)] == ["results"] * 3
    got = store.results(spark, path).collect()
    assert len(got) == 10 and {r.status for r in got} == {"ok"}


def test_an_unfinished_write_is_not_seen(spark, tmp_path):
    path = str(tmp_path)
    store.append(rows(spark, ("r1", "a", "p", "ok", 1)), path)
    rows(spark, ("r1", "b", "p", "ok", 1)).withColumn("commit", F.lit(2).cast("long")).write.parquet(f"{path}/results-halfway")
    assert store.results(spark, path).count() == 1

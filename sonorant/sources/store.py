"""Results as an append-only store of commits; the newest version of a row wins.

A commit is a folder of Parquet files (a delta) and one line in the log, written after the files, so that a write that fails
halfway is never seen. A named write that is in the log already is not repeated; rows that are written again all the same are
read once, as a commit's number breaks ties of versions. Compaction writes one row for each key as a base: where no delta follows
it, reading is a scan without a shuffle; else only the keys in the deltas are looked up. Dropping a run is a line in the log, and
the next compaction leaves its rows out. The log is metadata: a line for each commit."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.operators.results import latest, latest_run

#: Columns that older files may lack, with what they then hold.
DEFAULT_VALUES = {"language": "", "sampled": True}
KEYS = ("run_id", "clip_id", "provider")
LOG = "commit long, kind string, folder string, batch string, run_id string"


def log(spark: SparkSession, path: str) -> list:
    """The log's lines, oldest first; none where nothing was written yet."""
    try:
        return sorted(spark.read.schema(LOG).json(f"{path}/log").collect(), key=lambda r: (r.commit, r.kind != "base", r.folder or ""))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []


def next_commit(lines: list) -> int:
    return max((r.commit for r in lines), default=0) + 1


def noted(spark: SparkSession, path: str, commit: int, kind: str, folder: str | None = None, batch: str | None = None, run_id: str | None = None) -> None:
    spark.createDataFrame([(commit, kind, folder, batch, run_id)], LOG).coalesce(1).write.mode("append").json(f"{path}/log")


def written(rows: DataFrame, path: str, kind: str, batch: str | None) -> None:
    spark = rows.sparkSession
    lines = log(spark, path)
    if batch is not None and any(r.kind == kind and r.batch == batch for r in lines):
        return
    commit, folder = next_commit(lines), f"{kind}-{uuid.uuid4().hex}"
    # Sorted by run, so that the files' statistics prune the reading of one run.
    rows.drop("commit").withColumn("commit", F.lit(commit).cast("long")).sortWithinPartitions("run_id").write.parquet(f"{path}/{folder}")
    noted(spark, path, commit, kind, folder, batch)


def append(results: DataFrame, path: str, batch: str | None = None) -> None:
    """Add versions. A `batch` names the write: a second one of the same name does nothing."""
    written(results, path, "results", batch)


def append_runs(runs: DataFrame, path: str, batch: str | None = None) -> None:
    written(runs, path, "runs", batch)


def sink(path: str, name: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of the stream `name`: batches are commits, so one that runs again adds nothing, a retried row replaces the
    failed one, and no batch reads what others wrote."""
    return lambda batch, number: append(batch, path, f"{name}-{number}")


def held(spark: SparkSession, path: str, kind: str, lines: list, run_id: str | None) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of the newest base, rows of the deltas after it), without dropped runs."""
    base = max((r for r in lines if r.kind == f"{kind}-base"), key=lambda r: (r.commit, r.folder), default=None)
    since = base.commit if base else 0
    deltas = [r.folder for r in lines if r.kind == kind and r.commit > since]
    dropped = [(r.run_id, r.commit) for r in lines if r.kind == "drop"]

    def read(folders: list[str]) -> DataFrame | None:
        if not folders:
            return None
        rows = spark.read.option("mergeSchema", "true").parquet(*(f"{path}/{f}" for f in folders))
        rows = rows.where(F.col("run_id") == run_id) if run_id is not None else rows
        if dropped:
            gone = spark.createDataFrame(dropped, "gone string, upto long").groupBy("gone").agg(F.max("upto").alias("upto"))
            rows = rows.join(gone, (F.col("run_id") == F.col("gone")) & (F.col("commit") <= F.col("upto")), "left_anti")
        return rows

    return read([base.folder] if base else []), read(deltas)


def newest(spark: SparkSession, path: str, run_id: str | None) -> DataFrame:
    """The newest version of each result, with its commit."""
    base, deltas = held(spark, path, "results", log(spark, path), run_id)
    if base is None and deltas is None:
        raise ValueError("nothing was written to the store yet")
    if deltas is None:
        return base
    version = ("updated_at", "commit")
    if base is None:
        return latest(deltas, KEYS, version)
    keys = deltas.select(*KEYS).distinct()
    same = reduce(lambda a, b: a & b, (base[k].eqNullSafe(keys[k]) for k in KEYS))
    both = base.join(keys, same, "left_semi").unionByName(deltas, allowMissingColumns=True)
    return base.join(keys, same, "left_anti").unionByName(latest(both, KEYS, version), allowMissingColumns=True)


def results(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The newest version of each result, missing columns filled."""
    rows = newest(spark, path, run_id).drop("commit")
    for c, v in DEFAULT_VALUES.items():
        rows = rows.withColumn(c, F.coalesce(c, F.lit(v)) if c in rows.columns else F.lit(v))
    return rows


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The runs, newest first."""
    base, deltas = held(spark, path, "runs", log(spark, path), None)
    rows = base if deltas is None else deltas if base is None else base.unionByName(deltas, allowMissingColumns=True)
    if rows is None:
        raise ValueError("nothing was written to the store yet")
    return latest_run(rows, ("updated_at", "commit")).drop("commit").orderBy(F.desc("created_at"), "run_id")


def drop_run(spark: SparkSession, path: str, run_id: str) -> None:
    """From now on no reader sees the run, its results or itself; what is written under its id later is a new run."""
    lines = log(spark, path)
    noted(spark, path, next_commit(lines), "drop", run_id=run_id)


def compact(spark: SparkSession, path: str) -> None:
    """Write the newest version of each result, and the runs, as bases that hold all commits so far."""
    lines = log(spark, path)
    upto = max((r.commit for r in lines), default=0)
    for kind, rows in (("results", lambda: newest(spark, path, None)), ("runs", lambda: latest_run(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r for r in held(spark, path, "runs", lines, None) if r is not None]), ("updated_at", "commit")))):
        if any(r.kind in (kind, f"{kind}-base") for r in lines):
            folder = f"{kind}-base-{uuid.uuid4().hex}"
            rows().sortWithinPartitions("run_id").write.parquet(f"{path}/{folder}")
            noted(spark, path, upto, f"{kind}-base", folder)

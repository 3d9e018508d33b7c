"""A Spark session with the settings that the operators assume."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a wide table that one task of a shuffle takes.
TASK_ROWS = 250_000


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """AQE on, Arrow on, UTC. A cluster's own settings win where they are set before."""
    builder = SparkSession.builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share (spark.checkpoint.dir). Only a local session may lack that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tasks_for(df: DataFrame) -> int:
    """Into how many tasks a shuffle of df is dealt, so that a task's memory does not grow with the table: left to itself, Spark joins
    small shuffle blocks until there are as many tasks as cores. Of a stored table, counting reads its footers alone."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))

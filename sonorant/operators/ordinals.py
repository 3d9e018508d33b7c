"""Gapless numbers of rows in an order, without a window over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonorant.session import scratch


def numbered(rows: DataFrame, order: Sequence[str], name: str = "ordinal", start: int = 1) -> DataFrame:
    """rows with `name`: their place in the order, nulls first, rows that share a place by a hash of the whole row. Rows that are
    equal in everything are numbered one after the other.

    Ranges of the order are sorted and written, so the numbers of a run never change though an executor is lost. A row's number is
    how many rows stand in the files before its own, a table of one row for each file, and its own index within the file. Ranges
    follow the hash and the reading order too, so that a key that a third of the rows hold is still parted."""
    spark = rows.sparkSession
    if not rows.columns or name in rows.columns:
        raise ValueError(f"the rows must not have a column {name!r} yet")
    hashed = F.xxhash64(*(F.to_json(c) if "map<" in t or "variant" in t else F.col(f"`{c}`") for c, t in rows.dtypes))
    marked = rows.withColumns({"__hash": hashed, "__read": F.monotonically_increasing_id()})
    keys = [*(F.col(f"`{c}`").asc_nulls_first() for c in order), F.col("__hash").asc(), F.col("__read").asc()]
    path = scratch(spark, "ordinals")
    ranged = marked.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__hash", "__read")
    ranged.withColumn("__range", F.spark_partition_id()).write.parquet(path)
    kept = spark.read.parquet(path)
    placed = kept.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    files = placed.groupBy("__range", "__file").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range", "__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select(F.col("__file"), before.alias("__before"))
    number = (F.col("__before") + F.col("__index") + start).alias(name)
    return placed.join(starts, "__file").select(*(f"`{c}`" for c in rows.columns), number)

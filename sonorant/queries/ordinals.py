"""Queries whose rows are numbered in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.operators.ordinals import numbered
from sonorant.queries.events import RESULTS, read
from sonorant.queries.registry import query
from sonorant.sources import views


@query(f"WITH {RESULTS} SELECT run_id, clip_id, provider, status, row_number() OVER (ORDER BY clip_id, provider, run_id) AS ordinal FROM r")
def ordered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest results by clip, then provider."""
    return numbered(read(spark, sf_dir).select("run_id", "clip_id", "provider", "status"), ["clip_id", "provider", "run_id"])


@query("SELECT doc_id, source, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST) AS ordinal FROM documents")
def ordered_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset's clips by source and id; a source may hold a third of them."""
    return numbered(views.table(spark, sf_dir, "documents").select("doc_id", F.col("source")), ["source", "doc_id"])

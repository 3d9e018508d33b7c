"""Connected components of a link table, by contraction.

Each round maps every node to the neighbour (or itself) that comes first in an order drawn anew for the round, rewrites the
links with it and drops loops and repeats. The random order at least halves the nodes of a path in expectation, and a star
or a dense group collapses at once, so the rounds follow the logarithm of the longest chain. Nothing is gathered anywhere:
a round is one aggregation (combined before the shuffle, so a hub costs one row for each task) and two equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonorant.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long), in any order, repeats and loops allowed -> (node long, root long), one row for each node of a
    link between two nodes; equal roots mean connected. Rows with a null end are ignored. The root is some node of the
    component, not the smallest one. No links: an empty table."""
    edges = materialize(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "links")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        order = F.xxhash64("n", F.lit(len(levels) + 1))
        ends = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).union(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
        near = ends.groupBy("n").agg(F.min(F.struct(F.xxhash64("m", F.lit(len(levels) + 1)).alias("o"), F.col("m").alias("v"))).alias("x"))
        step = materialize(near.select("n", F.when(F.struct(order.alias("o"), F.col("n").alias("v")) < F.col("x"), F.col("n")).otherwise(F.col("x.v")).alias("to")), "step")
        levels.append(step)
        left, right = step.select(F.col("n").alias("a"), F.col("to").alias("ta")), step.select(F.col("n").alias("b"), F.col("to").alias("tb"))
        edges = materialize(edges.join(left, "a").join(right, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b")).where("a <> b").distinct(), "links")
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = levels[0].select(F.col("n").alias("node"), F.col("to").alias("root"))
    for step in levels[1:]:
        out = out.join(step.withColumnRenamed("n", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out

"""A registry of metrics, compiled into one projection; failures are data.

A metric's entry is struct(value, error, errors, length). What fails fills the entry's error and leaves the other metrics alone:
a metric says by itself where it cannot be had (`problem`), Python scorers are guarded row by row, and a metric whose columns
the rows lack fails in each row. Outcomes are rows with a count of attempts, so that a later run takes up what is missing and
nothing else."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "value double, error string, errors double, length double"


@dataclass(frozen=True)
class Metric:
    """`score` makes the entry out of the row's columns, `problem` a message or null; `needs` names the columns both read. A
    metric that `follows` another is read from the same answer: it fails with it, and runs only where that one is asked for."""

    key: str
    score: Callable[[], Column]
    problem: Callable[[], Column] | None = None
    needs: tuple[str, ...] = field(default=())
    judged: bool = False
    follows: str | None = None


def entry(value: Column | None = None, errors: Column | None = None, length: Column | None = None, error: Column | None = None) -> Column:
    part = lambda c, t: (F.lit(None) if c is None else c).cast(t)
    return F.struct(part(value, "double").alias("value"), part(error, "string").alias("error"), part(errors, "double").alias("errors"), part(length, "double").alias("length"))


def guarded(score: Callable[..., tuple[float | None, float | None, float | None]], *columns: Column) -> Column:
    """The entry of a Python scorer of one row, (value, errors, length): an exception of a row is that row's error."""

    def one(*row) -> tuple:
        try:
            value, errors, length = score(*row)
        except Exception as e:  # any fault of a scorer belongs to its row
            return None, f"{type(e).__name__}: {e}", None, None
        return value, None, errors, length

    def run(*batch: pd.Series) -> pd.DataFrame:
        rows = zip(*(s.astype(object).where(s.notna(), None) for s in batch), strict=True)
        return pd.DataFrame([one(*r) for r in rows], columns=["value", "error", "errors", "length"]).astype({"value": float, "error": object, "errors": float, "length": float})

    # Without type hints the function would be taken for one over plain series.
    run.__annotations__ = {"batch": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, ENTRY)(*columns)


def chosen(asked: Sequence[str], registry: Sequence[Metric]) -> list[Metric]:
    """The metrics that need no judge, then those asked for, in the registry's order, without followers whose leader isn't asked
    for."""
    unknown = set(asked) - {m.key for m in registry}
    if unknown:
        raise ValueError(f"no such metrics: {sorted(unknown)}")
    return [m for m in registry if not m.judged or (m.key in asked and (m.follows is None or m.follows in asked))]


def evaluated(rows: DataFrame, asked: Sequence[str], registry: Sequence[Metric], judge: bool = True, only: str | None = None) -> DataFrame:
    """rows with `metrics`, a map from each chosen metric to its entry. Without a judge the judged ones hold an error. `only`
    names an array column with the metrics that a row wants; the others are left out of its map."""
    parts: dict[str, Column] = {}
    for m in chosen(asked, registry):
        missing = [c for c in m.needs if c not in rows.columns]
        if m.judged and not judge:
            made = entry(error=F.lit("No judge configured."))
        elif missing:
            made = entry(error=F.lit(f"columns are missing: {', '.join(missing)}"))
        else:
            problem = m.problem() if m.problem else F.lit(None).cast("string")
            made = F.when(problem.isNotNull(), entry(error=problem)).otherwise(m.score())
        if m.follows:
            led = parts[m.follows]["error"]
            made = F.when(led.isNotNull(), entry(error=led)).otherwise(made)
        parts[m.key] = made
    full = F.map_from_arrays(F.array(*map(F.lit, parts)), F.array(*parts.values()))
    wanted = full if only is None else F.map_filter(full, lambda k, _: F.array_contains(F.col(only), k))
    return rows.withColumn("metrics", wanted)


def outcomes(scored: DataFrame, keys: Sequence[str], attempts: Column | None = None) -> DataFrame:
    """keys, metric, value, error, errors, length, attempts: a row for each entry of evaluated rows. An inner explode would push a
    filter on the map's size down to the scan, for which all metrics would be computed once more."""
    made = (F.lit(1) if attempts is None else attempts).cast("long").alias("attempts")
    return scored.select(*keys, made, F.explode_outer("metrics").alias("metric", "m")).where("metric IS NOT NULL").select(*keys, "metric", "m.*", "attempts")


def due(rows: DataFrame, keys: Sequence[str], asked: Sequence[str], registry: Sequence[Metric], past: DataFrame, most: int) -> DataFrame:
    """rows that still owe a metric, with `due`, the metrics that they owe: those never tried, and those that failed in fewer than
    `most` attempts. Only keys and names are compared; `rows` meet what they owe by one join."""
    names = [m.key for m in chosen(asked, registry)]
    settled = past.where(F.col("error").isNull() | (F.col("attempts") >= most)).select(*keys, "metric")
    owed = rows.select(*keys, F.explode(F.array(*map(F.lit, names))).alias("metric")).join(settled, [*keys, "metric"], "left_anti")
    return rows.join(owed.groupBy(*keys).agg(F.sort_array(F.collect_set("metric")).alias("due")), list(keys))


def again(rows: DataFrame, keys: Sequence[str], asked: Sequence[str], registry: Sequence[Metric], past: DataFrame, most: int = 3, judge: bool = True) -> DataFrame:
    """The outcomes after one more run over what is due: settled ones stay, failed ones are replaced, attempts go up."""
    now = evaluated(due(rows, keys, asked, registry, past, most), asked, registry, judge, only="due")
    both = past.unionByName(outcomes(now, keys).withColumn("attempts", F.lit(None).cast("long")))
    # A key has one past outcome at most: the new one, whose attempts are open, wins and counts one more.
    rest = [c for c in past.columns if c not in (*keys, "metric", "attempts")]
    newest = F.max_by(F.struct(*rest), F.col("attempts").isNull())
    total = F.coalesce(F.max("attempts"), F.lit(0)) + F.count_if(F.col("attempts").isNull())
    return both.groupBy(*keys, "metric").agg(newest.alias("r"), total.alias("attempts")).select(*keys, "metric", "r.*", "attempts")


def failures(rows: DataFrame) -> DataFrame:
    """Of outcomes: failed rows of each metric and error, with the attempts made."""
    return rows.where("error IS NOT NULL").groupBy("metric", "error").agg(F.count("*").alias("rows"), F.sum("attempts").alias("attempts"))


def as_metrics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outcomes as one row for each key with the map `metrics`, as results hold it."""
    pair = F.struct("metric", F.struct("value", "error", "errors", "length"))
    return rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("metrics"))


"""Sums over a reader's tasks, and word operations joined to what the audio says."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(items: DataFrame, by: str) -> DataFrame:
    """items (by, mistakes, correct, ref_len, wpm, longest_pause) -> sums, the mean of the known paces and the longest pause."""
    sums = [F.sum(c).alias(c) for c in ("mistakes", "correct", "ref_len")]
    return items.groupBy(by).agg(*sums, F.avg("wpm").alias("wpm"), F.max("longest_pause").alias("longest_pause"))


def wrong_letters(events: DataFrame, by: str) -> DataFrame:
    """events (by, letter, sound, word) -> how often each letter was wrong, its distinct sounds and words, sorted and joined.
    Distinct values are found before they are gathered, so a group holds a letter's sounds and words, not its events."""
    counts = events.groupBy(by, "letter", "sound", "word").agg(F.count("*").alias("n"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return counts.groupBy(by, "letter").agg(F.sum("n").alias("times"), joined("sound").alias("sounds"), joined("word").alias("words"))


def sound_bars(profiles: DataFrame, by: str) -> DataFrame:
    """profiles (by, profile: a map of counts) -> the sum of each `sound:` entry."""
    entries = profiles.select(by, F.explode("profile").alias("k", "v")).where(F.startswith("k", F.lit("sound:")))
    return entries.groupBy(by, F.substring("k", 7, 1_000).alias("sound")).agg(F.sum("v").alias("times"))


def op_kinds(ops: DataFrame, by: str, kinds: Sequence[str]) -> DataFrame:
    """ops (by, kind) -> a column for each kind."""
    return ops.groupBy(by).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))


def audio_doubts(rows: DataFrame, threshold: float, count: bool = False) -> DataFrame:
    """rows (ops: array of ref_index, ref, mistake, heard; llr: array of evidence by ref_index) with `doubt` and `category` in
    each operation, and `doubts`, the words in doubt.

    In doubt is an operation on a word of the text that is no mistake, was not scored from the audio already (`heard`) and has
    evidence below the threshold. With `count` it becomes a mistake of the category `acoustic`."""
    evidence = lambda o: F.get("llr", o["ref_index"])
    doubt = lambda o: F.coalesce(~o["mistake"] & ~o["heard"] & (evidence(o) < threshold), F.lit(False))
    marked = F.transform("ops", lambda o: F.struct(
        o["ref_index"].alias("ref_index"), o["ref"].alias("ref"), (o["mistake"] | (F.lit(count) & doubt(o))).alias("mistake"), o["heard"].alias("heard"), doubt(o).alias("doubt"), F.when(F.lit(count) & doubt(o), "acoustic").alias("category"),
    ))
    return rows.withColumn("ops", marked).withColumn("doubts", F.transform(F.filter("ops", lambda o: o["doubt"]), lambda o: o["ref"]))

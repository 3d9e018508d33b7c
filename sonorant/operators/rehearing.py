"""Words heard again from the audio: units placed on a word's letters, doubtful words rebuilt, scored and merged back, and letters
of aligned words counted.

Readings have operations (ops: array of ref_index, ref, hyp, kind, mistake, category, note) and, by the word's place in the text,
the aligned units of its audio (units: array of arrays of unit, llr, heard)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonorant.functions.align import token_lists
from sonorant.operators import wordops

#: Words of the rows that are counted before a task puts their counts out.
COUNTED = 1_000_000
OP = "struct<ref_index:int,ref:string,hyp:string,kind:string,mistake:boolean,category:string,note:string>"


def unit_places(word: Column, units: Column) -> Column:
    """The place (from 0) in the word of each of its units, letters in the word's order of which some may be missing: a fold that
    takes the first such letter after the one before. Null where the units are no subsequence of the letters."""
    start = F.struct(F.lit(1).alias("after"), F.array().cast("array<int>").alias("places"))

    def step(s: Column, u: Column) -> Column:
        at = F.when(s["after"] > 0, F.coalesce(F.position(u, word, s["after"]), F.lit(0))).otherwise(0)
        return F.struct(F.when(at > 0, at + 1).otherwise(0).alias("after"), F.concat(s["places"], F.array(at - 1)).alias("places"))

    walked = F.aggregate(units, start, step)
    return F.when(walked["after"] > 0, walked["places"])


def heard_word(word: Column, units: Column, threshold: float) -> Column:
    """The word with what the audio holds in place of each unit below the threshold; null where none is, or where the units are no
    subsequence of the word's letters."""
    rejected = lambda u: F.coalesce(u["llr"] < threshold, F.lit(False))
    letters = F.filter(F.split(word, ""), lambda c: c != "")

    def rebuilt(places: Column) -> Column:
        def letter(c: Column, k: Column) -> Column:
            u = F.get(units, F.array_position(places, k).cast("int") - 1)
            return F.when(rejected(u), F.coalesce(u["heard"], F.lit(""))).otherwise(c)

        return F.when(places.isNotNull(), F.array_join(F.transform(letters, letter), ""))

    places = F.transform(F.array(unit_places(word, F.transform(units, lambda u: u["unit"]))), rebuilt)
    return F.when(F.exists(units, rejected), F.get(places, F.lit(0)))


def plain_score(folds: tuple[str, str] = ("", "")) -> Callable[[DataFrame], DataFrame]:
    """A scorer of distinct pairs (ref, heard): nothing heard is a word left out; words that are equal once letters of folds[0] are
    read as those of folds[1] are forgiven; other words are near, within half of the letters, or different."""
    fold = lambda c: F.translate(c, *folds)

    def score(pairs: DataFrame) -> DataFrame:
        silent, alike = F.col("heard") == "", fold(F.col("ref")) == fold(F.col("heard"))
        near = 2 * F.levenshtein("ref", "heard") <= F.length("ref")
        return pairs.select("ref", "heard", F.when(silent, "deletion").otherwise("substitution").alias("kind"), (silent | ~alike).alias("mistake"), F.when(~silent, F.when(alike, "forgiven").when(near, "near").otherwise("different")).alias("category"))

    return score


def reheard(readings: DataFrame, by: str, threshold: float, score: Callable[[DataFrame], DataFrame], normalize: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """readings (by, which names a reading, ops, units, any others) with `ops` as the audio has them, `ops_before`, and `rechecked`,
    the words scored again.

    Only words that the transcript has right and the audio rejects are rebuilt. What is heard goes through `normalize`, and each
    distinct pair of words through `score` once, however many readings have it; the new operations are merged into the nested
    arrays by their places. Null operations or units are left as they are."""
    word = lambda o: normalize(heard_word(o["ref"], F.get("units", o["ref_index"]), threshold))
    doubt = F.transform("ops", lambda o, k: F.when((o["kind"] == "match") & (o["ref_index"] >= 0), F.struct(k.alias("k"), o["ref"].alias("ref"), word(o).alias("heard"))))
    doubts = F.filter(doubt, lambda d: d["heard"].isNotNull() & (d["heard"] != d["ref"]))
    # An inner explode would push a filter on the doubts' number down, for which they would be found once more.
    rows = readings.select(by, F.explode_outer(doubts).alias("d")).where("d IS NOT NULL").select(by, "d.*")
    scored = score(rows.select("ref", "heard").distinct())
    # A reading's doubts are at most its words.
    new = rows.join(scored, ["ref", "heard"]).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("heard", "kind", "mistake", "category")))).alias("new"))

    def merged(o: Column, k: Column) -> Column:
        n = F.try_element_at("new", k)
        note = F.concat(F.lit("audio: "), F.when(n["heard"] == "", "-").otherwise(n["heard"]), F.lit("; transcript: "), F.coalesce(o["hyp"], F.lit("-")))
        redone = F.struct(o["ref_index"].alias("ref_index"), o["ref"].alias("ref"), F.when(n["heard"] != "", n["heard"]).alias("hyp"), n["kind"].alias("kind"), n["mistake"].alias("mistake"), n["category"].alias("category"), note.alias("note"))
        return F.when(n.isNotNull(), redone.cast(OP)).otherwise(o.cast(OP))

    both = readings.join(new, by, "left")
    return both.withColumn("ops_before", F.col("ops")).withColumn("ops", F.when(F.col("new").isNull(), F.transform("ops", lambda o: o.cast(OP))).otherwise(F.transform("ops", merged))).withColumn("rechecked", F.coalesce(F.size("new"), F.lit(0))).drop("new")


def task_counts(readings: DataFrame, by: str) -> DataFrame:
    """Of reheard readings: words, mistakes and words read right, before and after the audio was heard, and words rechecked."""
    wrong = lambda c: F.size(F.filter(c, lambda o: o["mistake"]))
    right = lambda c: F.size(F.filter(c, lambda o: o["ref"].isNotNull() & ~o["mistake"]))
    return readings.select(by, F.size(F.filter("ops", lambda o: o["ref"].isNotNull())).alias("words"), wrong("ops_before").alias("mistakes_before"), wrong("ops").alias("mistakes"), right("ops_before").alias("correct_before"), right("ops").alias("correct"), "rechecked")


def unrelated(ref: str, hyp: str) -> bool:
    """Whether two words differ too much to tell anything of letters."""
    return wordops.distance_ratio(ref, hyp) > 0.6


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of word arrays (r, h): each expected word and, with `hyp`, each pair of aligned words that differ, with how often
    they occur; of a few rows at a time, so the same ones may come again."""
    for batch in batches:
        seen, swapped, held = Counter(), Counter(), 0
        for k, (a, b) in enumerate(zip(token_lists(batch.column("r")), token_lists(batch.column("h")), strict=True), 1):
            seen.update(a)
            swapped.update([(a[i], b[j]) for i, j in wordops.path(a, b) if i is not None and j is not None and a[i] != b[j]])
            held += len(a) + len(b)
            if held >= COUNTED or k == batch.num_rows:
                refs, hyps = [*seen, *(x for x, _ in swapped)], [*[None] * len(seen), *(x for _, x in swapped)]
                yield pa.RecordBatch.from_arrays([pa.array(refs, pa.string()), pa.array(hyps, pa.string()), pa.array([*seen.values(), *swapped.values()], pa.int64())], ["ref", "hyp", "n"])
                seen, swapped, held = Counter(), Counter(), 0


def aligned_letters(pairs: DataFrame, r: str = "r", h: str = "h", apart: Callable[[str, str], bool] = unrelated) -> DataFrame:
    """pairs (arrays of words) -> expected, heard, count, seen, rate: letters of aligned words that differ, empty on one side where
    a letter is left out or put in; `seen` counts the letters of all expected words, those left out too.

    Words are aligned row by row and counted where they are; the words and pairs of words that this gives become a dictionary with
    counts, and letters are aligned once for each distinct pair, whose count multiplies what it gives. Words that are `apart` count
    as seen only."""

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter()
            for ref, hyp, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for pair in ((c, None) for c in ref or "") if hyp is None else () if apart(ref, hyp) else wordops.classify(ref, hyp)[2]:
                    counts[pair] += n
            yield pa.RecordBatch.from_arrays([*(pa.array([p[k] for p in counts], pa.string()) for k in (0, 1)), pa.array([*counts.values()], pa.int64())], ["expected", "heard", "n"])

    none = F.array().cast("array<string>")
    words = pairs.select(F.coalesce(F.col(r), none).alias("r"), F.coalesce(F.col(h), none).alias("h")).mapInArrow(_word_counts, "ref string, hyp string, n long")
    known = words.groupBy("ref", "hyp").agg(F.sum("n").alias("n")).select("ref", "hyp", "n")
    # What is seen and what differs come from one table, for which the words would else be aligned twice.
    counts = known.mapInArrow(letters, "expected string, heard string, n long").groupBy("expected", "heard").agg(F.sum("n").alias("count"))
    seen = F.sum(F.when(F.col("heard").isNull(), F.col("count"))).over(Window.partitionBy("expected"))
    both = counts.select("expected", "heard", "count", seen.alias("seen")).where("heard IS NOT NULL")
    return both.withColumn("rate", F.when(F.col("seen") > 0, F.col("count") / F.col("seen")))

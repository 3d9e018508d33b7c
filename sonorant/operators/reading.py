"""Reading assessment: agreement of levels and mistakes, placement, letter confusions, level benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonorant.dims import LEVELS

#: Items that a letter or word task requires, mistakes that a paragraph or story task allows.
ITEMS_REQUIRED, MAX_MISTAKES = {1: 4, 2: 4}, {3: 3, 4: 3}


def level_agreement(pairs: DataFrame, by: str) -> DataFrame:
    """pairs (by, human, system) -> n, accuracy, weighted_kappa, false_fail_rate, false_pass_rate of each group.

    Quadratic weights need no 5 x 5 table: the expected disagreement of independent raters is
    E[h^2] + E[s^2] - 2 E[h] E[s], so one pass of integer sums gives kappa; no spread at all gives 1."""
    h, s = F.col("human").cast("long"), F.col("system").cast("long")
    t = pairs.groupBy(by).agg(
        F.count("*").alias("n"), F.sum(h).alias("sh"), F.sum(s).alias("ss"), F.sum(h * h).alias("hh"), F.sum(s * s).alias("qq"), F.sum((h - s) * (h - s)).alias("o"),
        F.count_if(h == s).alias("same"), F.count_if(s < h).alias("low"), F.count_if(s > h).alias("high"),
    )
    expected = F.col("n") * (F.col("hh") + F.col("qq")) - 2 * F.col("sh") * F.col("ss")
    kappa = F.when(expected == 0, 1.0).otherwise(1 - (F.col("n") * F.col("o")) / expected)
    return t.select(by, F.col("n").cast("long").alias("n"), (F.col("same") / F.col("n")).alias("accuracy"), kappa.alias("weighted_kappa"), (F.col("low") / F.col("n")).alias("false_fail_rate"), (F.col("high") / F.col("n")).alias("false_pass_rate"))


def confusion(pairs: DataFrame) -> DataFrame:
    """A row for each human level, a column for each system level; levels never seen are rows of 0."""
    spark = pairs.sparkSession
    grid = F.broadcast(spark.range(len(LEVELS)).select(F.col("id").alias("human")))
    cells = [F.count_if(F.col("system") == k).cast("long").alias(f"system_{k}") for k in range(len(LEVELS))]
    seen = pairs.groupBy(F.col("human").cast("long").alias("human")).agg(*cells)
    return grid.join(seen, "human", "left").na.fill(0)


def mistake_scores(sets: DataFrame) -> DataFrame:
    """sets (human, system: arrays of word places) -> tp, fp, fn, precision, recall, f1 over all rows; 1 over nothing."""
    t = sets.agg(
        F.coalesce(F.sum(F.size(F.array_intersect("human", "system"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.size(F.array_except("system", "human"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.size(F.array_except("human", "system"))), F.lit(0)).alias("fn"),
    )
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0)
    t = t.withColumns({"precision": p, "recall": r})
    return t.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def passed(level: Column, mistakes: Column, correct: Column, wpm: Column | None = None, pause: Column | None = None, min_wpm: dict[int, float] | None = None, max_pause: float | None = None) -> Column:
    """Whether a task is passed: enough items right for letters and words, few enough mistakes for texts, and the optional
    limits of pace and pause, which a missing measure meets."""
    out = F.when(level.isin(*ITEMS_REQUIRED), correct >= F.when(level == 1, ITEMS_REQUIRED[1]).otherwise(ITEMS_REQUIRED[2])).otherwise(mistakes <= F.when(level == 3, MAX_MISTAKES[3]).otherwise(MAX_MISTAKES[4]))
    for k, least in (min_wpm or {}).items():
        out = out & F.coalesce(~((level == k) & (wpm < least)), F.lit(True))
    return out & F.coalesce(pause <= max_pause, F.lit(True)) if max_pause is not None else out


def placement(paragraph: Column, story: Column, word: Column, letter: Column) -> Column:
    """The level number by the decision tree; null where a task that the tree needs is missing (null)."""
    return F.when(paragraph, F.when(story, 4).when(~story, 3)).when(~paragraph, F.when(word, 2).when(~word, F.when(letter, 1).when(~letter, 0))).cast("long")


def next_task(paragraph: Column, story: Column, word: Column, letter: Column) -> Column:
    """The level of the task to give next; null when the reader can be placed."""
    after = F.when(paragraph, F.when(story.isNull(), 4)).when(word.isNull(), 2).when(~word & letter.isNull(), 1)
    return F.when(paragraph.isNull(), 3).otherwise(after).cast("long")


def letter_confusions(letters: DataFrame) -> DataFrame:
    """letters (expected, heard), a row for each aligned letter -> expected, heard, count, seen, rate of each wrong pair."""
    all_ = letters.groupBy("expected", "heard").agg(F.count("*").alias("count"))
    seen = all_.groupBy("expected").agg(F.sum("count").alias("seen"))
    return all_.where("expected <> heard").join(seen, "expected").select("expected", "heard", F.col("count").cast("long").alias("count"), F.col("seen").cast("long").alias("seen"), (F.col("count") / F.col("seen")).alias("rate"))


def top_confusions(confusions: DataFrame, k: int = 4, least: int = 2) -> DataFrame:
    """Each letter's k most frequent confusions of at least `least`, ties by what was heard; nothing heard is left out."""
    by = Window.partitionBy("expected").orderBy(F.desc("count"), "heard")
    rows = confusions.where(f"count >= {least} AND heard <> ''")
    return rows.withColumn("place", F.row_number().over(by).cast("long")).where(f"place <= {k}").select("expected", "heard", "count", "place")


def confusion_audit(confusions: DataFrame, listed: DataFrame, least: int = 2) -> DataFrame:
    """Unordered pairs that are frequent and not listed (`unlisted`), or listed and never seen (`unseen`)."""
    pair = lambda a, b: F.array_sort(F.array(a, b))
    seen = confusions.groupBy(pair(F.col("expected"), F.col("heard")).alias("p")).agg(F.sum("count").alias("count"))
    known = listed.select(pair(F.col("a"), F.col("b")).alias("p")).distinct()
    a = seen.where(f"count >= {least}").join(known, "p", "left_anti").select("p", F.lit("unlisted").alias("finding"))
    b = known.join(seen, "p", "left_anti").select("p", F.lit("unseen").alias("finding"))
    return a.unionByName(b).select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), "finding")


def level_benchmark(pairs: DataFrame, by: str) -> DataFrame:
    """pairs (by, word_errors, word_length, char_errors, char_length, exact) -> pooled rates and the share that is exact."""
    ratio = lambda e, n: (F.sum(e) / F.greatest(F.sum(n), F.lit(1)))
    return pairs.groupBy(by).agg(F.count("*").alias("samples"), ratio("word_errors", "word_length").alias("wer"), ratio("char_errors", "char_length").alias("cer"), F.avg(F.col("exact").cast("double")).alias("exact"))


def level_report(pairs: DataFrame, by: str, expected: DataFrame) -> DataFrame:
    """level_benchmark's pairs with mistakes (those that no rule forgives) and neutral (words that were read) -> for each of the
    expected groups (by) its pooled rates, the share of exact samples and mistakes per word, or `missing`, without samples."""
    more = pairs.groupBy(by).agg((F.sum("mistakes") / F.greatest(F.sum("neutral"), F.lit(1))).alias("forgiving"))
    found = level_benchmark(pairs, by).join(more, by)
    return expected.join(found, by, "left").withColumn("missing", F.col("samples").isNull()).na.fill({"samples": 0})


def letter_partners(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, ordinal) of letters that are taken for one another -> letter, partners: those of both places in the order in
    which they first appear, each once. A group is a letter's partners, after each pair has been reduced to one row."""
    both = pairs.select(F.col("a").alias("letter"), F.col("b").alias("partner"), "ordinal").unionByName(pairs.select(F.col("b").alias("letter"), F.col("a").alias("partner"), "ordinal"))
    first = both.where("letter <> partner").groupBy("letter", "partner").agg(F.min("ordinal").alias("ordinal"))
    return first.groupBy("letter").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "partner"))), lambda x: x["partner"]).alias("partners"))


def letter_events(readings: DataFrame, by: str, threshold: float, silent: list[str]) -> DataFrame:
    """readings (by, checks: array of letter, heard, margin; ops: array of ref, kind, units: array of letter, gop, heard; wrong:
    letters) -> by, word, letter, score, ok, source: a row for each letter that a reader tried.

    A reading with checks of letters counts by these alone. Else each word counts by the scores of its units, or, without units,
    by its letters, of which the `wrong` ones are not ok. Words that were left out and silent letters say nothing."""
    event = lambda word, letter, score, ok, source: F.struct(word.alias("word"), letter.alias("letter"), score.cast("double").alias("score"), ok.alias("ok"), F.lit(source).alias("source"))
    checks = F.transform("checks", lambda c: event(c["letter"], c["letter"], c["margin"], c["heard"] == c["letter"], "letter_check"))
    sounding = lambda c: ~c.isin(*silent)
    units = lambda o: F.transform(F.filter(o["units"], lambda u: sounding(u["letter"])), lambda u: event(o["ref"], u["letter"], u["gop"], u["gop"] >= threshold, "gop"))
    letters = lambda o: F.filter(F.split(o["ref"], ""), lambda c: (c != "") & sounding(c))
    spelled = lambda o: F.transform(letters(o), lambda c: event(o["ref"], c, F.lit(None), ~F.array_contains(F.coalesce(o["wrong"], F.array().cast("array<string>")), c), "text"))
    tried = F.filter("ops", lambda o: (F.coalesce(o["ref"], F.lit("")) != "") & (o["kind"] != "deletion"))
    of_ops = F.flatten(F.transform(tried, lambda o: F.when(F.coalesce(F.size(o["units"]), F.lit(0)) > 0, units(o)).otherwise(spelled(o))))
    return readings.select(by, F.explode(F.when(F.coalesce(F.size("checks"), F.lit(0)) > 0, checks).otherwise(of_ops)).alias("e")).select(by, "e.*")

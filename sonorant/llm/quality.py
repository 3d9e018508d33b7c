"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.llm.common import SPACE_CHARS, read_table, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from in is it of on or that the this to was with "
    "auf das dem den der des die ein eine im ist mit nicht sich und von zu "
    "au aux ce dans de des du en est et la le les ou par pas pour que qui un une "
    "al como con del el en es la las lo los no para por que se su una y"
).split()

SYMBOLS = r"[#*$%&|<>]"


class Rule(NamedTuple):
    """A document passes while low <= share / base <= high, both of them measures (see `verdict`)."""

    name: str
    share: str
    base: str
    low: float
    high: float


#: The production table. Bounds lie outside what clean prose of the four languages shows.
RULES = (
    Rule("mean_word_chars", "word_chars", "n_words", 1.5, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.2),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.01, 1.0),
    Rule("repeated_line_share", "n_dup_lines", "n_lines", 0.0, 0.5),
)


def let(x: Column, body) -> Column:
    """body of x, with x evaluated once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def repeated_words(w: Column) -> Column:
    """Words covered by 3-word windows whose words stand in the text twice or more. Windows are compared by a 64-bit hash,
    sorted within the row: O(n log n) for a text of n words, and no shuffle."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def by_sort(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])), lambda e: e["i"])))

    def by_lookup(h: Column, twice: Column) -> Column:
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())

    def covered(h: Column) -> Column:
        # Few repeated windows: look each one up. Many: sort windows with their places. Both give all places, ascending.
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k + 1))))
        starts = let(twice, lambda t: F.when(F.size(t) <= 16, by_lookup(h, t)).otherwise(by_sort(h)))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    covering = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(w) >= 4, covering).otherwise(F.lit(0)).cast("long")


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One struct for a text: n_words, word_chars, n_symbols, n_stop_words, n_lines, n_dup_lines, n_repeat_words (long),
    base_failed, failed_rules (names, in table order), kept. Words, lines and measures are bound once each, so the struct
    can stand in a filter, which the optimizer may copy, as well as in a projection."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    stop = sorted(set(STOP_WORDS))

    def measured(w: Column, lines: Column) -> Column:
        return F.struct(*(x.cast("long").alias(n) for n, x in {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
            "n_stop_words": F.size(F.filter(w, lambda x: x.isin(stop))),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(w),
        }.items()))

    def judged(m: Column) -> Column:
        shares = [m[r.share] / F.greatest(m[r.base], F.lit(1)) for r in rules]
        failed = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(~x.between(r.low, r.high), F.lit(r.name)) for r, x in zip(rules, shares, strict=True))))
        base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        return let(F.when(m["n_words"] == 0, F.array().cast("array<string>")).otherwise(failed), lambda f: F.struct(m.alias("m"), base.alias("base_failed"), f.alias("failed_rules"), (~base & (F.size(f) == 0)).alias("kept")))

    return let(words(text), lambda w: let(lines, lambda x: let(measured(w, x), judged)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (any columns, `text` among them) with the fields of `verdict` as columns.

    Null, empty and blank texts: no words, all measures 0, base_failed, no failed rules. Repeated rows are judged alike, each
    on its own; an empty table gives an empty table. Columns of the input with the names of added ones are replaced."""
    names = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")
    out = docs.drop(*names, "base_failed", "failed_rules", "kept").withColumn("__q", verdict(F.col("text"), rules))
    return out.select("*", *(F.col(f"__q.m.{n}").alias(n) for n in names), "__q.base_failed", "__q.failed_rules", "__q.kept").drop("__q")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return docs.where(verdict(F.col("text"), rules)["kept"])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", F.concat_ws(",", "failed_rules").alias("failed_rules"))

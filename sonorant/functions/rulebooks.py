"""Rulebooks: per language the rules of normalisation in order, as a table that compiles to one pass with a trace.

A rule is neutral where it removes what was never in the speech (encodings, scripts, spellings); the others also forgive what an
assessment does not count. A new language is one entry of `BOOKS`."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonorant.functions import devanagari as dv


@dataclass(frozen=True)
class Rule:
    number: int
    apply: Callable[[Column], Column]
    neutral: bool = True


@dataclass(frozen=True)
class Rulebook:
    code: str
    name: str
    rules: tuple[Rule, ...]
    aliases: tuple[str, ...] = ()
    fillers: tuple[str, ...] = ()

    def id(self, number: int) -> str:
        return f"{self.code.upper()}-{number:02d}"

    def ids(self, neutral: bool = False) -> list[str]:
        return [self.id(r.number) for r in self.rules if r.neutral or not neutral]


def composed(text: Column) -> Column:
    """Unicode's canonical composition; letters with a dot come apart, so that one rule sees every dot alike."""

    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    return F.pandas_udf(run, "string")(text)


def in_devanagari(text: Column) -> Column:
    """Each run of Latin letters as it is spelt in Devanagari."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: dv.LATIN.sub(lambda m: dv.from_latin(m[0]), t), na_action="ignore")

    return F.pandas_udf(run, "string")(text)


#: Texts that are held as Python's strings at a time.
TEXTS = 200


def _composed_and_spelt(texts: pa.Array) -> pa.Array:
    spelt = lru_cache(65_536)(dv.from_latin)
    parts = [[], []]
    for k in range(0, max(len(texts), 1), TEXTS):
        first = [t if t is None else unicodedata.normalize("NFC", t) for t in texts[k : k + TEXTS].to_pylist()]
        parts[0].append(pa.array(first, pa.string()))
        parts[1].append(pa.array([t if t is None else dv.LATIN.sub(lambda m: spelt(m[0]), t) for t in first], pa.string()))
    return pa.StructArray.from_arrays(list(map(pa.concat_arrays, parts)), ["composed", "spelt"])


def composed_and_spelt(text: Column) -> Column:
    """struct(composed, spelt): what `composed` makes of a text and `in_devanagari` of that, by one call of Python."""
    return F.arrow_udf(_composed_and_spelt, "composed string, spelt string")(text)


#: The characters without a sound that the plain rulebook drops.
PLAIN_INVISIBLE = "\u200c\u200d\u200b\ufeff"


def letters_and_marks(text: Column) -> Column:
    """Letters, numbers and marks of any script; everything else parts words."""
    return F.trim(F.regexp_replace(F.translate(text, PLAIN_INVISIBLE, ""), r"[^\p{L}\p{N}\p{M}]+", " "))


def _devanagari_rules(code: str) -> tuple[Rule, ...]:
    rules = (
        Rule(1, composed), Rule(2, in_devanagari), Rule(3, dv.digits), Rule(4, dv.stripped), Rule(5, lambda c: dv.nukta(c, code)),
        Rule(6, lambda c: dv.nasal_mark(c, code)), Rule(8, dv.class_nasal), Rule(9, dv.one_code),
    )
    return (*rules, Rule(10, dv.spelling)) if code == "hi" else rules


BOOKS: dict[str, Rulebook] = {
    b.code: b
    for b in (
        Rulebook("hi", "Hindi", _devanagari_rules("hi"), ("hi-in", "hindi"), dv.FILLERS["hi"]),
        Rulebook("mr", "Marathi", _devanagari_rules("mr"), ("mr-in", "marathi"), dv.FILLERS["mr"]),
        Rulebook("xx", "Any script", (Rule(1, composed), Rule(4, letters_and_marks))),
    )
}


def book(name: str, books: Mapping[str, Rulebook] = BOOKS) -> Rulebook:
    """The rulebook of a code, locale or name, in any case."""
    known = {a: b for b in books.values() for a in (b.code, *b.aliases)}
    if name.lower() not in known:
        raise ValueError(f"no rulebook for {name!r}; there are {sorted(books)}")
    return known[name.lower()]


def traced(rows: DataFrame, text: str, language: str, codes: Sequence[str] | None = None, neutral: bool = False, books: Mapping[str, Rulebook] = BOOKS) -> DataFrame:
    """rows with `normalized` and `trace`, an array of struct(rule, before, after) with an entry for each rule that changed the
    text, in order. `language` is a column of codes; a code outside `codes` (all by default) leaves the text as it is, with no
    entry; a null text is empty. With `neutral` only the neutral rules run.

    One pass over the rows whatever the number of languages: rules that share a number stand in one stage, which picks by the
    row's code; a rule that several books share runs once. A stage is a projection of its own, so no rule is computed twice."""
    used = [books[c] for c in (codes or books)]
    numbers = sorted({r.number for b in used for r in b.rules if r.neutral or not neutral})
    state = [f"__stage{k}" for k in range(len(numbers) + 1)]
    out = rows.withColumn(state[0], F.coalesce(F.col(text), F.lit("")))
    code, steps = F.coalesce(F.col(language), F.lit("")), []
    # The rules that need Python come first where a book has them both, so one call serves both stages.
    leads = lambda b: [r.apply for r in b.rules[:2]] == [composed, in_devanagari] and (not neutral or all(r.neutral for r in b.rules[:2]))
    joint: dict[Callable, Column] = {}
    if any(map(leads, used)):
        out = out.withColumn("__lead", composed_and_spelt(F.col(state[0])))
        joint = {composed: F.col("__lead.composed"), in_devanagari: F.col("__lead.spelt")}
    for before, after, number in zip(state, state[1:], numbers, strict=False):
        shared: dict[Callable, list[Rulebook]] = {}
        for b in used:
            for r in b.rules:
                if r.number == number and (r.neutral or not neutral):
                    shared.setdefault(r.apply, []).append(b)
        pick = lambda bs: code.isin([b.code for b in bs])
        made = lambda f, bs: joint[f] if f in joint and all(leads(b) or (f is composed and b.rules[0].apply is f) for b in bs) else f(F.col(before))
        result = reduce(lambda c, kv: c.when(pick(kv[1]), made(*kv)), shared.items(), F.when(F.lit(False), F.col(before)))
        rule = F.concat(F.upper(code), F.lit(f"-{number:02d}"))
        out = out.withColumn(after, result.otherwise(F.col(before)))
        steps.append(F.struct(rule.alias("rule"), F.col(before).alias("before"), F.col(after).alias("after")))
    changed = F.filter(F.array(*steps), lambda s: s["before"] != s["after"])
    return out.withColumns({"normalized": F.col(state[-1]), "trace": changed}).drop(*state, "__lead")


def entries(traces: DataFrame, *keys: str) -> DataFrame:
    """keys, rule, before, after: a row for each entry of traced rows. An inner explode would push a filter on the trace's size
    down through the stages, each of which it would then compute many times over; an outer one has nothing to push."""
    steps = traces.select(*keys, F.explode_outer("trace").alias("__step"))
    return steps.where("__step IS NOT NULL").select(*keys, "__step.*")


def firings(traces: DataFrame, *by: str) -> DataFrame:
    """Of traced rows: how many rows each rule changed."""
    return entries(traces, *by).groupBy(*by, "rule").agg(F.count("*").alias("rows"))

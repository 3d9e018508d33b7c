import pytest
from pyspark.sql import functions as F

from sonorant.functions import devanagari, rulebooks
from sonorant.queries import QUERIES

SF = "/root/testdata/sf0.001"

#: A text for each rule that it, and no other rule, changes: (code, rule, before, after).
CASES = [
    ("hi", "HI-01", "क़लम", "क़लम"), ("hi", "HI-02", "pakka", "पक्का"), ("mr", "MR-03", "१२", "12"), ("hi", "HI-04", "घर, नल।", "घर नल"),
    ("hi", "HI-05", "क\u093cलम", "कलम"), ("hi", "HI-06", "माँ", "मां"), ("mr", "MR-08", "सन्त", "संत"), ("mr", "MR-09", "\u0972", "\u090d"), ("hi", "HI-10", "गयी", "गई"),
]


def run(spark, rows, **k):
    df = spark.createDataFrame(rows, "id long, code string, text string")
    return {r.id: r for r in rulebooks.traced(df, "text", "code", **k).collect()}


def test_each_rule_leaves_its_entry(spark):
    got = run(spark, [(k, c[0], c[2]) for k, c in enumerate(CASES)])
    for k, (_, rule, before, after) in enumerate(CASES):
        entries = {s.rule: (s.before, s.after) for s in got[k].trace}
        assert entries[rule] == (before, after)
        assert set(entries) <= {rule, "HI-05"}, "a dot that comes apart is silent afterwards"


def test_entries_are_chained_and_in_order(spark):
    got = run(spark, [(1, "hi", "Sita ने गयी, सन्त \u0958लम १२ माँ \u0972"), (2, "mr", "हँसी पढ\u093cना")])
    for r in got.values():
        assert [s.rule for s in r.trace] == sorted({s.rule for s in r.trace})
        assert r.trace[0].before == r.text and r.trace[-1].after == r.normalized
        assert all(a.after == b.before for a, b in zip(r.trace, r.trace[1:]))
    assert [s.rule for s in got[1].trace] == ["HI-01", "HI-02", "HI-03", "HI-04", "HI-05", "HI-06", "HI-08", "HI-09", "HI-10"]
    assert got[2].normalized == "हंसी पढना", "only the Hindi book protects words and dots"


def test_plain_book_nulls_and_unknown_codes(spark):
    got = run(spark, [(1, "xx", "  Ab-c\u200dd é² नि।"), (2, "hi", None), (3, "zz", "a, b"), (4, None, "a, b"), (5, "hi", "")])
    assert got[1].normalized == "Ab cd é² नि" and [s.rule for s in got[1].trace] == ["XX-04"]
    assert got[2].normalized == got[5].normalized == "" and got[2].trace == got[5].trace == []
    assert got[3].normalized == got[4].normalized == "a, b" and got[3].trace == got[4].trace == []


def test_trace_agrees_with_the_plain_normaliser(spark):
    df = spark.createDataFrame([("सन्त ghar १२, माँ",), ("नयी\u200c \u0958लम",)], "text string").withColumn("code", F.lit("hi"))
    both = rulebooks.traced(df, "text", "code").withColumn("plain", devanagari.normalize(F.col("text"), "hi")).collect()
    assert all(r.normalized == r.plain for r in both)


def test_books_and_their_neutral_rules(spark):
    assert rulebooks.book("Hindi").code == rulebooks.book("hi-IN").code == "hi"
    with pytest.raises(ValueError):
        rulebooks.book("Klingon")
    lenient = rulebooks.Rulebook("yy", "Test", (rulebooks.Rule(1, F.upper), rulebooks.Rule(2, lambda c: F.translate(c, "X", ""), neutral=False)))
    assert lenient.ids() == ["YY-01", "YY-02"] and lenient.ids(neutral=True) == ["YY-01"]
    rows = [(1, "yy", "axb")]
    assert run(spark, rows, books={"yy": lenient})[1].normalized == "AB"
    assert run(spark, rows, books={"yy": lenient}, neutral=True)[1].normalized == "AXB"


def test_every_rule_fires_over_the_tables(spark):
    fired = {r.rule: r.rows for r in QUERIES["rule_firings"](spark, SF).collect()}
    assert set(fired) == {i for b in rulebooks.BOOKS.values() for i in b.ids()} and min(fired.values()) > 0


def test_stages_stay_apart_in_the_plan(spark):
    plan = QUERIES["rule_trace"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


def test_texts_in_parts_are_all_texts(monkeypatch):
    import pyarrow as pa

    from sonorant.functions import rulebooks

    texts = pa.array(["é ka", None, "", "sita"] * 3)
    whole = rulebooks._composed_and_spelt(texts)
    monkeypatch.setattr(rulebooks, "TEXTS", 5)
    assert rulebooks._composed_and_spelt(texts).equals(whole) and rulebooks._composed_and_spelt(texts[:0]).type == whole.type

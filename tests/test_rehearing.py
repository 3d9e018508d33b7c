"""Units on letters, words heard again, letters of aligned words."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from sonorant.operators import rehearing, wordops

UNIT = "struct<unit:string,llr:double,heard:string>"


def test_units_walk_the_word(spark):
    rows = [("banana", list("bnn")), ("banana", list("aaa")), ("banana", list("aaaa")), ("banana", list("nb")), ("banana", []), ("", ["a"]), (None, ["a"]), ("banana", [None]), ("चाँद", list("चद"))]
    got = [r.p for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, word string, units array<string>").select("k", rehearing.unit_places(F.col("word"), F.col("units")).alias("p")).orderBy("k").collect()]
    assert got == [[0, 2, 4], [1, 3, 5], None, None, [], None, None, None, [0, 3]]


def test_words_are_rebuilt_from_rejected_units(spark):
    rows = [("gate", [("g", 1.0, "k"), ("a", -5.0, "e"), ("e", -5.0, "")]), ("gate", [("g", 1.0, "k")]), ("gate", [("x", -5.0, "k")]), ("gg", [("g", 1.0, "a"), ("g", -9.0, None)]), ("gate", None), ("gate", [("g", None, "k")])]
    got = [r.h for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, word string, units array<{UNIT}>").select("k", rehearing.heard_word(F.col("word"), F.col("units"), -2.0).alias("h")).orderBy("k").collect()]
    assert got == ["get", None, None, "g", None, None]


def test_only_doubtful_words_are_scored_again(spark):
    op = lambda i, ref, kind="match", hyp=None: (i, ref, hyp or ref, kind, kind != "match", None, None)
    bad = lambda c, x: [(c, -9.0, x)]
    rows = [
        (1, [op(0, "cat"), op(None, None, "insertion", "x"), op(1, "dog", "substitution", "fog"), op(2, "sun")], [bad("c", "k"), bad("d", "f"), [("s", 5.0, "z")]]),
        (2, [op(0, "cat"), op(1, "sun"), op(2, "a")], [bad("c", "k"), bad("s", "s"), bad("a", "")]),
        (3, None, None),
        (4, [op(0, "cat")], []),
    ]
    df = spark.createDataFrame(rows, f"id int, ops array<{rehearing.OP}>, units array<array<{UNIT}>>")
    asked = []

    def score(pairs):
        asked.extend(sorted(map(tuple, pairs.collect())))
        return rehearing.plain_score(("k", "c"))(pairs)

    out = rehearing.reheard(df, "id", -2.0, score, F.lower)
    assert asked == [("a", ""), ("cat", "kat")]
    got = {r.id: r for r in out.collect()}
    assert [(o.ref, o.hyp, o.kind, o.mistake, o.category) for o in got[1].ops] == [("cat", "kat", "substitution", False, "forgiven"), (None, "x", "insertion", True, None), ("dog", "fog", "substitution", True, None), ("sun", "sun", "match", False, None)]
    assert got[1].ops[0].note == "audio: kat; transcript: cat" and got[1].rechecked == 1
    assert [(o.kind, o.mistake, o.hyp) for o in got[2].ops] == [("substitution", False, "kat"), ("match", False, "sun"), ("deletion", True, None)]
    assert got[3].ops is None and got[4].rechecked == 0 and got[4].ops[0].kind == "match"
    totals = {r.id: (r.words, r.mistakes_before, r.mistakes, r.correct_before, r.correct) for r in rehearing.task_counts(out, "id").collect()}
    assert totals[1] == (3, 2, 2, 2, 2) and totals[2] == (3, 0, 1, 3, 2)


def test_letters_of_aligned_words(spark):
    rows = [("the cat sat down", "the cut sat"), ("the cat sat", "the cut zat on"), ("cat", "elephant"), ("", "x"), (None, None), ("aab", "ab")] * 3
    df = spark.createDataFrame([(k, None if a is None else a.split(), None if b is None else b.split()) for k, (a, b) in enumerate(rows)], "k int, r array<string>, h array<string>").repartition(4)
    seen, counts = Counter(), Counter()
    for a, b in rows:
        a, b = (a or "").split(), (b or "").split()
        for i, j in wordops.path(a, b):
            if i is not None:
                seen.update(a[i])
                if j is not None and a[i] != b[j] and not rehearing.unrelated(a[i], b[j]):
                    counts.update(wordops.classify(a[i], b[j])[2])
    got = {(r.expected, r["heard"]): (r["count"], r.seen) for r in rehearing.aligned_letters(df).collect()}
    assert got == {k: (n, seen[k[0]]) for k, n in counts.items()}
    assert got[("a", "u")][0] == 6 and ("s", "z") in got


def test_words_are_aligned_once_and_counted_where_they_are(spark):
    df = spark.createDataFrame([(k, ["cat", "sat"] * 50, ["cut", "sat"] * 50) for k in range(40)], "k int, r array<string>, h array<string>")
    out = rehearing.aligned_letters(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    assert [(r.expected, r["heard"], r["count"], r.seen) for r in out.collect()] == [("a", "u", 2000, 4000)]
    batch = pa.RecordBatch.from_arrays([pa.array([["cat", "sat"] * 50] * 40), pa.array([["cut", "sat"] * 50] * 40)], ["r", "h"])
    rows = [r for b in rehearing._word_counts(iter([batch])) for r in b.to_pylist()]
    assert sorted(rows, key=str) == sorted([{"ref": "cat", "hyp": None, "n": 2000}, {"ref": "sat", "hyp": None, "n": 2000}, {"ref": "cat", "hyp": "cut", "n": 2000}], key=str)

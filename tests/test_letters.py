"""Closed choices among letters, letter windows, events of letters, reports of levels and explanations on small fixtures."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from sonorant.functions import acoustic
from sonorant.operators import plans, reading


def best_of_all(x, form, blank=0):
    """The best score over all frame sequences that collapse to `form`."""
    best = -math.inf
    for ids in itertools.product(range(x.shape[1]), repeat=len(x)):
        kept = [v for k, v in enumerate(ids) if k == 0 or ids[k - 1] != v]
        if [v for v in kept if v != blank] == form:
            best = max(best, sum(x[k, v] for k, v in enumerate(ids)))
    return best


def test_path_scores_equal_those_of_all_paths(spark):
    rng = np.random.default_rng(3)
    forms = [[1], [2, 1], [1, 1], None, [], [1, 2, 1, 2, 1, 2], [2, 2, 2]]
    rows = [(k, rng.normal(size=(n, 3)).tolist(), forms) for k, n in enumerate((4, 4, 5, 2))]
    df = spark.createDataFrame(rows, "k long, x array<array<double>>, forms array<array<int>>")
    for r in df.select("x", acoustic.path_scores(F.col("x"), F.col("forms")).alias("s")).collect():
        for form, got in zip(forms, r.s, strict=True):
            fits = form and len(form) + sum(a == b for a, b in itertools.pairwise(form)) <= len(r.x)
            assert (got is None) if not fits else abs(got - best_of_all(np.array(r.x), form)) < 1e-9


def test_a_closed_choice_takes_the_best_form_and_tells_what_is_missing(spark):
    x = [[-9.0, -1.0, -4.0, -3.0]] * 2
    asked = "utt_id long, log_probs array<array<double>>, expected string, candidates array<struct<name string, form array<int>>>"
    rows = [(0, x, "a", [("a", [2]), ("a", [3]), ("b", [1])]), (1, x, "a", [("a", [1])]), (2, x, "a", [("a", None), ("b", [1])]), (3, x, "a", [("a", [1]), ("b", [1])]), (4, x, "a", [("a", None)])]
    got = {r.utt_id: (r.best, r.margin) for r in acoustic.closed_set(spark.createDataFrame(rows, asked)).collect()}
    assert got == {0: ("b", -4.0), 1: ("a", math.inf), 2: (None, None), 3: ("a", 0.0), 4: (None, None)}
    assert acoustic.closed_set(spark.createDataFrame([], asked)).count() == 0


def test_letters_decide_within_their_windows(spark):
    # Tokens: blank, a, b, c. Two letters at frames 1 and 4; the second sounds like c, by its form of two tokens too.
    frame = lambda best: [-0.1 if k == best else -5.0 for k in range(4)]
    x = [frame(k) for k in (0, 1, 0, 0, 3, 0)]
    letters = [("a", [("a", [1]), ("b", [2])]), ("b", [("b", [2]), ("b", [2, 1]), ("c", [3])])]
    schema = "utt_id long, log_probs array<array<double>>, letters array<struct<expected string, candidates array<struct<name string, form array<int>>>>>"
    rows = [(1, x, letters), (2, x[:1], letters), (3, x, [("z", [("z", None), ("a", [1])])]), (4, x, [])]
    got = {(r.utt_id, r.place): (r.expected, r.best, round(r.margin, 6)) for r in acoustic.letter_decisions(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 0): ("a", "a", 4.9), (1, 1): ("b", "c", -4.9)}


def test_targets_without_a_delimiter_and_words_without_letters(spark):
    words = spark.createDataFrame([(1, 0, "ab"), (1, 1, "zz"), (1, 2, "a")], "u long, word int, text string")
    rows = lambda d: [(r.start, r.end, r.ids, r.unknown) for r in acoustic.target_rows(words, ["u"], {"a": 1, "b": 2, "|": 3}, d).orderBy("word").collect()]
    assert rows("|") == [(0, 2, [1, 2], []), (3, 3, [], ["z", "z"]), (4, 5, [1], [])]
    assert rows(None) == [(0, 2, [1, 2], []), (2, 2, [], ["z", "z"]), (2, 3, [1], [])]


def test_explanations_name_what_decided(spark):
    rows = [
        (1, "A", "ok", 0.9, 0.3, []), (1, "B", "ok", 0.5, 0.125, ["day", "sum", "name"]), (1, "C", "failed", 0.0, None, []),
        (2, "A", "ok", 0.9, 0.1, ["day"]), (2, "B", "ok", 0.905, 0.2, ["sum"]), (3, "A", "failed", 0.0, None, []), (3, "B", "failed", 0.0, None, []),
        (4, "A", "ok", 1.0, None, []), (5, "A", "ok", 1.0, 0.5, []), (5, "B", "ok", 0.125, None, []),
    ]
    got = {r.clip_id: r for r in plans.explained(spark.createDataFrame(rows, "clip_id long, provider string, status string, score double, wer double, lost array<string>"), "bookings").collect()}
    say = plans.SENTENCES
    assert got[1].explanation == " ".join([say["winner"] % ("A", "bookings", 90), say["higher"] % ("B", "30.0", "12.5", "B", "**day**, **sum** and **name**"), say["failed"] % "**C**"])
    assert got[2].winner == "B" and got[2].explanation.endswith(say["note"] % ("B", "**sum**"))
    assert (got[3].winner, got[3].runner_up, got[3].explanation) == (None, None, say["none"])
    assert got[4].explanation == say["winner"] % ("A", "bookings", 100)
    assert got[5].explanation.endswith(say["close"] % ("B", 12))


def test_events_of_letters_follow_the_best_source(spark):
    schema = "k long, checks array<struct<letter string, heard string, margin double>>, ops array<struct<ref string, kind string, units array<struct<letter string, gop double, heard string>>, wrong array<string>>>"
    ops = [("abq", "match", None, None), ("ab", "deletion", None, ["a"]), (None, "insertion", None, None), ("ab", "substitution", [], ["b"]), ("ab", "match", [("a", -2.0, ""), ("q", 0.0, "q"), ("b", -1.0, "b")], ["a"])]
    rows = [(1, [("a", "a", 0.5), ("b", "c", -0.5)], ops), (2, [], ops), (3, None, []), (4, None, None)]
    got = [tuple(r) for r in reading.letter_events(spark.createDataFrame(rows, schema), "k", -1.0, ["q"]).collect()]
    text = [("abq", "a", True), ("abq", "b", True), ("ab", "a", True), ("ab", "b", False)]
    want = [(1, "a", "a", 0.5, True, "letter_check"), (1, "b", "b", -0.5, False, "letter_check")]
    want += [(2, w, c, None, ok, "text") for w, c, ok in text] + [(2, "ab", "a", -2.0, False, "gop"), (2, "ab", "b", -1.0, True, "gop")]
    assert got == want


def test_assessments_of_each_layout(spark, tmp_path):
    import pytest

    from sonorant.sources.truth import read_assessments

    texts = {"levels": '\ufeffHuman_Level, system_level,note\n3,4,"a ""b"""\n,2,\n', "pairs": "heard,expected\nb,a\n", "asr": 'level,reference,hypothesis\n1,"one\ntwo",one\n', "other": "a,b\n1,2\n", "none": "expected,heard\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
    rows = lambda name: [tuple(r) for r in read_assessments(spark, f"{tmp_path}/{name}.csv").collect()]
    assert rows("levels") == [("3", "4"), ("", "2")]
    assert rows("pairs") == [("a", "b")] and rows("asr") == [("1", "one\ntwo", "one")] and rows("none") == []
    with pytest.raises(ValueError):
        rows("other")

import itertools
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonorant.functions import acoustic, align, devanagari, text
from sonorant.operators import dataset, reading
from sonorant.operators import results as ops


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_normalize_drops_combining_marks_and_odd_spaces(spark):
    assert one(spark, text.normalize(F.lit("  It's GOOD, no?  _x "))) == "it's good no _x"
    assert one(spark, text.normalize(F.lit("हिन्दी"))) == "ह न द"
    assert one(spark, text.normalize(F.lit(None).cast("string"))) == ""
    assert one(spark, text.normalize(F.lit("ﬁne Ⅳ"), compatibility=True)) == "fine iv"


def test_edit_counts_and_paths_agree(spark):
    rng = np.random.default_rng(1)
    pairs = [([f"t{x}" for x in rng.integers(0, 4, rng.integers(0, 8))], [f"t{x}" for x in rng.integers(0, 4, rng.integers(0, 8))]) for _ in range(150)]
    df = spark.createDataFrame(pairs, "r array<string>, h array<string>")
    got = align.align(df.withColumn("n", text.edit_count(F.col("r"), F.col("h")))).collect()
    assert len(got) == len(pairs)
    for x in got:
        a = x.alignment
        assert a["sub"] + a["del"] + a["ins"] == x.n == distance(x.r, x.h)
        assert [t for s in a.segments for t in s.ref] == x.r and [t for s in a.segments for t in s.hyp] == x.h
        assert all(p.op != q.op for p, q in itertools.pairwise(a.segments))


def test_error_rate_of_an_empty_reference(spark):
    assert one(spark, text.error_rate(F.lit(0), F.lit(0))) == 0 and one(spark, text.error_rate(F.lit(3), F.lit(0))) == 1
    assert one(spark, text.english_list(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b and c"
    assert one(spark, text.english_list(F.array().cast("array<string>"))) == "nothing"
    assert one(spark, text.masked(F.lit("abcdefghijklmn"))) == "abcde…klmn"


@pytest.mark.parametrize(
    ("lang", "given", "want"),
    [
        ("hi", "गाय, घर!", "गाय घर"),
        ("hi", "ab १२", "अब 12"),
        ("hi", "क़लम पढ़ना", "कलम पढ़ना"),
        ("mr", "पढ़ना", "पढना"),
        ("hi", "माँ हँस", "मां हँस"),
        ("mr", "हँस", "हंस"),
        ("hi", "सन्त अङ्क जन्म", "संत अंक जन्म"),
        ("hi", "नयी", "नई"),
        ("mr", "नयी", "नयी"),
        ("hi", "ka‍mala pakka", "कमला पक्का"),
        ("hi", None, ""),
    ],
)
def test_devanagari_rules(spark, lang, given, want):
    df = spark.createDataFrame([(given,)], "x string")
    assert df.select(devanagari.normalize(F.col("x"), lang).alias("y")).first().y == unicodedata.normalize("NFC", want)


def test_devanagari_is_idempotent_and_names_are_known(spark):
    df = spark.createDataFrame([("सन्त ghar १२, माँ",), ("नयी‌ क़लम",)], "x string")
    once = df.select(devanagari.normalize(F.col("x"), "Hindi").alias("x"))
    assert once.collect() == once.select(devanagari.normalize(F.col("x"), "hi-IN").alias("x")).collect()
    with pytest.raises(ValueError):
        devanagari.profile("xx")


def aligned(lp, targets):
    first, last = acoustic.spans_of(acoustic.best_states(lp[None], np.array([targets]), 0), len(targets))
    return list(zip(first[0].tolist(), last[0].tolist(), strict=True))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(40):
        t, targets = int(rng.integers(3, 7)), rng.integers(1, 3, rng.integers(1, 3)).tolist()
        lp = np.log(rng.dirichlet(np.ones(3), t))
        best = -np.inf
        for path in itertools.product(range(3), repeat=t):
            kept = [p for k, p in enumerate(path) if p and (k == 0 or path[k - 1] != p)]
            if kept == targets:
                best = max(best, sum(lp[k, p] for k, p in enumerate(path)))
        if best == -np.inf:
            assert len(targets) + sum(a == b for a, b in zip(targets, targets[1:], strict=False)) > t
            continue
        spans = aligned(lp, targets)
        frames = np.zeros(t, int)
        for token, (a, b) in zip(targets, spans, strict=True):
            frames[a : b + 1] = token
        assert abs(sum(lp[k, p] for k, p in enumerate(frames)) - best) < 1e-9


def test_many_tokens_fit():
    lp = np.log(np.full((250, 4), 0.25))
    assert len(aligned(lp, [1, 2, 3] * 40)) == 120


def test_nearest_rank_of_small_groups(spark):
    rows = [(n, float(v)) for n in range(1, 9) for v in range(1, n + 1)]
    got = {r.g: r.p50 for r in ops.nearest_rank(spark.createDataFrame(rows, "g int, v double"), ["g"], "v").collect()}
    assert [got[n] for n in range(1, 9)] == [1, 2, 2, 2, 3, 4, 4, 4]


def test_pooled_rates(spark):
    schema = "provider string, metric string, value double, error string, errors double, length double"
    rows = [("a", "wer", 0.5, None, 1.0, 2.0), ("a", "wer", 1.0, None, 3.0, 0.0), ("b", "wer", 1.0, None, 1.0, 0.0), ("c", "wer", 0.2, None, None, None), ("c", "wer", 0.5, None, 1.0, 2.0), ("a", "wer", None, "boom", None, None), ("a", "odd", 1.0, None, None, None)]
    got = {r.provider: (r.value, r.metric_errors) for r in ops.pooled(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": (2.0, 1), "b": (None, 0), "c": (0.2, 0)}


def test_kappa_without_spread_is_one(spark):
    df = spark.createDataFrame([("g", 2, 2), ("g", 2, 2), ("h", 0, 4), ("h", 4, 0)], "grp string, human int, system int")
    got = {r.grp: r.weighted_kappa for r in reading.level_agreement(df, "grp").collect()}
    assert got == {"g": 1.0, "h": -1.0}


def test_placement_and_tasks(spark):
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    for args, level, after in [((t, t, n, n), 4, None), ((t, f, n, n), 3, None), ((f, n, t, n), 2, None), ((f, n, f, t), 1, None), ((f, n, f, f), 0, None), ((t, n, n, n), None, 4), ((n, n, n, n), None, 3), ((f, n, f, n), None, 1)]:
        assert one(spark, reading.placement(*args)) == level and one(spark, reading.next_task(*args)) == after
    assert one(spark, reading.passed(F.lit(3), F.lit(3), F.lit(0))) and not one(spark, reading.passed(F.lit(1), F.lit(0), F.lit(3)))


def test_truth_rows(spark):
    rows = [("a", 2, ""), ("a", 3, "x"), ("a", 4, "y"), ("", 5, "z"), (None, 6, "z"), ("b", 7, " ")]
    got = {r.ordinal: r.reason for r in dataset.accepted_rows(spark.createDataFrame(rows, "id string, ordinal int, text string")).collect()}
    assert got == {2: "empty_text", 3: None, 4: "duplicate_id", 5: "empty_id", 6: "empty_id", 7: "empty_text"}


def test_versions_and_pending(spark):
    rows = [("r", "c1", "p", "failed", 1), ("r", "c1", "p", "ok", 2), ("r", "c2", "p", "ok", 1)]
    got = ops.latest(spark.createDataFrame(rows, "run_id string, clip_id string, provider string, status string, updated_at long")).collect()
    assert sorted((r.clip_id, r.status) for r in got) == [("c1", "ok"), ("c2", "ok")]

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonorant.functions import align, batched, text
from tests.test_whole_texts import plain_path, table, unit

TOKENS = pa.list_(pa.string())


def cases(seed, lengths, alphabets=("ab", "abcdefghij", [f"w{k}" for k in range(300)])):
    rng = random.Random(seed)
    for n in lengths:
        alphabet, noise = rng.choice(alphabets), rng.choice((0, 0.05, 0.2, 0.45))
        r = [rng.choice(alphabet) for _ in range(n)]
        yield r, [x if rng.random() > noise else rng.choice(alphabet) for x in r for _ in range(rng.choices((1, 0, 2), (8, noise * 8, noise * 4))[0])]


@pytest.mark.parametrize("least", [0, batched.LEAST_PAIRS, 10**9])
def test_batches_against_the_whole_edit_table(monkeypatch, least):
    monkeypatch.setattr(batched, "LEAST_PAIRS", least)
    pairs = [*cases(1, [0, 1, 2, 3, 20, 63, 64, 65, 66] * 6), ([], ["a"]), (["a"], []), ([], []), (["a", "b"], ["b", "a"] * 70), (["b", "a"] * 70, ["a"])]
    ref, hyp = (pa.array([p[k] for p in pairs], TOKENS) for k in (0, 1))
    assert batched.distances(ref, hyp).tolist() == [table(r, h, unit)[-1][-1] for r, h in pairs]
    _, _, ops = batched.paths(ref, hyp)
    for (r, h), got in zip(pairs, ops, strict=True):
        want = [batched.DEL if j is None else batched.INS if i is None else batched.EQUAL if r[i] == h[j] else batched.SUB for i, j in plain_path(r, h, unit)]
        assert got.tolist() == want


def test_many_words_side_by_side_equal_the_tiles(monkeypatch):
    pairs = list(cases(2, [700, 300, 130, 128, 129, 65, 10] * 8))
    ref, hyp = (pa.array([p[k] for p in pairs], TOKENS) for k in (0, 1))
    for cells in (1 << 22, 1 << 12):  # one group, and many
        monkeypatch.setattr(batched, "CELLS", cells)
        monkeypatch.setattr(batched, "LEAST_PAIRS", 0)
        assert batched.distances(ref, hyp).tolist() == [align.distance(r, h) for r, h in pairs]
        want = [[batched._CODE[op] for op, _, _ in align.edit_path(r, h)] for r, h in pairs]
        assert [o.tolist() for o in batched.paths(ref, hyp)[2]] == want
        for (r, h), got in zip(pairs, batched.alignments(ref, hyp).to_pylist(), strict=True):
            assert got["segments"] == align.segments(r, h)


def test_columns_of_slices_nulls_and_strings(spark):
    rows = [(0, list("abc"), list("adc")), (1, None, ["x"]), (2, [], []), (3, ["x", None], ["x"]), (4, list("aab"), list("ab")), (5, None, None)]
    df = spark.createDataFrame(rows, "k int, r array<string>, h array<string>").coalesce(1)
    got = {r.k: r.alignment.asDict(True) for r in align.align(df, tokens=3).collect()}
    assert {k: (a["sub"], a["del"], a["ins"]) for k, a in got.items()} == {0: (1, 0, 0), 1: (0, 0, 1), 2: (0, 0, 0), 3: (0, 1, 0), 4: (0, 1, 0), 5: (0, 0, 0)}
    assert [s["op"] for s in got[0]["segments"]] == ["equal", "sub", "equal"] and got[2]["segments"] == []
    assert [(s["ref"], s["hyp"]) for s in got[3]["segments"]] == [(["x"], ["x"]), ([None], [])]
    count = text.edit_count(F.col("r"), F.col("h")).alias("n")
    assert {r.k: r.n for r in df.select("k", count).collect()} == {0: 1, 1: None, 2: 0, 3: 1, 4: 1, 5: None}
    strings = spark.createDataFrame([("kitten", "sitting"), ("", "ab"), ("\U00010348a", "a"), (None, "a")], "r string, h string")
    assert [r.n for r in strings.select(text.edit_count(F.col("r"), F.col("h")).alias("n")).collect()] == [3, 2, 1, None]


def test_least_paths_of_a_batch_need_no_edit_table(monkeypatch):
    pairs = [([f"w{k}" for k in range(n)], [f"w{k}x" if k % 7 == 3 else f"w{k}" for k in range(n) if k % 7]) for n in (0, 1, 5, 40, 3000)]
    pairs += [(h, r) for r, h in pairs]
    for name in ("sweep", "edit_path", "distance"):
        monkeypatch.setattr(batched, name, lambda *_: pytest.fail("an edit table"))
    ref, hyp = (pa.array([p[k] for p in pairs], TOKENS) for k in (0, 1))
    edits = [sum(k % 7 in (0, 3) for k in range(n)) for n in (0, 1, 5, 40, 3000)] * 2
    assert batched.distances(ref, hyp).tolist() == edits
    for (r, h), ops, n in zip(pairs, batched.paths(ref, hyp)[2], edits, strict=True):
        assert (ops != batched.EQUAL).sum() == n and len(ops) == max(len(r), len(h))


def test_pairs_are_rescored_where_they_are():
    ref = pa.array([["z"], ["a", "b", "c", "d"], ["a", "b", "c", "d"], None, ["cat", None], []], TOKENS)
    hyp = pa.array([["z"], ["a", "x", "c", "yy"], ["a", "x", "c", "yy"], ["q"], ["cut"], None], TOKENS)
    told = pa.array([[0], [1, 7, -1, None, 2**62], [0, 0], [], None, [0]], pa.list_(pa.int64()))
    for at in (0, 1):  # slices too
        got = batched.rescored(ref[at:], hyp[at:], told[at:])
        rows = list(zip(*(got[c].tolist() for c in ("forgiven", "segments", "words", "letters", "m")), strict=True))
        assert [tuple(r[:3]) for r in rows] == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (0, 1, 1), (0, 1, 2), (0, 0, 0)][at:]
        assert [r[3:] for r in rows] == [(0, 1), (1, 4), (2, 4), (1, 0), (1, 3), (0, 0)][at:]

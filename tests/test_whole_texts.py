import random
import re
from collections import Counter

import pytest

from sonorant.functions import align
from sonorant.operators import wordops
from sonorant.queries import QUERIES


def table(ref, hyp, swap):
    t = [[float(i + j) for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    for i, a in enumerate(ref, 1):
        for j, b in enumerate(hyp, 1):
            t[i][j] = min(t[i - 1][j - 1] + swap(a, b), t[i - 1][j] + 1, t[i][j - 1] + 1)
    return t


def plain_path(ref, hyp, swap):
    t, out, i, j = table(ref, hyp, swap), [], len(ref), len(hyp)
    while i or j:
        if i and j and abs(t[i][j] - t[i - 1][j - 1] - swap(ref[i - 1], hyp[j - 1])) < 1e-9:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and abs(t[i][j] - t[i - 1][j] - 1) < 1e-9:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def unit(a, b):
    return float(a != b)


def near(a, b):
    return 0.0 if a == b else 0.5 + table(a, b, unit)[-1][-1] / max(len(a), len(b))


def runs(ref, hyp):
    """Maximal runs of equal words or of edits: (equal, words of ref, words of hyp)."""
    out = []
    for i, j in plain_path(ref, hyp, unit):
        same = i is not None and j is not None and ref[i] == hyp[j]
        if not out or out[-1][0] != same:
            out.append((same, [], []))
        out[-1][1].extend([] if i is None else [ref[i]])
        out[-1][2].extend([] if j is None else [hyp[j]])
    return out


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(5)
    words = ["The", "tide", "river", "a", "and", "stone", "under", "bridge", "tax", "deep", "ox", "oxx"]
    rows = [(k, None if k == 0 else "" if k == 1 else " ".join(rng.choice(words) for _ in range(12 * k)) + ".", "en" if k % 2 else "de") for k in range(7)]
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    pairs = {}
    for k, text, lang in rows:
        r = [w for w in re.split("[^a-z]+", (text or "").lower()) if w]
        pairs[k] = lang, r, [w + "x" if (i + k) % 5 == 0 else w for i, w in enumerate(r, 1) if (i + k) % 7]
    assert max(len(r) for _, r, _ in pairs.values()) > 60
    return path, pairs


def rows(spark, texts, name):
    return [r.asDict() for r in QUERIES[name](spark, texts[0]).collect()]


def test_word_error_rates(spark, texts):
    want = {k: (table(r, h, unit)[-1][-1], len(r)) for k, (_, r, h) in texts[1].items()}
    got = rows(spark, texts, "wer_pairs")
    assert {r["doc_id"]: (r["errors"], r["length"]) for r in got} == want
    assert {r["doc_id"]: r["wer"] for r in got} == {k: round(e / n, 6) if n else 0 for k, (e, n) in want.items()}
    by = {lang: [want[k] for k, p in texts[1].items() if p[0] == lang] for lang in ("en", "de")}
    sums = {lang: (sum(e for e, _ in v), sum(n for _, n in v)) for lang, v in by.items()}
    assert {r["lang"]: (r["errors"], r["length"]) for r in rows(spark, texts, "wer_pooled_by_lang")} == sums
    want = {lang: (len(v), round(sums[lang][0] / sums[lang][1], 6), round(sum(e == 0 for e, _ in v) / len(v), 6)) for lang, v in by.items()}
    assert {r["lang"]: (r["samples"], r["wer"], r["exact"]) for r in rows(spark, texts, "level_benchmark")} == want


def test_segments_and_forgiven_rates(spark, texts):
    segments = {r["doc_id"]: r for r in rows(spark, texts, "edit_segments")}
    rates = {r["doc_id"]: r for r in rows(spark, texts, "forgiven_wer")}
    assert set(segments) == set(rates) == set(texts[1])
    for k, (_, r, h) in texts[1].items():
        path, parts = plain_path(r, h, unit), runs(r, h)
        assert segments[k]["sub"] == sum(None not in p and r[p[0]] != h[p[1]] for p in path)
        assert (segments[k]["del"], segments[k]["ins"]) == (sum(j is None for _, j in path), sum(i is None for i, _ in path))
        differing = [p for p in parts if not p[0]]
        assert segments[k]["differing"] == " | ".join(f"{' '.join(a)} > {' '.join(b)}" for _, a, b in differing)
        fixed, n, forgiven = [], 0, 0
        for same, a, b in parts:
            told = not same and (n + k) % 2 == 0
            fixed += a if told else b
            n, forgiven = n + (not same), forgiven + told
        chars = "".join(r), "".join(fixed)
        assert (rates[k]["segments"], rates[k]["forgiven"]) == (n, forgiven)
        assert rates[k]["llm_wer"] == (round(table(r, fixed, unit)[-1][-1] / len(r), 6) if r else 0)
        assert rates[k]["llm_cer"] == (round(table(*chars, unit)[-1][-1] / len(chars[0]), 6) if r else 0)


def test_confusions(spark, texts):
    seen = Counter((a[0], b[0]) for _, r, h in texts[1].values() for a, b in zip(r, h, strict=False))
    wrong = {p: n for p, n in seen.items() if p[0] != p[1]}
    assert {(r["expected"], r["heard"]): r["count"] for r in rows(spark, texts, "letter_confusions")} == wrong
    first = {a: sorted((-n, h) for (e, h), n in wrong.items() if e == a and n >= 2)[:4] for a, _ in wrong}
    assert {(r["expected"], r["place"]): (-r["count"], r["heard"]) for r in rows(spark, texts, "top_confusions")} == {(a, p): x for a, v in first.items() for p, x in enumerate(v, 1)}
    both = Counter()
    for p, n in wrong.items():
        both[tuple(sorted(p))] += n
    listed = {("d", "t"), ("a", "e"), ("q", "z")}
    want = {(*p, "unlisted") for p, n in both.items() if n >= 2 and p not in listed} | {(*p, "unseen") for p in listed if p not in both}
    assert {(r["a"], r["b"], r["finding"]) for r in rows(spark, texts, "confusion_audit")} == want


def test_readings(spark, texts, monkeypatch):
    got, profile = {r["doc_id"]: r for r in rows(spark, texts, "reading_ops")}, rows(spark, texts, "mistake_profile")
    monkeypatch.setattr(wordops, "path", lambda ref, hyp: plain_path(ref, hyp, near))
    kinds = Counter()
    for k, (lang, r, h) in texts[1].items():
        ops = wordops.word_ops(r, h, "hi")
        counted = [o for o in ops if o["counts"]]
        assert (got[k]["mistakes"], got[k]["correct"]) == (len(counted), sum(not o["counts"] and o["ref"] is not None and o["hyp"] is not None for o in ops))
        assert got[k]["places"] == ",".join(str(o["ref_index"]) for o in counted)
        for o in counted:
            kinds[lang, f"substitution:{o['category']}" if o["kind"] == "substitution" else o["kind"]] += 1
            kinds.update((lang, f"sound:{s}") for s in o["subtypes"])
    assert {(r["lang"], r["mistake"]): r["n"] for r in profile} == kinds


@pytest.mark.parametrize("tile", [1, 3, 4096])
def test_tiles_do_not_change_the_path(monkeypatch, tile):
    monkeypatch.setattr(align, "TILE", tile)
    rng = random.Random(6)
    for _ in range(200):
        r, h = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        path = [(None if op == "ins" else i, None if op == "del" else j) for op, i, j in align.edit_path(r, h)]
        assert path == plain_path(r, h, unit) and align.distance(r, h, tile) == table(r, h, unit)[-1][-1]


def test_banded_word_paths_of_several_steps():
    rng = random.Random(7)
    words = ["ab", "abx", "ba", "cab", "c", "x" * 70, "x" * 66 + "ab", "abc", "y" * 40]
    for n in (5, 90, 150, 150):
        r = [rng.choice(words) for _ in range(n)]
        h = [w for w in r if rng.random() < 0.8] + [rng.choice(words) for _ in range(3)]
        assert wordops.path(r, h) == plain_path(r, h, wordops.swap_cost)


def test_least_paths_are_the_tables_first():
    rng, met = random.Random(8), 0
    vocabularies = ["ab abx ba cab c abc a ax b".split(), "de dex del d en enx x".split(), "abcd abcdx abce abc bcd".split()]
    for _ in range(600):
        words = rng.choice(vocabularies)
        r = [rng.choice(words) for _ in range(rng.randrange(14))]
        h = [w + "x" * (rng.random() < 0.2) for w in r if rng.random() < 0.8] + [rng.choice(words) for _ in range(rng.randrange(3)) if rng.random() < 0.2]
        for a, b in ((r, h), (h, r)):
            got, want = wordops.least_path(a, b), plain_path(a, b, near)
            met += got is not None
            assert got in (None, want) and wordops.banded_path(a, b) == want
    assert met > 600


def test_long_readings_need_no_table(monkeypatch):
    monkeypatch.setattr(wordops, "swap_costs", lambda *_: pytest.fail("a table of all pairs of words"))
    r = [f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(17_000)]
    h = [w + "x" if i % 5 == 0 else w for i, w in enumerate(r) if i % 7]
    path = wordops.path(r, h)
    assert [j for _, j in path if j is not None] == list(range(len(h)))
    assert all((j is None) == (i % 7 == 0) for i, j in path)


def test_more_distinct_tokens_than_code_points_of_a_plane(spark):
    from pyspark.sql import functions as F

    from sonorant.functions import text

    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(70_000)), lambda x: x.cast("string")).alias("r"))
    df = df.withColumn("h", F.transform("r", lambda x, i: F.when(i % 100 == 99, F.concat(x, F.lit("x"))).otherwise(x)))
    assert df.select(text.edit_count(F.col("r"), F.col("h")).alias("n")).first().n == 700


def test_least_places_need_no_edit_table(monkeypatch):
    rng, met = random.Random(9), 0
    for _ in range(400):
        r = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        h = [x if rng.random() < 0.8 else rng.choice("xyza") for x in r if rng.random() < 0.8]
        for a, b in ((r, h), (h, r)):
            places = align.least_places(*((b, a) if len(a) < len(b) else (a, b)))
            met += places is not None
            path = [(None if op == "ins" else i, None if op == "del" else j) for op, i, j in align.edit_path(a, b)]
            assert path == plain_path(a, b, unit) and align.distance(a, b) == table(a, b, unit)[-1][-1]
    assert met > 400
    monkeypatch.setattr(align, "_sweep", lambda *_: pytest.fail("an edit table"))
    r = [f"w{k}" for k in range(17_000)]
    h = [w + "x" if i % 7 == 3 else w for i, w in enumerate(r) if i % 7]
    ops = [op for op, _, _ in align.edit_path(r, h)]
    assert ops == ["del" if i % 7 == 0 else "sub" if i % 7 == 3 else "equal" for i in range(len(r))]
    assert align.distance(r, h) == align.distance(h, r) == len(ops) - ops.count("equal")


def test_banded_distances_are_the_whole_tables(monkeypatch):
    rng = random.Random(10)
    pairs = []
    for n in (90, 300, 700, 1500):
        r = "".join(rng.choice("abcdef") for _ in range(n))
        pairs += [(r, "".join(c if rng.random() > q else rng.choice(["", c + "a", "b"]) for c in r)) for q in (0.02, 0.1, 0.5)] + [(r, r[: n // 3] + r[n // 2 :] + "ab")]
    want = [len(h) - len(r) + sum(align._tiles(r, h, align.TILE)[1]) for r, h in pairs]
    assert [align.distance(r, h) for r, h in pairs] == [align.distance(h, r) for r, h in pairs] == want
    # Of a like pair no whole table is made.
    monkeypatch.setattr(align, "_tiles", lambda *_: pytest.fail("a whole edit table"))
    assert [align.distance(r, h) for r, h in pairs[12:14]] == want[12:14]

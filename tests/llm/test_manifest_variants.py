"""Manifests, spelling variants and nearest neighbours against plain versions."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonorant.llm import merkle, neighbours, spelling
from sonorant.llm.queries import QUERIES
from tests.llm.conftest import edge_rows


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(digests, arity):
    """Root, and for each leaf its runs from below: (digests before it, digests after it)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for leaf, k in enumerate(at):
            run = k // arity * arity
            paths[leaf].append(("".join(level[run:k]), "".join(level[k + 1 : run + arity])))
        level = [sha(*level[k : k + arity]) for k in range(0, len(level), arity)]
        at = [k // arity for k in at]
    return level[0], paths


def plain_manifest(rows, arity=2):
    """rows (doc_id, text, lang, source, n_chars) -> sorted (doc_id, leaf, subroot, root, proof)."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        groups.setdefault("" if lang is None else "=" + lang, []).append(((doc_id is not None, doc_id or 0), plain_leaf(doc_id, source, lang, n_chars, text), doc_id))
    groups = {k: sorted(groups[k], key=lambda x: x[:2]) for k in sorted(groups, key=str.encode)}
    trees = [plain_tree([x[1] for x in g], arity) for g in groups.values()]
    root, over = plain_tree([t[0] for t in trees], arity)
    return sorted(
        ((x[2], x[1], sub, root, sha(*(s for step in path + above for s in step))) for g, (sub, paths), above in zip(groups.values(), trees, over, strict=True) for x, path in zip(g, paths, strict=True)),
        key=str,
    )


def proof(path):
    return F.sha2(F.array_join(F.transform(path, lambda s: merkle.hexed(F.concat(s["left"], s["right"]))), ""), 256)


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_manifest_against_plain_trees(spark, arity):
    rows = [(k, f"text {k} ü", ["en", "de", None, "zz", "ü"][k % 7 % 5], f"s{k % 3}", k) for k in range(83)] + [(500, "alone", "only", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    out = merkle.manifest(docs, F.col("doc_id") % 2 == 0, arity).withColumn("folded", merkle.folded(F.unhex("changed"), F.col("path"))).withColumn("proof", proof("path")).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in out), key=str) == plain_manifest(rows, arity)
    # One more character is another root; a null count of characters stays as it is.
    assert all((r.folded == r.root) == (r.doc_id % 2 == 1 or r.doc_id == 500) for r in out)


def test_manifest_edge_cases(edge, empty):
    out = merkle.manifest(edge).withColumn("proof", proof("path")).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in out), key=str) == plain_manifest([r[:5] for r in edge_rows()])
    assert merkle.manifest(empty).count() == 0
    one = merkle.manifest(edge.where("doc_id = 1")).first()
    assert one.leaf == one.subroot == one.root and one.path == []


def test_manifest_query_tells_tampered_rows(spark):
    got = QUERIES["op13_merkle_manifest"](spark, "/root/testdata/sf0.001").collect()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got), key=str) == plain_manifest([tuple(r) for r in rows])
    for r in got:
        assert r.verified == (r.folded_root == r.root) == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)


def test_numbers_have_no_gaps(spark):
    rows = spark.range(5000).select((F.col("id") % 3 > 0).cast("string").alias("g"), (F.col("id") * 7919 % 5000).alias("v"), "id")
    got = merkle.numbered(rows, "g", ["v", "id"]).orderBy("g", "v").collect()
    for g in ("false", "true"):
        own = [r for r in got if r.g == g]
        assert [r.idx for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}


def plain_near(words):
    """Pairs one edit apart, by deleting letters."""
    by = {}
    for w in words:
        for i in range(len(w)):
            by.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    pairs = {tuple(sorted(p)) for ws in by.values() for p in itertools.combinations(ws, 2)}
    return pairs | {tuple(sorted((w, rest))) for w in words for rest in {w[:i] + w[i + 1 :] for i in range(len(w))} if rest in words}


def plain_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            if doc_id is not None and (h := zlib.crc32(f"{doc_id}:{run}".encode())) % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    n = {w: k for w, k in n.items() if k >= 2}
    near = {w: [] for w in n}
    for a, b in plain_near(set(n)):
        near[a].append(b)
        near[b].append(a)
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def test_pivots_are_the_rarest_disjoint_pair():
    rng = np.random.default_rng(4)
    for _ in range(300):
        places = sorted(rng.choice(12, int(rng.integers(3, 8)), False).tolist())
        grams = [(int(rng.integers(0, 9)), p) for p in places]
        p, q = spelling.pivots(grams)
        rank = dict((at, r) for r, at in grams)
        assert q - p >= 2
        assert rank[p] + rank[q] == min(a[0] + b[0] for a in grams for b in grams if b[1] - a[1] >= 2)


def test_near_pairs_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abcé"), int(rng.integers(7, 10)))) for _ in range(1500)}
    words |= {w[:i] + "ÿ" + w[i + k :] for w in sorted(words)[:200] for i, k in ((0, 0), (0, 1), (len(w), 0), (len(w) - 1, 1), (3, 0), (4, 1))}
    words |= {"a" * 7, "a" * 8, "a" * 9, "ab" * 4, "ba" * 4, "a" * 3000, "a" * 2999 + "b"}
    found = spelling.near_pairs(spark.createDataFrame([(w, k) for k, w in enumerate(sorted(words))], "word string, n long").repartition(4)).collect()
    assert len(found) == len({(r.a, r.b) for r in found})
    assert {(r.a, r.b) for r in found} == plain_near(words)


def test_variants_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = ["".join(rng.choice(list("aeiourstlnÉé"), int(rng.integers(7, 12)))) for _ in range(60)]
    rows = []
    for d in range(400):
        text = []
        for k in rng.zipf(1.3, 60) % 60:
            w, i = base[k], int(rng.integers(0, 7))
            text.append(w[:i] + rng.choice(["x", ""]) + w[i + 1 :] if rng.random() < 0.08 else w.upper() if rng.random() < 0.2 else w)
        rows.append((d, " ".join(text)))
    rows += [(None, "chained " * 300 + "chaines " * 25 + "xhaines " * 2), (None, "variant variant Variant"), (400, None), (401, ""), (402, "short"), (402, "variänẗs" * 3)]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted(tuple(r) for r in got) == plain_variants(rows)
    assert {r.form for r in got} - {None} and any(r.root != (r.form or r.word) for r in got)


def test_variants_edge_cases(edge, empty):
    assert sorted(tuple(r) for r in spelling.variants(edge).collect()) == plain_variants([r[:2] for r in edge_rows()])
    assert spelling.variants(empty).count() == 0


def test_roots_follow_chains(spark):
    forms = [(f"w{k}", f"w{k + 1}") for k in range(11)] + [("x", "y")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {f"w{k}": "w11" for k in range(11)} | {"x": "y"}


def test_variants_broadcast_no_table(spark, monkeypatch):
    plans, store = [], spelling.materialize
    explained = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def stored(df, name):
        plans.extend([explained(df)] if name == "roots" else [])
        return store(df, name)

    monkeypatch.setattr(spelling, "materialize", stored)
    rows = [(1, "variant " * 200 + "varient " * 15), (2, "variint variint")]
    words = store(spelling.occurrences(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("word").agg(F.sum("n").alias("n")), "words")
    plans += [explained(spelling.near_pairs(words)), explained(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))]
    assert len(plans) >= 4 and not [p for p in plans if "Broadcast" in p]


def plain_nearest(rows, asked, k=20):
    """rows (vec_id, values) -> query_id -> [(vec_id, score)]."""
    able = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    able = [x for at, x in enumerate(able) if not any(y[0] == x[0] and y[1].tolist() == x[1].tolist() for y in able[:at])]
    out = {}
    for at, (i, q) in enumerate(able):
        if asked(i):
            near = [(-(q * v).sum(), j) for b, (j, v) in enumerate(able) if b != at and len(v) == len(q)]
            out.setdefault(i, []).extend((j, -s) for s, j in sorted(near)[:k])
    return out


def as_lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


SCHEMA = "vec_id long, embedding array<float>, n string, key long, kind int, cid long, score double, rank int"


def test_small_tables_are_searched_exactly(spark):
    rng = np.random.default_rng(7)
    rows = [(k, rng.standard_normal(12).tolist()) for k in range(150)] + [(200 + k, [float(x) for x in rng.integers(-1, 2, 3)]) for k in range(60)]
    rows += [(300 + k, [1.0, 2.0, 2.0]) for k in range(70)] + [(400, None), (401, []), (402, [0.0] * 12), (403, [float("nan")] * 12), (404, [1.0, None, 2.0]), (None, [1.0, 2.0, 2.0]), (420, [7.0]), (20, rows[20][1])]
    df = spark.createDataFrame([(i, v, "n", 1, 1, 1, 1.0, 1) for i, v in rows], SCHEMA).repartition(5)
    floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = {i: v for i, v in plain_nearest(floats, lambda i: i % 20 == 0).items() if v}
    got = as_lists(neighbours.nearest(df, F.col("vec_id") % 20 == 0))
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for i in want for a, b in zip(got[i], want[i], strict=True))
    assert neighbours.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(df, F.col("vec_id") < 0).count() == 0


def test_recall_and_full_buckets(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 40)  # so that members and queries of a bucket are dealt
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:900] = x[0] + 1e-3 * rng.standard_normal((900, 24))  # a third are nearly one vector
    x[900:1000] = 30 * x[900]  # copies
    x[1000:1300] *= 5.0  # lengths count
    x = x.astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = as_lists(neighbours.nearest(df, F.col("vec_id") % 20 == 0))
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    hit = 0
    for k in range(0, 3000, 20):
        assert len(got[k]) == 20 and got[k] == sorted(got[k], key=lambda r: (-r[1], r[0])) and k not in dict(got[k])
        assert all(abs(score - s[k, j]) < 1e-9 for j, score in got[k])
        hit += len(set(np.argsort(-s[k], kind="stable")[:20].tolist()) & {j for j, _ in got[k]})
    assert hit / 3000 >= 0.9
    assert [j for j, _ in got[920]] == [j for j in range(900, 921) if j != 920]


def test_queries_that_meet_too_few_probe_all_buckets(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "fitted_probes", lambda *a: 1)
    monkeypatch.setattr(neighbours, "TABLES", 1)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal((5000, 64)) + 40 * np.eye(64)[0], -40 * np.eye(64)[:1]])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = neighbours.nearest(df, F.col("vec_id") == 5000).orderBy("rank").collect()
    s = x[:5000] @ x[5000]
    assert [r.vec_id for r in got] == np.argsort(-s, kind="stable")[:20].tolist()
    assert [r.score for r in got] == pytest.approx(np.sort(-s)[:20] * -1)


def test_held_answers_are_merged():
    rng = np.random.default_rng(10)
    qid, cid = rng.integers(0, 9, 4000), rng.integers(0, 60, 4000)
    score = (qid * 60 + cid) % 17 / 4.0
    got = neighbours.best_held([(qid[a::3], cid[a::3], cid[a::3], cid[a::3] == 1, score[a::3]) for a in range(3)], 21)
    for q in range(9):
        want = sorted({(-s, c) for s, c, k in zip(score.tolist(), cid.tolist(), qid.tolist(), strict=True) if k == q})[:21]
        assert [(-s, c) for s, c, k in zip(got[4].tolist(), got[1].tolist(), got[0].tolist(), strict=True) if k == q] == want


def test_groups_span_batches():
    rows = [(1, 1), (1, 1), (1, 2), (2, 2), (2, 2), (2, 2), (3, 0)]
    cuts = [rows[:1], [], rows[1:5], rows[5:]]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in c], pa.int64()) for k in (0, 1)], ["a", "b"]) for c in cuts]
    assert [[tuple(r.values()) for r in t.to_pylist()] for t in neighbours.groups(iter(batches), ("a", "b"))] == [rows[:2], rows[2:3], rows[3:6], rows[6:]]


def test_turns_keep_lengths_and_probes_begin_at_home():
    x = np.random.default_rng(11).standard_normal((50, 48))
    assert np.allclose(np.linalg.norm(neighbours.turned(x, 0, 1), axis=1), np.linalg.norm(x, axis=1))
    w = neighbours.widths(10**6, 48)
    lists = neighbours.probes(neighbours.unit(x), 2, w, 40)
    assert (lists[:, 0] == neighbours.probes(neighbours.unit(x), 2, w, 1)[:, 0]).all()
    assert all(len(set(row)) == 40 and max(row) < neighbours.buckets(w) for row in lists.tolist())

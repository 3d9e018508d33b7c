import zlib

import numpy as np
from pyspark.sql import functions as F

from sonorant.llm import components, embeddings, jaccard, resharding
from sonorant.llm.common import new_folder


def joined(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(k, k + 1) for k in range(50)] + [(1000, 1000 + k) for k in range(40)] + [tuple(map(int, p)) for p in rng.integers(2000, 2100, (60, 2))] + [(7, 7)]
    want = joined(pairs, {n for p in pairs for n in p})
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (want[a] == want[b])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_jaccard(rows):
    sets = {k: shingle_set(t) for k, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, joined(pairs, sets)


def variants(seed, groups, copies, words=60, vocabulary=400, shared=0):
    """Groups of edited copies, some below the threshold; texts share a passage of `shared` words."""
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(shared)]
    out = []
    for g in range(groups):
        base = [f"v{x}" for x in rng.integers(0, vocabulary, words)] + passage
        for c in range(copies):
            w = list(base)
            for at in rng.integers(0, len(w), c % 5):
                w[at] = f"e{g}x{c}"
            if c % 3 == 0:
                w = w[: len(w) - int(rng.integers(0, 10))]
            out.append(" ".join(w))
    return out


def test_jaccard_against_brute_force(spark, monkeypatch):
    texts = variants(1, 12, 12) + variants(2, 30, 2, shared=40) + variants(3, 1, 60) + ["a b c", "A  B c", "a b", "", None, "  "]
    rows = list(enumerate(texts))
    sets, want = brute_jaccard(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    assert got == {k: (len(sets[k]), want[k]) for k, _ in rows}
    kept = {r.doc_id for r in jaccard.deduplicated(docs).collect()}
    assert kept == {k for k, _ in rows if want[k] == k}


def test_jaccard_edge_cases(edge, empty):
    out = jaccard.join(edge)
    assert out.count() == edge.count()
    by = {r.doc_id: r.component_id for r in out.collect() if r.doc_id is not None}
    assert by[5] == by[6] == by[7] == 5 and by[0] == 0 and by[1] == 1
    assert jaccard.join(empty).count() == 0
    assert jaccard.deduplicated(edge).columns == edge.columns
    assert jaccard.deduplicated(edge).where("doc_id = 5").count() == 1


def test_filters_never_drop_a_link():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(5, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.93], rng.integers(0, 2**63, 3).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        assert both >= jaccard.needed(len(a), len(b))
        pa, pb = (s[: len(s) + (-75 * len(s) // 100) + 1] for s in (a, b))
        first = np.intersect1d(pa, pb)
        assert len(first)
        x, y = int(np.searchsorted(a, first[0])), int(np.searchsorted(b, first[0]))
        assert jaccard.pass_filters(np.array([len(a)]), np.array([x]), np.array([len(b)]), np.array([y]))[0]
        assert jaccard.apart(jaccard.shape(a), jaccard.shape(b)) <= len(a) + len(b) - 2 * both


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((20, 64))
    x = np.concatenate([rng.standard_normal((300, 64)), *(c + s * rng.standard_normal((8, 64)) for c in centers for s in (0.15, 0.3))])
    x = np.concatenate([x, x[:5], x[:5] * 3])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    n = len(rows)
    bad = [None, [], [0.0] * 64, [float("nan")] * 64, [None] * 64, [float("inf")] + [0.0] * 63]
    rows += [(n + k, v) for k, v in enumerate(bad)]
    out = {r.vec_id: r for r in embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.9) & ~np.eye(n, dtype=bool)
    found = sum(out[k].n_links for k in range(n))
    assert len(out) == len(rows) and found <= near.sum() and found >= 0.99 * near.sum()
    assert all(out[k].n_links <= near[k].sum() for k in range(n))
    assert all(out[n + k].n_links == 0 and out[n + k].component_id == n + k for k in range(len(bad)))
    assert embeddings.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_edge_cases(spark):
    v = [1.0, 0.5] * 8
    near = [*v[:-1], 0.51]
    rows = [(1, v), (1, v), (2, near), (3, None), (4, [0.0] * 16), (5, [float("nan"), *v[1:]]), (6, [None, *v[1:]]), (7, v[:8]), (None, v), (8, []), (9, [float("inf"), *v[1:]]), (10, [-x for x in v])]
    schema = "vec_id long, embedding array<double>, cid string, w string, cap string, key string, component_id string"
    out = embeddings.link(spark.createDataFrame([(*r, *"abcde") for r in rows], schema))
    assert out.columns == ["vec_id", "n_links", "component_id"]
    alone = [(k, 0, k) for k in (3, 4, 5, 6, 7, 8, 9, 10)]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (None, 3, 1), *alone], key=str)
    assert embeddings.link(spark.createDataFrame([], schema)).count() == 0


def test_list_decoding_is_complete():
    rng = np.random.default_rng(4)
    x = embeddings.unit(rng.standard_normal((50, 64)))
    row, cap = embeddings.caps(x)
    a, b = embeddings.codes(64)
    sums = ((x[:, :32] @ a)[:, :, None] + (x[:, 32:] @ b)[:, None, :]).reshape(50, -1)
    least = np.minimum(3 / 8 * np.sqrt(2), -np.sort(-sums, 1)[:, embeddings.FEWEST - 1])
    want = np.nonzero(sums >= least[:, None] - 1e-12)
    assert (row == want[0]).all() and (cap == want[1]).all()


def near_pairs(n, cosine, seed=8, d=64):
    rng = np.random.default_rng(seed)
    x = embeddings.unit(rng.standard_normal((n, d)))
    z = rng.standard_normal((n, d))
    z = embeddings.unit(z - (z * x).sum(1, keepdims=True) * x)
    return x, cosine * x + np.sqrt(1 - cosine**2) * z


def test_caps_of_more_vectors_are_higher_and_keep_recall():
    met, sizes = [], [embeddings.code_size(n) for n in (2_000, 32_000, 1_000_000)]
    assert sizes[0] == embeddings.SIZE < sizes[1] < sizes[2]
    for size in sizes:
        x, y = near_pairs(1000, 0.9)
        (r, c), (s, e) = embeddings.caps(x, size), embeddings.caps(y, size)
        shared = np.intersect1d(r * size**2 + c, s * size**2 + e) // size**2
        assert len(np.unique(shared)) >= 990
        m = np.bincount(c, minlength=size**2).astype(float)
        met.append((m * (m - 1)).sum() / (1000 * 999))
    # Pairs compared: the share of all pairs times their number. 16 and 31 times the vectors, less than the power 1.65 of that.
    assert met[1] / met[0] * 16**2 < 16**1.65 and met[2] / met[1] * 31.25**2 < 31.25**1.6


def test_tiles_over_batches_of_any_size(spark):
    x, y = near_pairs(60, 0.93)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, y, y[:5] * 3]))]
    v = embeddings.unit(np.array([r[1] for r in rows]))
    near = v @ v.T >= embeddings.COSINE
    np.fill_diagonal(near, False)
    root = joined([p for p in np.argwhere(near).tolist()], range(len(rows)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {k: (int(near[k].sum()), root[k]) for k in range(len(rows))}


def test_vectors_keep_their_double_values():
    x = np.array([[0.1, 2.0], [0.5, 1e300], [0.25, -3.0]])
    raw = embeddings.packed(x)
    assert [len(r) for r in raw] == [16, 16, 8] and (np.stack([embeddings.unpacked(r, 2) for r in raw]) == x).all()


def test_least_moves():
    rng = np.random.default_rng(6)
    for _ in range(20):
        supply = rng.integers(0, 50, 5).tolist()
        demand = rng.multinomial(sum(supply), [0.125] * 8).tolist()
        flow = resharding.least_moves(supply, demand)
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(5)] == supply
        assert [sum(v for (_, j), v in flow.items() if j == k) for k in range(8)] == demand
        assert sum(v for (i, j), v in flow.items() if i == j) == sum(map(min, supply, demand))


def test_least_moves_with_costs():
    cost = {(0, 0): 1, (0, 1): 9, (1, 0): 2, (1, 1): 3}
    assert resharding.least_moves([5, 5], [5, 5], lambda i, j: cost[i, j]) == {(0, 0): 5, (1, 1): 5}
    assert resharding.least_moves([5, 5], [5, 5], lambda i, j: {(0, 0): 4, (0, 1): 1, (1, 0): 1, (1, 1): 4}[i, j]) == {(0, 1): 5, (1, 0): 5}


def test_reshard(spark, edge, empty):
    rows = [(k, "x" * (k * 37 % 900)) for k in range(3000)]
    out = resharding.reshard(spark.createDataFrame(rows, "doc_id long, text string"), new_folder(spark, "shards"), 7, 4, 64)
    by = out.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("d")).collect()
    assert len(by) == 7 and sum(r.n for r in by) == 3000
    assert all(r.lo == 0 and r.hi == r.n - 1 and r.d == r.n for r in by)
    assert max(r.b for r in by) - min(r.b for r in by) < 1000
    assert sorted((r.doc_id, r.text) for r in out.collect()) == rows
    held = resharding.reshard(edge, new_folder(spark, "shards"))
    assert held.count() == edge.count() and {"lang", "source", "n_chars"} <= set(held.columns)
    assert resharding.reshard(empty, new_folder(spark, "shards")).count() == 0


def layout(out, docs):
    """Every row once, slots gapless, sizes near equal; the bytes that moved."""
    got = out.collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.old_shard) for r in got))) == sorted(map(str, ((r.doc_id, r.text, r.old_shard) for r in docs.collect())))
    slots, held = {}, {}
    for r in got:
        assert r["size"] == len((r.text or "").encode()) + 16
        slots.setdefault(r.shard, []).append(r.slot)
        held[r.shard] = held.get(r.shard, 0) + r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return held, sum(r["size"] for r in got if r.shard != r.old_shard)


def test_unchanged_shards_are_kept_and_not_written(spark, tmp_path):
    rows = [(k, "x" * 84, k % 4) for k in range(4000)]
    rows += [(k, "x" * 84, 4) for k in range(4000, 4200)] + [(k, "x" * 84, 5) for k in range(4200, 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, old_shard int")
    out = resharding.reshard(docs, f"file://{tmp_path}/out", 6, blocks=64)
    held, _ = layout(out, docs)
    assert out.count() == 6000 and len(held) == 6 and max(held.values()) - min(held.values()) < 20_000
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"shard=4", "shard=5"}


def test_reshard_nulls_and_clashing_names(spark, edge, tmp_path):
    clash = edge.withColumns({c: F.lit(1) for c in ("first", "sub", "block", "slot", "r_old", "r_first", "old_shard", "bytes")}).withColumn("old_shard", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("int") % 3))
    out = resharding.reshard(clash, f"file://{tmp_path}/out", 4, blocks=8)
    held, _ = layout(out, clash)
    assert {"first", "sub", "block", "r_old", "bytes"} <= set(out.columns) and set(held) <= {0, 1, 2, 3}


def test_moved_bytes_are_near_the_flow():
    rng = np.random.default_rng(8)
    for spread in (0.0, 1.0):
        blocks = {(i, k): int(1e6 * rng.lognormal(0, spread)) + 1 for i in range(32) for k in range(256)}
        supply = [sum(b for (i, _), b in blocks.items() if i == n) for n in range(32)]
        total = sum(supply)
        demand = [total * (j + 1) // 40 - total * j // 40 for j in range(40)]
        flow = resharding.least_moves(supply, demand)
        to = resharding.deal(blocks, flow, 40)
        moved, least = sum(blocks[x] for x, j in to.items() if x[0] != j), sum(v for (i, j), v in flow.items() if i != j)
        assert moved <= 1.02 * least
        held = [sum(blocks[x] for x, j in to.items() if j == n) for n in range(40)]
        assert max(held) - min(held) < 0.02 * total / 40


def test_query_against_plain_layout(spark, edge, tmp_path):
    edge.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    docs = edge.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(resharding.OLD_SHARDS)).alias("i"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(resharding.BLOCKS)).alias("b")).collect()
    size = lambda r: len((r.text or "").encode()) + 16
    blocks, members = {}, {}
    for r in docs:
        blocks[r.i, r.b] = blocks.get((r.i, r.b), 0) + size(r)
        members.setdefault((r.i, r.b), []).append(r)
    supply = [sum(v for (i, _), v in blocks.items() if i == n) for n in range(max(i for i, _ in blocks) + 1)]
    total = sum(supply)
    to = resharding.deal(blocks, resharding.least_moves(supply, [total * (j + 1) // 40 - total * j // 40 for j in range(40)]), 40)
    want, used = [], {}
    for key in sorted(to):
        for r in sorted(members[key], key=lambda r: (r.doc_id is not None, r.doc_id or 0, size(r))):
            want.append((r.doc_id, size(r), zlib.crc32((r.text or "").encode()), "bytes", to[key], used.setdefault(to[key], 0), None))
            used[to[key]] += 1
    names = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert sorted(map(str, (tuple(r[n] for n in names) for r in resharding.op9_resharding(spark, str(tmp_path)).collect()))) == sorted(map(str, want))

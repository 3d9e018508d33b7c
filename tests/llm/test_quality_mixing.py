import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sonorant.llm import mixing, quality


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    cover = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_measures_against_plain(spark, edge):
    extra = [(100, "a b c a b c d\na b\na b\n\n", None), (101, "x y " * 300, None), (102, " ".join(f"p{i % 97} q{i % 89}" for i in range(4000)), None)]
    docs = edge.select("doc_id", "text", "n").union(spark.createDataFrame(extra, "doc_id long, text string, n string"))
    for r in quality.judge(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_keep_returns_the_columns_it_got(edge, empty):
    kept = quality.keep(edge)
    assert kept.columns == edge.columns
    assert {r.doc_id for r in kept.collect()} >= {5, 6, 7, 8, 9, 10}
    assert quality.judge(empty).count() == 0


def test_targets_cap_and_reshare():
    s = mixing.Source
    assert mixing.targets([s("a", 600, 1), s("b", 0, 1)]) == [600.0, 0.0]
    out = mixing.targets([s("a", 1000, 1), s("b", 10, 1), s("c", 1000, 1)])
    assert out[1] == 30 and abs(sum(out) - 2010) < 1e-6 and abs(out[2] / out[0] - 3) < 1e-9
    assert mixing.targets([]) == []


def test_splitting_tree_is_exact():
    quotas = np.array([100, 7, 0, 53])
    out = mixing.split(quotas, 8, np.random.default_rng(1))
    assert (out.sum(0) == quotas).all() and (out >= 0).all() and np.ptp(out.sum(1)) <= 1


def test_large_quotas_are_dealt_draw_by_draw():
    quotas = np.array([4 * 10**10 + 7, 3, 10**12, 0])
    cuts = mixing.cuts_of(quotas, 8, np.random.default_rng(1))
    assert (cuts[-1] == quotas).all() and (np.diff(cuts, axis=0) >= 0).all()
    share = np.diff(np.vstack([np.zeros(4, np.int64), cuts]), axis=0).sum(1)
    assert np.ptp(share) <= 1
    assert mixing.cuts_of(np.array([9, 4]), 2, np.random.default_rng(1))[-1].tolist() == [9, 4]


def test_draws_follow_the_law():
    from math import comb

    rng = np.random.default_rng(3)
    for good, bad, n in ((7, 5, 6), (1, 30, 4), (20, 3, 21), (4, 0, 2), (5, 9, 14)):
        got = Counter(mixing.hypergeometric(good, bad, n, rng) for _ in range(20_000))
        want = {k: comb(good, k) * comb(bad, n - k) / comb(good + bad, n) for k in range(max(0, n - bad), min(good, n) + 1)}
        assert set(got) <= set(want) and all(abs(got[k] / 20_000 - p) < 0.015 for k, p in want.items())
    good, bad, n = 10**11, 3 * 10**11, 10**11
    z = np.array([mixing.hypergeometric(good, bad, n, rng) - n / 4 for _ in range(200)]) / (n * 0.25 * 0.75 * 0.75) ** 0.5
    assert abs(z.mean()) < 0.3 and 0.8 < z.std() < 1.2 and len({round(x, 9) for x in z}) == 200


def test_permutations_of_large_sources_stay_within_a_long():
    row = mixing.plan([mixing.Source("a", 10**13, 10**9)], 256, 4, 1, 3)[0]
    n, a, c = row[3], row[6], row[7]
    assert n > 3.04e9 and all(x * (n - 1) + y < 2**63 for x, y in zip(a, c, strict=True))


def by_words(docs, block, shards, seed):
    """The mix word by word: (taken of each row, words of each shard and row)."""
    sources = sorted({d["source"] for d in docs}, key=lambda s: (s is None, s or ""))
    own = [[d for d in docs if d["source"] == s] for s in sources]
    plan = mixing.plan([mixing.Source(s, sum(d["size"] for d in x), len(x)) for s, x in zip(sources, own, strict=True)], block, shards, seed, 3)
    taken, dealt = Counter(), Counter()
    for x, (_, words, target, n, full, part, a, c, cuts) in zip(own, plan, strict=True):
        buckets = len(x) // mixing.BUCKET + 1
        stream = [d["k"] for d in sorted(x, key=lambda d: (d["key"] % buckets, d["key"], d["doc_id"] is not None, d["doc_id"] or 0, d["size"])) for _ in range(d["size"])]
        assert len(stream) == words and abs(full * words + part - target) <= 0.5
        for epoch in range(full + 1):
            left = words if epoch < full else part
            for rank, b in sorted(((a[epoch] * b + c[epoch]) % n, b) for b in range(n)):
                got = stream[b * block : (b + 1) * block][:left]
                left -= len(got)
                taken.update(got)
                dealt.update((sum(cut <= epoch * n + rank for cut in cuts), k) for k in got)
    return taken, dealt


def test_query_against_brute_force(spark, edge, tmp_path):
    more = [(100 + k, " ".join(["w"] * (k * 37 % 211)), f"src{k * k % 5}") for k in range(300)]
    docs = edge.select("doc_id", "text", "source").union(spark.createDataFrame(more, "doc_id long, text string, source string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    keyed = docs.select("doc_id", "source", F.xxhash64("doc_id", F.lit(mixing.SEED)).alias("key"), "text").collect()
    rows = [{"k": k, "doc_id": r.doc_id, "source": r.source, "key": r.key, "size": plain(r.text)[0]} for k, r in enumerate(keyed)]
    taken, dealt = by_words(rows, mixing.BLOCK_WORDS, mixing.SHARDS, mixing.SEED)
    shards = {}
    for shard, k in dealt:
        shards.setdefault(k, set()).add(shard)
    shown = lambda x: sorted(x, key=str)
    want = shown((r["doc_id"], r["size"], taken[r["k"]], ",".join(map(str, sorted(shards.get(r["k"], ()))))) for r in rows)
    out = mixing.op7_mixing(spark, str(tmp_path)).collect()
    assert shown((r.doc_id, r["size"], r.taken, r.shards or "") for r in out) == want


def test_shards_are_whole_and_shuffled(spark, tmp_path):
    docs = spark.createDataFrame([(k, " ".join(["w"] * 40), f"s{k % 3}") for k in range(2000)], "doc_id long, text string, source string")
    mix = mixing.mix(mixing.with_sizes(docs), block=16, shards=4)
    out = mixing.write_shards(mix, f"file://{tmp_path}/shards")
    want = sorted(map(str, mix.where("row IS NOT NULL").select("row", F.explode("draws").alias("d")).select("row", "d.*").select(*sorted(out.columns)).collect()))
    assert sorted(map(str, out.select(*sorted(out.columns)).collect())) == want
    held = {r.shard: r.n for r in out.groupBy("shard").agg(F.count_distinct("row.k", "epoch", "block").alias("n")).collect()}
    assert len(held) == 4 and max(held.values()) - min(held.values()) <= 3
    sources = [r.k for r in out.where("shard = 0").select("row.k").limit(300).collect()]
    assert 60 < sum(a != b for a, b in zip(sources, sources[1:], strict=False))  # not source by source


def test_mix_takes_its_targets_and_bounds(spark, edge, empty):
    out = mixing.mix(mixing.with_sizes(edge), block=16, shards=5).collect()
    assert len(out) == edge.count()
    by = {}
    for r in out:
        got = sum(d["words"] for d in r.draws)
        assert got <= 3 * r["size"] and all(0 <= d["first"] and d["first"] + d["words"] <= r["size"] and 0 <= d["shard"] < 5 for d in r.draws)
        t = by.setdefault(r.source, [r.target, 0, r.source_size, 0])
        t[1] += got
        t[3] += r["size"]
    for target, got, size, own in by.values():
        assert abs(target - got) <= 1 and size == own
    again = mixing.mix(mixing.with_sizes(edge.repartition(2)), block=16, shards=5)
    assert sorted(map(str, again.collect())) == sorted(map(str, out))
    assert mixing.mix(mixing.with_sizes(empty)).count() == 0
    assert mixing.mixed(edge).columns == edge.columns
    clash = edge.withColumns({c: F.lit(1) for c in ("p_k", "p_n", "b_n", "s_start", "p_at", "row", "draws", "whole")})
    assert mixing.mixed(clash).columns == clash.columns and mixing.mix(mixing.with_sizes(clash)).count() == edge.count()

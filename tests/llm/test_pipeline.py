import re
import zlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sonorant.llm import mixing, pii, quality  # noqa: E402
from tests.llm.test_links_shards import shingle_set  # noqa: E402
from tests.llm.test_quality_mixing import plain  # noqa: E402
from tests.llm.test_tokens_packing import plain_ids  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain_keep(text):
    n, chars, symbols, lines, repeats = plain(text)
    if n < 50 or 100 * repeats > 50 * n:
        return False
    stop = sum(w in quality.STOP_WORDS for w in re.findall(r"[^\x20\x09-\x0D]+", text)) / n
    held = len([x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")])
    return 1.5 <= chars / n <= 15 and symbols / n <= 0.2 and stop >= 0.01 and lines / max(held, 1) <= 0.5


def plain_first_of_groups(docs):
    """The smallest id of each group of alike texts; candidates share a shingle."""
    sets = {k: shingle_set(t) for k, t in docs.items()}
    root = {k: k for k in docs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    shared = {}
    for k, s in sets.items():
        for g in s:
            shared.setdefault(g, []).append(k)
    for a, b in {(x, y) for ks in shared.values() for x in ks for y in ks if x < y}:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k for k in docs if find(k) == k}


def plain_mask(text, model):
    out, at = "", 0
    for s in pii.find_all([text], model)[0]:
        if s["start"] >= at:
            out += text[at : s["start"]] + f"[{s['kind'].upper()}]"
        at = max(at, s["stop"])
    return out + text[at:]


def test_rows_equal_a_plain_run(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {k: r.text for k, r in docs.items() if plain_keep(r.text)}
    kept = {k: kept[k] for k in plain_first_of_groups(kept)}
    model = pii.trained()
    masked = {k: plain_mask(t, model) for k, t in kept.items()}
    rows = corpus_pipeline.run(spark, SF).collect()
    # The mix draws documents by a hash order, whose plain version is its own contract: counts by source, and whole copies.
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) <= set(masked)
    ids = dict(zip(masked, plain_ids(list(masked.values())), strict=True))
    copies = {}
    for k, pieces in got.items():
        starts = Counter(p.start for p in pieces)
        copies[k] = starts[0]
        assert 1 <= starts[0] <= 3
        assert sum(p.length for p in pieces) == starts[0] * len(ids[k])
        for p in pieces:
            assert p.doc_tokens == len(ids[k]) and p.ids_crc32 == zlib.crc32(ids[k][p.start : p.start + p.length].tobytes())
    sizes = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in masked.items()}
    by_source = {}
    for k in masked:
        s = by_source.setdefault(docs[k].source, [0, 0, 0])
        s[0] += sizes[k]
        s[1] += copies.get(k, 0) * sizes[k]
        s[2] = max(s[2], sizes[k])
    want = mixing.targets([mixing.Source(s, by_source[s][0], 0) for s in sorted(by_source)])
    for s, target in zip(sorted(by_source), want, strict=True):
        # A document comes whole with the block of its first word: few documents, wide bounds.
        assert abs(by_source[s][1] - target) <= max(4 * by_source[s][2], 0.5 * target)
    assert abs(sum(v[1] for v in by_source.values()) / sum(want) - 1) < 0.25
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        ends = np.cumsum([n for _, n in sorted(w)])
        assert [o for o, _ in sorted(w)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096


def test_stages_return_document_columns(spark, edge, empty):
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    none = empty.select(*docs.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert docs.count() > 0
        assert stage(spark, none, SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0

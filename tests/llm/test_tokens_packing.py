import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sonorant.llm import packing, tokens
from sonorant.llm.common import new_folder


def plain_ids(texts):
    tok = Tokenizer.from_file(tokens.vocabulary_path())
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]


def test_encoder_equals_the_tokenizer():
    encode = tokens.Encoder(tokens.vocabulary_path())
    odd = ["It's  The\tEnd\n\nof.. it", "É́H̱ Straße x y", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "İstanbul ΣΑΣ", "\x1c\x85 a\x0bb", "漢字 テスト 123,456.78", " ", "'S 'LL don'T"]
    odd += [None, "", "Word. (word), WORD!? x.y. foo-. it's. a.'s end:; 5. 12) é. É! ß, .,. ... J\u030c. J\u030c <|a. ª. ²! ⅷ."]
    rng = np.random.default_rng(3)
    pool = ["Haus", "haus", "É", "e", "\u0301", ".", ",", ")", "'s", "'", "<|", "|>", "endoftext", "1", "漢", " ", " ", "\n", "\t", "-", "ı", "İ", "K", "Σ"]
    odd += ["".join(rng.choice(pool, rng.integers(1, 30))) for _ in range(3000)]
    odd += ["".join(map(chr, range(k, k + 8))) for k in range(0x21, 0x300, 8)] + [f"a{chr(k)}b {chr(k)}" for k in range(0x21, 0x590)]
    want = [x[:-1].tobytes() for x in plain_ids(odd)]
    for kept, size in ((500_000, 8 << 20), (50, 200)):  # known words must be forgotten and slices cut without effect
        encode.KEPT = kept
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(tokens, "SLICE", size)
            assert list(encode(pa.array(odd))) == want == [x for k in (0, 5) for x in encode(pa.array(odd)[k : 5 if k == 0 else None])]
    assert list(encode(pa.array([], pa.string()))) == []


def test_files_round_trip(spark, edge, empty):
    folder = new_folder(spark, "ids")
    manifest = tokens.write_ids(edge, folder)
    got = tokens.read_ids(spark, folder, manifest).collect()
    rows = edge.select("doc_id", "text").collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, len(x), zlib.crc32(x.tobytes())) for r, x in zip(rows, plain_ids([r.text for r in rows]), strict=True))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert tokens.read_ids(spark, f"{folder}-e", tokens.write_ids(empty, f"{folder}-e")).count() == 0


def test_one_document_of_a_file(spark, edge):
    folder = new_folder(spark, "ids")
    names = [r.name for r in tokens.write_ids(edge, folder).collect()]
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first().dictionary)
    files = [open(f"{folder.removeprefix('file://')}/files/{n}", "rb").read() for n in names]
    found = [x for f in files if (x := tokens.read_document(f, dictionary, 9)) is not None]
    text = [r.text for r in edge.where("doc_id = 9").collect()][0]
    assert (found[0] == plain_ids([text])[0]).all()


def check_pack(rows, texts, sequence):
    ids = {k: plain_ids([t])[0] for k, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for k, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[k])
            assert p.ids_crc32 == zlib.crc32(ids[k][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[k])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= sequence
    return 1 - sum(map(len, ids.values())) / (sequence * len(by_sequence))


def test_packing_is_whole(spark, edge, empty):
    docs = edge.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_pack(packing.pack(docs, sequence=256, n_open=4).collect(), texts, 256)
    assert packing.pack(edge).count() >= edge.count()
    assert packing.pack(empty).count() == 0


def test_little_padding_and_bounded_windows():
    rng = np.random.default_rng(3)
    pieces = [packing.Piece(k, 0, n, b"\0" * 4 * n) for k, n in enumerate(rng.integers(1, 1200, 4000).tolist())]
    windows = list(packing.place(iter(pieces)))
    assert sum(not full for full, _ in windows) <= packing.OPEN
    assert sorted(p.doc_id for _, w in windows for p in w) == list(range(4000))
    used = [sum(p.length for p in w) for full, w in windows if full]
    assert max(used) <= 4096 and np.mean(used) > 0.97 * 4096

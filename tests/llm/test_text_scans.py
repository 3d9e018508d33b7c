import hashlib
import itertools
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonorant.llm import licenses, pii, secrets, tagger
from sonorant.llm.common import new_folder


def luhn(x):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(x))) % 10 == 0


def digits(x):
    return re.sub("[^0-9]", "", x)


PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def plain_pii(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PLAIN) for m in re.finditer(p, text) if ok(m[0]))


def test_base_patterns_against_plain_ones():
    rng = np.random.default_rng(2)
    pool = list("0123456789") + list("0041.. @@+--()abZ_%\n") + ["a@b.co", "10.0.0.1", "4111 1111 1111 1111", "+49 151 1234567"]
    for _ in range(3000):
        t = "".join(rng.choice(pool, rng.integers(1, 40)))
        assert pii.base_spans(t) == plain_pii(t), t


def test_long_runs_are_linear():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+" * 100_000, "a@" * 100_000, "+1" + " " * 200_000):
        pii.base_spans(t)


@pytest.fixture(scope="module")
def model():
    return pii.trained()


def test_gradient_is_the_slope():
    m = tagger.Tagger()
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    texts, spans = pii.labelled(2, 3)
    x, y = np.stack([tagger.encode(t) for t in texts]), np.stack([pii.tags_of(s, pii.LENGTH) for s in spans]).astype(int)
    _, grad = m.loss_and_gradient(x, y)
    for k in m.w:
        at = (x[0, 5], 1) if k == "E" else tuple(np.argwhere(np.abs(grad[k]) == np.abs(grad[k]).max())[0])
        held, h = m.w[k][at], 1e-3
        m.w[k][at] = held + h
        up = m.loss_and_gradient(x, y)[0]
        m.w[k][at] = held - h
        down = m.loss_and_gradient(x, y)[0]
        m.w[k][at] = held
        assert abs((up - down) / (2 * h) - grad[k][at]) < 1e-3 + 0.02 * abs(grad[k][at]), k


def test_held_out_accuracy(model):
    texts, spans = pii.labelled(500, 99)
    tags, _ = model.decode(np.stack([tagger.encode(t) for t in texts]))
    gold = np.stack([pii.tags_of(s, pii.LENGTH) for s in spans])
    assert (tags == gold).mean() > 0.93
    assert (tags == gold)[gold > 0].mean() > 0.75


def test_windows_cover_long_texts(model):
    filler = "the quick brown fox " * 200
    text = filler + "call (415) 555-0132 today " + filler
    found = pii.find_all([text], model)[0]
    assert [(s["kind"], s["start"], s["stop"]) for s in found] == [("phone", len(filler) + 5, len(filler) + 19)]
    assert pii.find_all([filler, None, ""], model) == [[], [], []]


def test_reconcile_takes_the_heaviest_choice():
    rng = np.random.default_rng(7)
    for _ in range(200):
        spans = {(a := int(rng.integers(0, 20)), int(rng.integers(4)), a + int(rng.integers(1, 8))): float(rng.integers(1, 9)) for _ in range(8)}
        got = pii.reconcile(spans)
        assert all(x[2] <= y[0] for x, y in zip(got, got[1:], strict=False))
        best = max(sum(spans[s] for s in pick) for n in range(4 + 1) for pick in itertools.combinations(spans, n) if all(x[2] <= y[0] or y[2] <= x[0] for x, y in itertools.combinations(pick, 2)))
        assert sum(spans[s] for s in got) >= best


def test_implausible_spans_displace_nothing():
    text = "call 415-555-0132 now please"
    assert pii.added(text, {(5, 3, 17): 1.0, (0, 2, 28): 50.0, (3, 0, 17): 9.0}, []) == [(5, 3, 17)]
    assert pii.added(text, {(5, 3, 17): 1.0}, [(16, 1, 20)]) == []


def test_many_spans_in_one_text_are_fast():
    text = "415-555-0132 " * 16_000
    found = {(13 * k, 3, 13 * k + 12): 1.0 for k in range(16_000)}
    began = time.process_time()
    assert len(pii.added(text, found, [])) == 16_000 and len(pii.added(text, found, sorted(found))) == 0
    assert time.process_time() - began < 4


def test_weights_are_stored(spark, model):
    again, third = pii.stored(spark), pii.stored(spark)
    assert all((again.w[k] == model.w[k]).all() and (third.w[k] == model.w[k]).all() for k in model.w)


def test_windows_without_a_digit_or_at_hold_nothing(spark, model):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text][:60]
    want = [pii.tagged_spans([t], model)[0] for t in texts]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pii, "ANCHOR", re.compile(".", re.S))
        all_ = [pii.tagged_spans([t], model)[0] for t in texts]
    for t, a, b in zip(texts, want, all_, strict=True):
        base = pii.base_spans(t)
        assert pii.added(t, a, base) == pii.added(t, b, base)


def test_find_and_mask(edge, empty, model):
    for r in pii.find(edge, model).collect():
        base = [(s.start, s.kind, s.stop) for s in r.pii if s.base]
        assert base == [(a, PLAIN[k][0], b) for a, k, b in plain_pii(r.text or "")]
    masked = {r.doc_id: r.text for r in pii.masked(edge, model).collect()}
    assert "[EMAIL]" in masked[9] and "[PHONE]" in masked[9] and masked[0] is None
    assert pii.find(empty, model).count() == 0


SECRETS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def plain_secrets(text):
    s = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(SECRETS) for m in p.finditer(text) if ok(m))
    return ",".join(f"{SECRETS[k][0]}:{a}:{b}" for a, k, b in s)


def test_secret_spans_and_ledger(spark, edge, empty):
    rng = np.random.default_rng(4)
    pool = ["token", "=", ": ", "'", "secret", "API_KEY", "apikey", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "😀", " ", "x", "abcdefghi", "\n"]
    rows = [(1000 + k, "".join(rng.choice(pool, rng.integers(1, 25)))) for k in range(400)]
    docs = edge.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    ledger = new_folder(spark, "ledger")
    shown = lambda df: sorted((r.doc_id is not None, r.doc_id or 0, ",".join(f"{x.kind}:{x.start}:{x.stop}" for x in r.findings if x.kind in ("assign", "access", "hex"))) for r in df.collect())
    want = sorted((r.doc_id is not None, r.doc_id or 0, plain_secrets(r.text or "")) for r in docs.collect())
    assert shown(secrets.scan(docs, ledger)) == want
    blobs = spark.read.parquet(ledger)
    assert blobs.count() == blobs.select("blob").distinct().count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert shown(secrets.scan(docs, ledger)) == want and spark.read.parquet(ledger).count() == blobs.count()  # nothing is scanned twice
    newer = (*secrets.RULES[:2], secrets.RULES[2]._replace(version=2))
    secrets.scan(docs, ledger, newer).count()
    assert [list(r.scanned) for r in spark.read.parquet(ledger).where("size(scanned) = 1").limit(1).collect()] == [["hex@2"]]
    assert secrets.scan(empty, new_folder(spark, "ledger")).count() == 0


def test_a_rule_changed_leaves_no_old_findings_and_no_text_is_scanned_twice(spark):
    docs = spark.createDataFrame([(k, f"x {'ab' * (12 + 8 * k)} token=abcdefgh{k % 4}") for k in range(12)], "doc_id long, text string")
    shown = lambda df: sorted((r.doc_id, [(x.kind, x.start, x.stop) for x in r.findings]) for r in df.collect())
    ledger = new_folder(spark, "ledger")
    assert any(x[0] == "hex" and x[2] - x[1] < 64 for _, f in shown(secrets.scan(docs, ledger)) for x in f)
    newer = (secrets.RULES[2]._replace(version=2, pattern="[0-9a-f]{64,}", least=64), *secrets.RULES[:2], *secrets.RULES[3:])
    both = shown(secrets.scan(docs, ledger, newer))
    assert all(x[0] != "hex" or x[2] - x[1] >= 64 for _, f in both for x in f)
    assert both == shown(secrets.scan(docs, new_folder(spark, "ledger"), newer))
    # Half of the paths first, then all: the same findings as at once, and a row for each blob.
    halves = new_folder(spark, "ledger")
    secrets.scan(docs.where("doc_id % 2 = 0"), halves, newer).count()
    assert shown(secrets.scan(docs, halves, newer)) == both and spark.read.parquet(halves).count() == 12
    assert shown(secrets.scan(docs, halves)) == shown(secrets.scan(docs, ledger))


def plain_license(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), sorted({label for _, label in places})


def test_license_phrases_and_templates(spark, edge, empty):
    mit = licenses.TEMPLATES["mit"]
    words = mit.split()
    damaged = " ".join(w for i, w in enumerate(words) if i % 23 != 11)
    rng = np.random.default_rng(5)
    pool = ["CC", "by", "General", "public", "LICENSE", "all", "rights", "reserved", "x", "é"]
    rows = [(2000 + k, "".join(x for w in rng.choice(pool, 30) for x in (w, rng.choice([" ", "-", ", ", "\n"])))) for k in range(100)]
    rows += [(3000, "intro " + mit + " outro"), (3001, damaged), (3002, "unrelated " * 50), (3003, " ".join(words[:12])), (3004, "\u212a all rights reserved, by th\u0130s \u212a")]
    docs = edge.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    out = licenses.scan(docs).collect()
    assert len(out) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(plain_license(r.text or ""))
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, list(r.base_labels)) in texts[r.doc_id]
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in out}
    assert by[3000].labels == ["mit"] and by[3000].score == 1.0 and by[3001].labels == ["mit"] and 0.5 <= by[3001].score < 1
    assert by[3002].labels == by[3003].labels == []
    assert by[3004].score == licenses.PHRASE_SCORE and by[3004].base_labels == ["reserved"]
    assert licenses.scan(empty).count() == 0


def test_base_hash_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_a_text_of_very_many_secrets_takes_time_by_its_matches(spark, tmp_path):
    import time

    from sonorant.llm import secrets

    took = []
    for n in (1000, 100_000):
        text = "é token=abcdefgh " * n
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        t = time.time()
        found = secrets.scan(docs, str(tmp_path / f"ledger-{n}")).first().findings
        took.append(time.time() - t)
        assert [(x.start, x.stop) for x in found] == [(2 + 17 * k, 16 + 17 * k) for k in range(n)]
    assert took[1] - took[0] < 20

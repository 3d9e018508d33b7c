"""Queries held, strings included, against plain versions of their contracts."""

import hashlib
import re

from sonorant.llm import secrets
from sonorant.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_secret_query_against_plain_scan(spark):
    base = [
        ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    ]
    more = [(r.kind, r.pattern, r.group, r.least) for r in secrets.RULES[3:]]
    want = {}
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        found = [(m.start(), k, m.end(), kind) for k, (kind, pattern, group, least) in enumerate(base + more) for m in re.finditer(pattern, text or "", re.ASCII) if len(m.group(group)) >= least]
        found.sort()
        listed = lambda rows: ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in rows)
        own = [f for f in found if f[1] < 3]
        counts = tuple(sum(f[3] == kind for f in own) for kind in ("assign", "access", "hex"))
        want[doc_id] = (*counts, hashlib.sha256(listed(own).encode()).hexdigest(), listed(found))
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in QUERIES["op3_secrets"](spark, SF).collect()}
    assert got == want
    assert sum(v[0] + v[1] + v[2] for v in want.values()) > 0

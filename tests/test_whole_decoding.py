import math

import numpy as np

from sonorant.queries import QUERIES


def plain(x, targets):
    """Best path of states (blank, target, blank, ...) over the frames, by plain recursion."""
    labels = [0]
    for t in targets:
        labels += [t, 0]
    best = {s: (x[0][labels[s]], [s]) for s in (0, 1)}
    for frame in x[1:]:
        new = {}
        for s in range(len(labels)):
            steps = [s, s - 1] + [s - 2] * (s > 2 and s % 2 == 1 and labels[s] != labels[s - 2])
            found = [best[q] for q in steps if q in best]
            if found:
                score, path = max(found, key=lambda f: f[0])
                new[s] = score + frame[labels[s]], [*path, s]
        best = new
    path = max((best[s] for s in (len(labels) - 1, len(labels) - 2) if s in best), key=lambda f: f[0])[1]
    return [(path.index(2 * k + 1), len(path) - 1 - path[::-1].index(2 * k + 1)) for k in range(len(targets))]


def test_all_of_a_decoding_is_aligned(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(k, [float(v) for v in rng.normal(size=64).astype(np.float32)]) for k in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want, longest = {}, 0
    for k, flat in rows:
        frames = [flat[i : i + 4] for i in range(0, 64, 4)]
        x = [[v - math.log(sum(map(math.exp, f))) for v in f] for f in frames]
        ids = [f.index(max(f)) for f in frames]
        targets = [v for i, v in enumerate(ids) if v and (i == 0 or ids[i - 1] != v)]
        longest = max(longest, len(targets))
        for place, (token, (a, b)) in enumerate(zip(targets, plain(x, targets), strict=True)):
            own = [x[f][token] for f in range(a, b + 1)]
            rival = [max((v, -t) for t, v in enumerate(x[f]) if t != token) for f in range(a, b + 1)]
            llr, f = max((o - r[0], -f) for f, (o, r) in enumerate(zip(own, rival, strict=True)))
            want[k, place] = token, a, b, round(sum(own) / len(own), 5), round(llr, 5), token if llr > 0 else -rival[-f][1]
    got = {(r.utt_id, r.place): (r.token, r["first"], r["last"], round(r.gop, 5), round(r.llr, 5), r.heard) for r in QUERIES["ctc_gop"](spark, str(tmp_path)).collect()}
    assert longest > 6 and got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=2e-5) for k in want)

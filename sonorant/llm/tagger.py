"""A character-level bidirectional LSTM with CRF transitions, in numpy: training from labelled spans, batched decoding."""

from __future__ import annotations

import numpy as np

#: Labelled kinds; a character's tag is 0 outside, 2k + 1 at the start of kind k and 2k + 2 inside it.
KINDS = ("email", "ip", "card", "phone")
TAGS = 2 * len(KINDS) + 1
HIDDEN, EMBED, SEED = 20, 12, 5

_PUNCT = "@.-+() _%/:,;'\"[]{}<>#*=&|$!?\\~^`\n\t"
CLASSES = 3 + 26 + len(_PUNCT)  # padding, digits, other letters; letters by value, either case; punctuation


def _table() -> np.ndarray:
    table = np.full(128, 2, np.int16)
    table[48:58] = 1
    for k in range(26):
        table[65 + k] = table[97 + k] = 3 + k
    for k, c in enumerate(_PUNCT):
        table[ord(c)] = 29 + k
    return table


TABLE = _table()


def encode(text: str) -> np.ndarray:
    """Character classes of a text, one for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, TABLE[np.minimum(points, 127)], 2).astype(np.int16)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def allowed() -> np.ndarray:
    """Penalties of tag pairs that no labelling has: inside a kind after anything but that kind."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        for before in range(TAGS):
            if before not in (2 * k + 1, 2 * k + 2):
                out[before, 2 * k + 2] = -30
    return out


class Tagger:
    """Weights: E embeds classes; W, U, b are the LSTM's, with the forward and the backward direction stacked first; O, ob give
    emissions; T the transitions."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = SEED):
        if weights is None:
            rng = np.random.default_rng(seed)
            init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
            weights = {"E": init(CLASSES, EMBED) * 4, "O": init(2 * HIDDEN, TAGS), "ob": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}
            weights |= {"W": init(2, EMBED, 4 * HIDDEN), "U": init(2, HIDDEN, 4 * HIDDEN), "b": np.zeros((2, 1, 4 * HIDDEN), np.float32)}
            weights["b"][:, :, HIDDEN : 2 * HIDDEN] = 1
        self.w = weights

    def _states(self, x: np.ndarray, keep: bool):
        """Hidden states (n, time, 2 * HIDDEN) of embedded x, with what training needs. Step k handles place k forward and the
        k-th place from the end backward."""
        n, t, _ = x.shape
        both = np.stack([x, x[:, ::-1]])
        pre = (both.reshape(2, n * t, EMBED) @ self.w["W"] + self.w["b"]).reshape(2, n, t, 4 * HIDDEN)
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        out, saved = np.empty((2, n, t, HIDDEN), np.float32), []
        for k in range(t):
            z = pre[:, :, k] + h @ self.w["U"]
            gates, g = sigmoid(z[..., : 3 * HIDDEN]), np.tanh(z[..., 3 * HIDDEN :])
            i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
            before = (h, c)
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, :, k] = h
            if keep:
                saved.append((i, f, o, g, tc, gates, *before))
        return np.concatenate([out[0], out[1, :, ::-1]], 2), saved

    def emissions(self, classes: np.ndarray) -> np.ndarray:
        """(n, time) classes -> (n, time, TAGS) scores. Padding is class 0 and scores as outside."""
        x = self.w["E"][classes]
        h, _ = self._states(x, False)
        e = h @ self.w["O"] + self.w["ob"]
        e[classes == 0, 1:] -= 30
        return e

    def decode(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags (n, time) by Viterbi, and for each place how much its tag's emission exceeds that of outside."""
        e = self.emissions(classes)
        trans = self.w["T"] + allowed()
        n, t, _ = e.shape
        score = e[:, 0] + allowed()[0]
        back = np.empty((n, t, TAGS), np.int8)
        for k in range(1, t):
            s = score[:, :, None] + trans
            back[:, k] = s.argmax(1)
            score = s.max(1) + e[:, k]
        tags = np.empty((n, t), np.int8)
        tags[:, -1] = score.argmax(1)
        rows = np.arange(n)
        for k in range(t - 1, 0, -1):
            tags[:, k - 1] = back[rows, k, tags[:, k]]
        margin = np.take_along_axis(e, tags[:, :, None].astype(np.int64), 2)[:, :, 0] - e[:, :, 0]
        return tags, margin

    def loss_and_gradient(self, classes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of a character under the CRF, and its gradient by forward-backward and
        back-propagation through time."""
        w, n, t = self.w, *classes.shape
        x = w["E"][classes]
        h, saved = self._states(x, True)
        e = h @ w["O"] + w["ob"]
        trans = w["T"] + allowed()
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + allowed()[0]
        for k in range(1, t):
            alpha[:, k] = logsum(alpha[:, k - 1, :, None] + trans, 1) + e[:, k]
        for k in range(t - 2, -1, -1):
            beta[:, k] = logsum(trans + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        total = logsum(alpha[:, -1], 1)
        rows, cols = np.arange(n)[:, None], np.arange(t)[None, :]
        gold = e[rows, cols, tags].sum(1) + trans[tags[:, :-1], tags[:, 1:]].sum(1) + allowed()[0][tags[:, 0]]
        scale = 1 / (n * t)
        de = np.exp(alpha + beta - total[:, None, None]) * scale
        de[rows, cols, tags] -= scale
        dt = np.zeros_like(w["T"])
        pairs = alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        dt += np.exp(pairs).sum((0, 1)) * scale
        np.add.at(dt, (tags[:, :-1], tags[:, 1:]), -scale)
        grad = {"O": h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), "ob": de.sum((0, 1)), "T": dt}
        dh = de @ w["O"].T
        back = np.stack([dh[:, :, :HIDDEN], dh[:, ::-1, HIDDEN:]])
        dz_all = np.empty((2, n, t, 4 * HIDDEN), np.float32)
        du, dnext, dc = np.zeros_like(w["U"]), np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        turned = w["U"].transpose(0, 2, 1)
        for k in range(t - 1, -1, -1):
            i, f, o, g, tc, gates, h0, c0 = saved[k]
            d_h = back[:, :, k] + dnext
            dc = dc + d_h * o * (1 - tc * tc)
            dz = np.concatenate([dc * g, dc * c0, d_h * tc, dc * i * (1 - g * g)], 2)
            dz[..., : 3 * HIDDEN] *= gates * (1 - gates)
            dz_all[:, :, k] = dz
            du += h0.transpose(0, 2, 1) @ dz
            dnext, dc = dz @ turned, dc * f
        flat = dz_all.reshape(2, n * t, 4 * HIDDEN)
        both = np.stack([x, x[:, ::-1]]).reshape(2, n * t, EMBED)
        grad |= {"U": du, "W": both.transpose(0, 2, 1) @ flat, "b": flat.sum(1, keepdims=True)}
        dxs = (flat @ w["W"].transpose(0, 2, 1)).reshape(2, n, t, EMBED)
        dx = dxs[0] + dxs[1, :, ::-1]
        de_ = np.zeros_like(w["E"])
        np.add.at(de_, classes, dx)
        grad["E"] = de_
        return float((total - gold).sum() * scale), grad


def train(classes: np.ndarray, tags: np.ndarray, steps: int, batch: int = 48, rate: float = 0.02, seed: int = SEED) -> Tagger:
    """A tagger fitted to (n, time) classes and tags by Adam; the same input gives the same weights."""
    model, rng = Tagger(seed=seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    s = {k: np.zeros_like(v) for k, v in model.w.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(classes), batch)
        _, grad = model.loss_and_gradient(classes[pick], tags[pick].astype(np.int64))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        pace = rate * (0.5 * (1 + np.cos(np.pi * step / steps)) + 0.02)
        for k, g in grad.items():
            g = g * min(1, 1 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            model.w[k] = (model.w[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model

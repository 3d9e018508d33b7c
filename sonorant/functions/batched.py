"""Edit distances and paths of the many pairs of an Arrow batch at once: Myers' bit vectors in words of 64 columns, a row of the
edit table at a time, over pairs of like length side by side. Pairs too long to stand beside enough others go through
`align`'s tiles one by one; the results are the same."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sonorant.functions.align import distance, edit_path, least_places

#: Words of state (rows x words x pairs) that are held at a time, and how many pairs per word make side by side worth while.
CELLS, LEAST_PAIRS = 1 << 22, 4
EQUAL, SUB, DEL, INS = range(4)
_CODE = {"equal": EQUAL, "sub": SUB, "del": DEL, "ins": INS}
_ONE, _ALL, _TOP = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(63)


@dataclass
class Side:
    """Tokens of all rows end to end, as codes, and where each row's begin."""

    codes: np.ndarray
    starts: np.ndarray

    def row(self, k: int) -> np.ndarray:
        return self.codes[self.starts[k] : self.starts[k + 1]]

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def sides(ref: pa.Array, hyp: pa.Array) -> tuple[Side, Side]:
    """Both columns, of token arrays or strings (their code points), with equal codes for equal tokens; null has no tokens."""
    if pa.types.is_string(ref.type) or pa.types.is_large_string(ref.type):
        points = [[np.frombuffer((x.as_py() or "").encode("utf-32-le", "surrogatepass"), "<u4") for x in c] for c in (ref, hyp)]
        return tuple(Side(np.concatenate([np.zeros(0, "<u4"), *p]).astype(np.int64), starts_of(np.array([len(x) for x in p], np.int64))) for p in points)
    flat = [c.flatten() for c in (ref, hyp)]
    known = pa.concat_arrays(flat).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (ref, hyp)]
    return Side(known[: len(flat[0])], starts_of(lengths[0])), Side(known[len(flat[0]) :], starts_of(lengths[1]))


def trimmed(r: Side, h: Side, front: bool) -> np.ndarray:
    """(start, end in r, start, end in h) of each pair without its common end and, with `front`, without its common start."""
    out = np.empty((len(r.starts) - 1, 4), np.int64)
    for k in range(len(out)):
        a, b = r.row(k), h.row(k)
        n = min(len(a), len(b))
        same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
        tail = n if same.all() else int(same.argmin())
        n, head = n - tail, 0
        if front and n:
            same = a[:n] == b[:n]
            head = n if same.all() else int(same.argmin())
        out[k] = r.starts[k] + head, r.starts[k + 1] - tail, h.starts[k] + head, h.starts[k + 1] - tail
    return out


def least_ops(r: Side, h: Side, cut: np.ndarray) -> dict[int, np.ndarray]:
    """The operations of the pairs that have tokens on both sides and whose path `least_places` finds."""
    out = {}
    for k, (a, b, c, d) in enumerate(cut.tolist()):
        if a == b or c == d:
            continue
        turned = b - a < d - c
        long, short = (h.codes[c:d], r.codes[a:b]) if turned else (r.codes[a:b], h.codes[c:d])
        places = least_places(long.tolist(), short.tolist())
        if places is not None:
            out[k] = np.full(len(long), INS if turned else DEL, np.int8)
            out[k][places] = np.where(long[places] == short, EQUAL, SUB)
    return out


def groups(cut: np.ndarray, least_pairs: int) -> Iterator[tuple[np.ndarray, bool]]:
    """The pairs that have tokens on both sides, as groups of like length, and whether a group is worth going side by side."""
    n, m = cut[:, 1] - cut[:, 0], cut[:, 3] - cut[:, 2]
    todo = np.flatnonzero((n > 0) & (m > 0))
    todo = todo[np.lexsort((-m[todo], -n[todo]))]
    at = 0
    while at < len(todo):
        most = int(max(n[todo[at]], m[todo[at]]))
        size = max(1, CELLS // (most * (-(-most // 64) + 1)))
        part = todo[at : at + size]
        # A longer second side than the first pair's widens the state of all: the group ends before it.
        wide = np.flatnonzero(m[part] > 2 * most)
        part = part[: wide[0]] if len(wide) else part
        words = -(-int(m[part].max()) // 64)
        if len(part) >= least_pairs * words:
            yield part, True
            at += len(part)
        else:
            yield part[:1], False
            at += 1


def padded(codes: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of codes as columns of one table, and which places of it they fill."""
    place = np.arange(int(n.max()))[:, None]
    held = place < n
    return codes[np.where(held, start + place, 0)], held


def sweep(r: Side, h: Side, cut: np.ndarray, path: bool) -> tuple[np.ndarray, tuple | None]:
    """Distances of a group sorted by falling length of r; with `path`, also the tables that its paths are read from: for each
    row, as bits, where a step down the diagonal costs 1 and where a step down costs 1."""
    (a, n), (b, m) = ((cut[:, k], cut[:, k + 1] - cut[:, k]) for k in (0, 2))
    pairs, words = len(cut), -(-int(m.max()) // 64)
    x, x_held = padded(r.codes, a, n)
    y, y_held = padded(h.codes, b, m)
    wide = int(max(x.max(), y.max())) + 1
    own = np.arange(pairs) * wide
    j, p = np.nonzero(y_held)
    known, token = np.unique(y[j, p] + own[p], return_inverse=True)
    eqs = np.zeros((words, len(known) + 1), np.uint64)
    np.add.at(eqs, (j >> 6, token), _ONE << (j & 63).astype(np.uint64))
    keys = x + own
    found = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    found = np.where(x_held & (known[found] == keys), found, len(known))
    rise, fall = np.full((words, pairs), _ALL), np.zeros((words, pairs), np.uint64)
    steep = np.zeros((len(x), words, pairs), np.uint64) if path else None
    ups = np.zeros((len(x), words, pairs), np.uint64) if path else None
    live = (x_held).sum(1)
    for k in range(len(x)):
        c = int(live[k])
        token, carry_up, carry_down = found[k, :c], np.ones(c, np.uint64), np.zeros(c, np.uint64)
        for w in range(words):
            pv, mv = rise[w, :c], fall[w, :c]
            eq = eqs[w][token]
            across = eq | mv
            eq = eq | carry_down
            down = (((eq & pv) + pv) ^ pv) | eq
            up, dn = mv | ~(down | pv), pv & down
            if path:
                steep[k, w, :c] = pv ^ mv ^ up ^ dn
                ups[k, w, :c] = up
            over_up, over_down = up >> _TOP, dn >> _TOP
            up, dn = up << _ONE | carry_up, dn << _ONE | carry_down
            carry_up, carry_down = over_up, over_down
            rise[w, :c], fall[w, :c] = dn | ~(across | up), up & across
    left = np.clip(m[None, :] - 64 * np.arange(words)[:, None], 0, 64)
    mask = np.where(left == 64, _ALL, (_ONE << np.minimum(left, 63).astype(np.uint64)) - _ONE)
    count = n + np.bitwise_count(rise & mask).sum(0, dtype=np.int64) - np.bitwise_count(fall & mask).sum(0, dtype=np.int64)
    return count, (x, y, n, m, steep, ups) if path else None


def distances(ref: pa.Array, hyp: pa.Array) -> np.ndarray:
    """The least number of substitutions, deletions and insertions of each pair."""
    r, h = sides(ref, hyp)
    cut = trimmed(r, h, True)
    out = np.maximum(cut[:, 1] - cut[:, 0], cut[:, 3] - cut[:, 2])
    for k, ops in least_ops(r, h, cut).items():
        out[k] = np.count_nonzero(ops)
        cut[k, 1] = cut[k, 0]
    # The band that single pairs have is less than the words of many.
    for part, together in groups(cut, 4 * LEAST_PAIRS):
        if together:
            out[part] = sweep(r, h, cut[part], False)[0]
        else:
            a, b, c, d = cut[part[0]]
            out[part[0]] = distance(r.codes[a:b].tolist(), h.codes[c:d].tolist())
    return out


def walked(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, steep: np.ndarray, ups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair's operations from the end to where one side is used up, as a table with a column for each pair, and how many."""
    i, j, pair = n.copy(), m.copy(), np.arange(len(n))
    out, took = np.zeros((int((n + m).max()), len(n)), np.int8), np.zeros(len(n), np.int64)
    k = 0
    while len(pair := pair[(i[pair] > 0) & (j[pair] > 0)]):
        a, b = i[pair] - 1, j[pair] - 1
        w, bit = b >> 6, (b & 63).astype(np.uint64)
        slope, up = steep[a, w, pair] >> bit & _ONE, ups[a, w, pair] >> bit & _ONE
        op = np.where(x[a, pair] == y[b, pair], EQUAL, np.where(slope == 1, SUB, np.where(up == 1, DEL, INS)))
        out[k, pair] = op
        i[pair] -= op != INS
        j[pair] -= op != DEL
        took[pair] += 1
        k += 1
    return out[:k], took


def paths(ref: pa.Array, hyp: pa.Array) -> tuple[Side, Side, list[np.ndarray]]:
    """Each pair's operations in order, those of `align.edit_path`."""
    r, h = sides(ref, hyp)
    cut = trimmed(r, h, False)
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(cut)
    for k in np.flatnonzero((cut[:, 1] == cut[:, 0]) | (cut[:, 3] == cut[:, 2])):
        a, b, c, d = cut[k]
        out[k] = np.repeat(np.array([DEL, INS], np.int8), [b - a, d - c])
    found = least_ops(r, h, cut)
    for k, ops in found.items():
        out[k] = ops
    left = cut.copy()
    left[list(found), 1] = left[list(found), 0]
    for part, together in groups(left, LEAST_PAIRS):
        if not together:
            a, b, c, d = cut[part[0]]
            out[part[0]] = np.array([_CODE[op] for op, _, _ in edit_path(r.codes[a:b].tolist(), h.codes[c:d].tolist())], np.int8)
            continue
        tables = sweep(r, h, cut[part], True)[1]
        ops, took = walked(*tables)
        for p, k in enumerate(part):
            back = ops[: took[p], p][::-1]
            a, b, c, d = cut[k]
            used_r, used_h = (back != INS).sum(), (back != DEL).sum()
            out[k] = np.concatenate([np.repeat(np.array([INS, DEL], np.int8), [d - c - used_h, b - a - used_r]), back])
    return r, h, [np.concatenate([o, np.zeros(r.starts[k + 1] - cut[k, 1], np.int8)]) for k, o in enumerate(out)]


def alignments(ref: pa.Array, hyp: pa.Array) -> pa.StructArray:
    """struct(sub, del, ins, segments) of each pair: the counts of edits, and the path as runs of equal tokens and of edits, the
    latter as sub. A path takes both sides' tokens in order, so a segment's tokens are slices of the columns' own."""
    r, h, ops = paths(ref, hyp)
    size = np.array([len(o) for o in ops], np.int64)
    every, row = np.concatenate([np.zeros(0, np.int8), *ops]), np.repeat(np.arange(len(ops)), size)
    tally = [np.bincount(row[every == op], minlength=len(ops)).astype(np.int64) for op in (SUB, DEL, INS)]
    first = np.ones(len(every), bool)
    first[1:] = (row[1:] != row[:-1]) | ((every[1:] == EQUAL) != (every[:-1] == EQUAL))
    at = np.flatnonzero(first)
    ends = [np.concatenate([np.cumsum(every != other) - (every != other), [(every != other).sum()]]) for other in (INS, DEL)]
    tokens = [pa.ListArray.from_arrays(pa.array(np.append(e[at], e[-1]).astype(np.int32)), c.flatten()) for e, c in zip(ends, (ref, hyp), strict=True)]
    kind = pa.array(np.where(every[at] == EQUAL, "equal", "sub").astype(object), pa.string())
    runs = pa.StructArray.from_arrays([kind, *tokens], ["op", "ref", "hyp"])
    segments = pa.ListArray.from_arrays(pa.array(starts_of(np.bincount(row[at], minlength=len(ops))).astype(np.int32)), runs)
    return pa.StructArray.from_arrays([*(pa.array(t) for t in tally), segments], ["sub", "del", "ins", "segments"])


def slices(ref: pa.Array, hyp: pa.Array, of_ref: np.ndarray, row: np.ndarray, starts: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray], rows: int) -> pa.ListArray:
    """Token arrays made of runs (start, size) of either column's tokens, those of a row one after the other."""
    flat = pa.concat_arrays([ref.flatten(), hyp.flatten()])
    start, size = np.where(of_ref, starts[0], starts[1] + len(ref.flatten())), np.where(of_ref, *sizes)
    ends = starts_of(size)
    taken = flat.take(pa.array(np.repeat(start - ends[:-1], size) + np.arange(ends[-1])))
    return pa.ListArray.from_arrays(pa.array(starts_of(np.bincount(row, size, rows).astype(np.int64)).astype(np.int32)), taken)


def rescored(ref: pa.Array, hyp: pa.Array, told: pa.Array) -> dict[str, np.ndarray]:
    """Of each pair: the differing segments, how many of them are `told`, by their number from 0, and the edits of words and letters
    once those have the reference's tokens; null tokens have no letters."""
    runs = alignments(ref, hyp).field("segments")
    row, parts = np.repeat(np.arange(len(runs)), pc.list_value_length(runs).to_numpy()), runs.flatten()
    differs = pc.not_equal(parts.field("op"), "equal").to_numpy(zero_copy_only=False)
    before = np.cumsum(differs) - differs
    number = before - before[np.searchsorted(row, row)]
    wide = np.int64(len(parts) + 1)
    asked = np.repeat(np.arange(len(told)), pc.fill_null(pc.list_value_length(told), 0).to_numpy())
    known = pc.fill_null(told.flatten(), -1).to_numpy()
    fits = (known >= 0) & (known < wide)
    forgiven = differs & np.isin(row * wide + number, asked[fits] * wide + known[fits])
    lists = [parts.field(side) for side in ("ref", "hyp")]
    starts, sizes = ([x.offsets.to_numpy()[:-1] - x.offsets[0].as_py() for x in lists], [pc.list_value_length(x).to_numpy() for x in lists])
    fixed = slices(ref, hyp, forgiven, row, starts, sizes, len(runs))
    whole = pa.ListArray.from_arrays(pa.array(starts_of(pc.fill_null(pc.list_value_length(ref), 0).to_numpy(zero_copy_only=False).astype(np.int64)).astype(np.int32)), ref.flatten())
    letters = [pc.binary_join(pa.ListArray.from_arrays(x.offsets, pc.fill_null(x.values, "")), "") for x in (whole, fixed)]
    tally = lambda which: np.bincount(row[which], minlength=len(runs))
    return {"forgiven": tally(forgiven), "segments": tally(differs), "words": distances(whole, fixed), "letters": distances(*letters), "n": pc.list_value_length(whole).to_numpy(), "m": pc.utf8_length(letters[0]).to_numpy()}

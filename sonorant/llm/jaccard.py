"""N-gram Jaccard join: documents whose sets of 5-word shingles are alike.

Rare-first prefix filtering. All shingles have one global order, rare ones first by an estimate from a count sketch of a fixed
size; any fixed order gives exact results, the sketch only makes prefixes selective. Two sets with similarity t share a
shingle among the first |x| - ceil(t |x|) + 1 of each. Documents are joined on prefix shingles; length and positional filters
apply at each shared shingle, then a suffix filter to each distinct pair (counts of the sets over ranges of the hash space, a
byte for each four shingles, whose differences bound the symmetric difference from below), and each remaining pair is verified
once on the whole sets.

Equal sets are one class from the start, and classes that are already linked need no further test of each other: a large
group on one prefix shingle is first chained (each class with the next by size), and only pairs that the chains leave in
different components are joined after that. No link between different components is lost, and none is made up."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.llm.common import materialize, n_partitions, read_table
from sonorant.llm.components import components

SHINGLE, PERCENT = 5, 75
#: Counters of the sketch (fixed, so its broadcast is), of how many single shingles one is counted, shingles counted at once, and
#: the size up to which a group's pairs are all tried at once.
SKETCH, SAMPLED, COUNTED, SMALL = 1 << 24, 64, 1 << 21, 8
#: Members of a large group that one task compares with one another, and into how many parts a token's members are dealt while
#: they are joined with what is known of the token (a group has more than SMALL members, so the copies are no more than these).
TILE, DEALT = 512, 8
#: Ranges of the hash space that a set's members are counted in: a quarter of them, a power of two within these.
LEAST_RANGES, MOST_RANGES = 32, 8192
#: Up to how many ids are looked up by a broadcast join instead of a bit table, and the least bytes of sets in a part of a home.
FEW_IDS, PART_BYTES = 200_000, 1 << 16

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, kept for repeats; emptied when full, so its memory is bounded."""

    KEPT = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        x = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.KEPT:
            self.clear()
        self[word] = x
        return x


@lru_cache(maxsize=1)
def hashes() -> WordHashes:
    return WordHashes()


def shingles(text: bytes | None, kept: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles. bytes.lower changes A to Z alone, and bytes.split parts at
    the six ASCII white-space characters, as the contract has it."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        out = np.array([len(h)], np.uint64)
        for k in range(len(h)):
            out = out * MIX[4] + h[k] * MIX[k]
    else:
        out = h[: len(h) - SHINGLE + 1] * MIX[0]
        for k in range(1, SHINGLE):
            out = out + (h[k : len(h) - SHINGLE + 1 + k] ^ (h[k : len(h) - SHINGLE + 1 + k] >> np.uint64(29))) * MIX[k]
    out ^= out >> np.uint64(31)
    out *= MIX[1]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def class_of(s: np.ndarray) -> int:
    """The signed 64-bit class of a set: equal sets have equal classes."""
    import xxhash

    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], np.uint64).view(np.int64)[0])


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
    kept = hashes()
    for batch in batches:
        ids = batch.column("doc_id")
        texts = batch.column("text").cast(pa.binary())
        for i in range(batch.num_rows):
            yield ids[i], shingles(texts[i].as_py(), kept)


def needed(x, y):
    """The least intersection of sets of x and y members that links them: ceil(75 (x + y) / 175)."""
    return -(-PERCENT * (x + y) // (100 + PERCENT))


def shape(s: np.ndarray) -> np.ndarray:
    """Counts of a set's members by the top bits of their hash, at most 255 each."""
    bits = int(np.log2(min(max(len(s) // 4, LEAST_RANGES), MOST_RANGES)))
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the symmetric difference of two sets, from their shapes: neighbouring ranges of the finer one are
    added up first. Neither that nor the limit of 255 can raise the bound."""
    width = min(len(a), len(b))
    a, b = (x.reshape(width, -1).sum(1, dtype=np.int64) for x in (a, b))
    return int(np.abs(a - b).sum())


# --- the order


def bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(40)).astype(np.int32)


def counters(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, repeats, singles) of some sets' shingles, one after the other: the count of each shingle that comes twice or
    more, and one of SAMPLED of the others, picked at random for each occurrence, so that a shingle that comes once in each of
    many tasks is seen too."""
    tokens = np.sort(tokens)
    start = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, np.int64)
    size = np.diff(np.r_[start, len(tokens)])
    many = size > 1
    once = tokens[start[~many]]
    place = np.arange(len(once), dtype=np.uint64)
    once = once[((once * MIX[3] ^ place * MIX[0]) >> np.uint64(40)) % np.uint64(SAMPLED) == 0]
    repeats = np.r_[size[many], np.zeros(len(once), np.int64)]
    return bucket(np.r_[tokens[start[many]], once]), repeats, np.r_[np.zeros(int(many.sum()), np.int64), np.ones(len(once), np.int64)]


def first_pass(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cls, n, shape) of every document, and (bucket, repeats, singles): the sketch's counters that are not 0. Of equal
    sets that a task counts together one is counted."""
    schema = "doc_id long, cls long, n int, shape binary, bucket int, repeats long, singles long"
    names = ["doc_id", "cls", "n", "shape", "bucket", "repeats", "singles"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]

    def batch(first: int, columns: list) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array(columns[k - first], t) if 0 <= k - first < len(columns) else pa.nulls(n, t) for k, t in enumerate(kinds)], names)

    def read(batches):
        waiting, held, seen, rows = [], 0, set(), []
        for doc_id, s in sets_of(batches):
            cls = class_of(s)
            rows.append((doc_id.as_py(), cls, len(s), shape(s).tobytes()))
            if cls not in seen:
                seen.add(cls)
                waiting.append(s)
                held += len(s)
            if held > COUNTED:
                yield batch(4, counters(np.concatenate(waiting)))
                waiting, held = [], 0
                seen.clear()
            if len(rows) >= 5000:
                yield batch(0, list(zip(*rows, strict=True)))
                rows.clear()
        if rows:
            yield batch(0, list(zip(*rows, strict=True)))
        if waiting:
            yield batch(4, counters(np.concatenate(waiting)))

    both = materialize(docs.select("doc_id", "text").mapInArrow(read, schema), "shingle-classes")
    sketch = both.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("repeats").alias("repeats"), F.sum("singles").alias("singles"))
    return both.where("bucket IS NULL").select("doc_id", "cls", "n", "shape"), sketch


def usual(mean: float, weight: int) -> float:
    """What counters whose shingles are all rare stay below: the mean, chance around it, and a little more."""
    return mean + 3 * (weight * mean) ** 0.5 + 8


def levels(sketch: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each counter its rareness level, five times the logarithm of what it exceeds the usual by, and into how many parts a
    group on a shingle of each level is split. Counters beyond the usual come to the driver: SKETCH of them at most."""
    sketch = materialize(sketch, "sketch")
    total = sketch.agg(F.coalesce(F.sum("repeats"), F.lit(0)).alias("repeats"), F.coalesce(F.sum("singles"), F.lit(0)).alias("singles")).first()
    least = usual(total.repeats / SKETCH, 1), usual(SAMPLED * total.singles / SKETCH, SAMPLED)
    over = sketch.where((F.col("repeats") > least[0]) | (SAMPLED * F.col("singles") > least[1])).toArrow()
    repeats, singles = (over.column(c).to_numpy() for c in ("repeats", "singles"))
    excess = np.maximum(repeats / least[0], SAMPLED * singles / least[1])
    level = np.zeros(SKETCH, np.uint8)
    level[over.column("bucket").to_numpy()] = np.minimum(255, np.ceil(5 * np.log2(excess)))
    return level, np.ceil(min(least) * 2 ** (np.arange(256) / 5) / (8 * TILE)).astype(np.int64)


# --- groups on prefix shingles


def prefix_rows(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """(token, cls, n, at, salt, hot) for each prefix shingle of each document. Groups on shingles of a high level are hot: they
    are dealt in parts, of which each token takes others."""
    shared = docs.sparkSession.sparkContext.broadcast(levels(sketch))

    def emit(batches):
        level, parts = shared.value
        tokens, cls, n, held = [], [], [], 0

        def flush():
            lengths = np.array([len(t) for t in tokens])
            token = np.concatenate(tokens)
            c = np.repeat(np.array(cls, np.int64), lengths)
            at = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            own = parts[level[bucket(token)]]
            salt = ((c.view(np.uint64) * MIX[2] ^ token * MIX[3]) >> np.uint64(40)).astype(np.int64) % own
            columns = [token.view(np.int64), c, np.repeat(np.array(n, np.int32), lengths), at.astype(np.int32), salt.astype(np.int32), own > 1]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["token", "cls", "n", "at", "salt", "hot"])

        for _, s in sets_of(batches):
            if len(s):
                keep = len(s) + (-PERCENT * len(s) // 100) + 1
                tokens.append(s[np.argsort(level[bucket(s)], kind="stable")[:keep]])
                cls.append(class_of(s))
                n.append(len(s))
                held += keep
                if held > 100_000:
                    yield flush()
                    tokens, cls, n, held = [], [], [], 0
        if tokens:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(emit, "token long, cls long, n int, at int, salt int, hot boolean")


PAIR = "a long, b long, na int, nb int"
MEMBER = "token long, cls long, n int, at int"


def pair_batch(a, b, na, nb) -> list[pa.Array]:
    """Distinct pairs, the smaller class first."""
    swap = a > b
    a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return [pa.array(a[new]), pa.array(b[new]), pa.array(na[new].astype(np.int32)), pa.array(nb[new].astype(np.int32))]


def pass_filters(n1, at1, n2, at2) -> np.ndarray:
    """Length filter, and positional filter at a shared shingle: what may still follow it must reach what is needed."""
    low, high = np.minimum(n1, n2), np.maximum(n1, n2)
    return (100 * low >= PERCENT * high) & (np.minimum(n1 - at1, n2 - at2) >= needed(n1, n2))


def columns_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    parts = [[b.column(n).to_numpy(zero_copy_only=False) for n in names] for b in batches]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64) for _ in names]


def groups(rows: DataFrame) -> DataFrame:
    """First candidates and the members of groups that need a second look: pairs (kind 0) of small groups, links of a chain
    through large ones, and the members (kind 1) of large or split groups. A task sorts its share of the tokens; no group
    on a common shingle is larger than its parts."""

    def join(batches):
        token, cls, n, at, salt, hot = columns_of(batches, ["token", "cls", "n", "at", "salt", "hot"])
        order = np.lexsort((cls, n, salt, token))
        token, cls, n, at, salt, hot = token[order], cls[order], n[order].astype(np.int64), at[order].astype(np.int64), salt[order], hot[order]
        keep = np.ones(len(token), bool)  # equal sets come once
        keep[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (cls[1:] != cls[:-1])
        token, cls, n, at, salt, hot = (x[keep] for x in (token, cls, n, at, salt, hot))
        start = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]) if len(token) else np.empty(0, np.int64)
        size = np.diff(np.r_[start, len(token)])
        group = np.repeat(np.arange(len(start)), size)
        own = np.repeat(size, size)
        pairs = []
        for d in range(1, SMALL):
            i = np.flatnonzero((group[:-d] == group[d:]) & ((own[:-d] <= SMALL) | (d == 1))) if len(group) > d else np.empty(0, np.int64)
            i = i[pass_filters(n[i], at[i], n[i + d], at[i + d])]
            pairs.append((cls[i], cls[i + d], n[i], n[i + d]))
        # Of a large group, the two members that have the shingle earliest lead: sets whose other shingles are as common, as
        # those of an original are among its edited copies. Each other member is tried with both.
        early = np.lexsort((cls, at, group))
        for d in range(2):
            lead = early[np.minimum(start + d, len(early) - 1)][group] if len(start) else np.empty(0, np.int64)
            i = np.flatnonzero((own > SMALL) & (cls != cls[lead]))
            i = i[pass_filters(n[i], at[i], n[lead[i]], at[lead[i]])]
            pairs.append((cls[i], cls[lead[i]], n[i], n[lead[i]]))
        p = pair_batch(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
        k = len(p[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int8)), *p, *(pa.nulls(k).cast(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names)
        m = (own > SMALL) | hot
        k = int(m.sum())
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int8)), *(pa.nulls(k).cast(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())), pa.array(token[m]), pa.array(cls[m]), pa.array(n[m].astype(np.int32)), pa.array(at[m].astype(np.int32))], names)

    names = ["kind", "a", "b", "na", "nb", "token", "cls", "n", "at"]
    # A task holds its share of the rows in numpy, so the shares are made smaller than a shuffle's usual ones.
    return rows.repartition(3 * n_partitions(rows.sparkSession), "token", "salt").mapInArrow(join, f"kind byte, {PAIR}, {MEMBER}")


def second_candidates(members: DataFrame, comps: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs within the members' groups whose classes are not connected yet and whose shapes leave room for a link. A group is
    cut into bands of set size (linked sets lie in one band or neighbouring ones) and tiles of a bounded number of members."""
    m = members.join(comps.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    open_ = m.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
    # A common token's members would meet in one task of this join; parts of them do not.
    open_ = open_.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    m = m.withColumn("part", F.pmod(F.xxhash64("cls"), F.lit(DEALT)).cast("int"))
    m = materialize(m.join(open_, ["token", "part"]).drop("part"), "open-members")
    shapes = classes.join(m.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("shape").alias("shape"))
    m = m.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT))).cast("int"))
    both = m.withColumn("upper", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.col("band") - F.col("upper"))
    tiles = both.groupBy("token", "band").agg(F.count("*").alias("c")).select("token", "band", F.ceil(F.col("c") / TILE).cast("int").alias("k"))
    tiles = tiles.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    both = both.withColumn("part", F.pmod(F.xxhash64("cls"), F.lit(DEALT)).cast("int"))
    dealt = both.join(tiles, ["token", "band", "part"]).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("token", "band", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "cls", "n", "at", "root", "upper", "chunk")
    # Shapes join last: they are wide, and rows are dealt by narrow ones.
    dealt = dealt.join(shapes, "cls")

    def compare(batches):
        token, band, x, y, cls, n, at, root, upper, chunk, shape = columns_of(batches, ["token", "band", "x", "y", "cls", "n", "at", "root", "upper", "chunk", "shape"])
        order = np.lexsort((y, x, band, token))
        token, band, x, y, cls, n, at, root, upper, chunk = (v[order] for v in (token, band, x, y, cls, n.astype(np.int64), at.astype(np.int64), root, upper, chunk))
        shape = shape[order] if len(order) else shape
        cut = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (band[1:] != band[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(token) else []
        found, held = [], 0
        for s, e in zip(cut, [*cut[1:], len(token)], strict=True):
            if e - s < 2:
                continue
            c, g, u, r, q, w = cls[s:e], root[s:e], upper[s:e], n[s:e], at[s:e], chunk[s:e]
            own = [np.frombuffer(v, np.uint8) for v in shape[s:e]]
            width = min(map(len, own))
            form = np.stack([v.reshape(width, -1).sum(1, dtype=np.int32) for v in own])
            for lo in range(0, e - s, TILE):
                part = slice(lo, lo + TILE)
                fit = (g[part, None] != g[None, :]) & (u[part, None] == 0) & ((u[None, :] == 1) | (c[part, None] < c[None, :])) & ((x[s] == y[s]) | (w[part, None] != w[None, :]))
                fit &= pass_filters(r[part, None], q[part, None], r[None, :], q[None, :])
                i, j = np.nonzero(fit)
                i += lo
                keep = np.empty(len(i), bool)
                for b in range(0, len(i), 20_000):
                    ib, jb = i[b : b + 20_000], j[b : b + 20_000]
                    keep[b : b + 20_000] = np.abs(form[ib] - form[jb]).sum(1, dtype=np.int64) <= r[ib] + r[jb] - 2 * needed(r[ib], r[jb])
                i, j = i[keep], j[keep]
                found.append((c[i], c[j], r[i], r[j]))
                held += len(i)
            if held > 500_000:
                yield pa.RecordBatch.from_arrays(pair_batch(*(np.concatenate(v) for v in zip(*found, strict=True))), ["a", "b", "na", "nb"])
                found, held = [], 0
        if found:
            yield pa.RecordBatch.from_arrays(pair_batch(*(np.concatenate(v) for v in zip(*found, strict=True))), ["a", "b", "na", "nb"])

    return dealt.repartition(n_partitions(members.sparkSession), "token", "band", "x", "y").mapInArrow(compare, PAIR)


# --- verification


def suffix_filtered(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) whose shapes leave room for a link, each once."""
    pairs = pairs.distinct()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    shapes = classes.join(ends, "cls", "left_semi").groupBy("cls").agg(F.first("shape").alias("shape"))
    both = pairs.join(shapes.select(F.col("cls").alias("a"), F.col("shape").alias("sa")), "a").join(shapes.select(F.col("cls").alias("b"), F.col("shape").alias("sb")), "b")

    def test(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            room = na + nb - 2 * needed(na, nb)
            far = [apart(np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8)) for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)]
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(np.array(far, np.int64) <= room))

    return materialize(both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(test, PAIR), "pairs")


def whole_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, tokens) of the wanted classes (cls). One document of each class is read again; a bit table of a fixed size over
    their ids keeps the others' texts from being cut into shingles, and rows that pass it by chance are joined away."""
    cells = 1 << 21
    ids = classes.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id")).select(F.xxhash64("doc_id").alias("h"))
    ids = materialize(ids, "wanted-ids")
    hashed = docs.select(F.xxhash64("doc_id").alias("h"), "text")
    bits = None
    if ids.count() <= FEW_IDS:
        hashed = hashed.join(F.broadcast(ids.distinct()), "h", "left_semi")
    else:
        marked = ids.groupBy(F.shiftrightunsigned("h", 43).cast("int").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1, cast(h & 31 as int))")).alias("bits")).toArrow()
        table = np.zeros(cells, np.int32)
        table[marked.column("cell").to_numpy()] = marked.column("bits").to_numpy()
        bits = docs.sparkSession.sparkContext.broadcast(table)

    def read(batches):
        kept = hashes()
        for b in batches:
            texts = b.column("text")
            if bits is not None:
                h = b.column("h").to_numpy().view(np.uint64)
                texts = texts.take(pa.array(np.flatnonzero((bits.value[(h >> np.uint64(43)).astype(np.int64)] >> (h & np.uint64(31)).astype(np.int32)) & 1)))
            for at in range(0, len(texts), 500):
                sets = [s for s in (shingles(t.as_py(), kept) for t in texts.slice(at, 500).cast(pa.binary())) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "tokens"])

    sets = hashed.mapInArrow(read, "cls long, tokens binary")
    return sets.join(wanted, "cls", "left_semi").dropDuplicates(["cls"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b, na, nb), the links (a, b). Pairs meet at the least class next to one of them, so a group of
    alike sets is sent to one place once; a place with more than half a task's share of all bytes is split, pair by pair. A task
    reads place by place and holds the sets of one at a time."""
    n = n_partitions(pairs.sparkSession)
    ends = pairs.select(F.col("a").alias("v"), F.col("b").alias("w")).union(pairs.select(F.col("b").alias("v"), F.col("a").alias("w")))
    label = ends.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("l"))
    placed = pairs.join(label.select(F.col("v").alias("a"), F.col("l").alias("la")), "a").join(label.select(F.col("v").alias("b"), F.col("l").alias("lb")), "b").withColumn("home", F.least("la", "lb"))
    weight = F.sum(8 * (F.col("na").cast("long") + F.col("nb")))
    share = max(PART_BYTES, (pairs.agg(weight.alias("w")).first().w or 0) // (2 * n))
    many = placed.groupBy("home").agg(F.ceil(weight / share).alias("parts")).where("parts > 1")
    placed = placed.join(many, "home", "left").withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1))).cast("int")).select("home", "salt", "a", "b")
    placed = materialize(placed, "placed-pairs")
    used = placed.select("home", "salt", F.col("a").alias("cls")).union(placed.select("home", "salt", F.col("b").alias("cls"))).distinct()
    sent = used.join(sets, "cls").select("home", "salt", F.col("cls").alias("a"), F.lit(None).cast("long").alias("b"), "tokens")
    both = sent.unionByName(placed.withColumn("tokens", F.lit(None).cast("binary")))

    def verify(batches):
        place, members, out = None, {}, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("home", "salt", "a", "b")]
            for home, salt, a, b, tokens in zip(*columns, batch.column("tokens"), strict=True):
                if (home, salt) != place:
                    place, members = (home, salt), {}
                if b is None:  # sets come before the pairs of their place
                    members[a] = np.frombuffer(tokens.as_py(), np.uint64)
                    continue
                x, y = members[a], members[b]
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                if int((both[1:] == both[:-1]).sum()) >= needed(len(x), len(y)):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []

    dealt = both.repartition(n, "home", "salt").sortWithinPartitions("home", "salt", F.col("b").asc_nulls_first())
    return materialize(dealt.mapInArrow(verify, "a long, b long"), "jaccard-links")


def linked_pairs(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    return verified(pairs, whole_sets(docs, classes, wanted))


def join(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text; other columns are dropped) -> doc_id, n_shingles, component_id for each row.

    Texts of fewer than five words are one shingle; null, empty and blank ones have none and link with nothing: their
    component is their own id. Repeated rows have equal sets and so one component. Rows with a null id take part; a
    component's id is the smallest non-null one. An empty table gives an empty table."""
    docs = docs.select("doc_id", "text")
    classes, sketch = first_pass(docs)
    found = materialize(groups(prefix_rows(docs, sketch)), "prefix-groups")
    pairs = suffix_filtered(found.where("kind = 0").select("a", "b", "na", "nb"), classes)
    links = linked_pairs(docs, classes, pairs)
    comps = components(links)
    members = found.where("kind = 1").select("token", "cls", "n", "at")
    more = materialize(second_candidates(members, comps, classes).distinct(), "second-pairs")
    if not more.isEmpty():
        comps = components(links.unionByName(linked_pairs(docs, classes, more)))
    keyed = classes.join(comps.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("key", F.coalesce("root", "cls"))
    keyed = keyed.where("n > 0")
    least = keyed.groupBy("key").agg(F.min("doc_id").alias("component_id"))
    linked = keyed.join(least, "key").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return linked.unionByName(classes.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents of docs whose id is their component's, in the columns that they came with. Rows of equal id and text
    become one row; rows that share an id and differ in text are told apart by it and each stay."""
    kept = join(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("k_id")).agg(F.count("*").alias("rows"))
    kept = materialize(kept, "kept-ids")
    # The ids are one narrow side: hashed in memory, so the texts are moved once and not sorted.
    out = docs.join(kept.select("k_id").hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("k_id")), "left_semi")
    return out if kept.where("rows > 1").isEmpty() else out.dropDuplicates(["doc_id", "text"])


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read_table(spark, sf_dir, "documents"))

"""Nearest neighbours by cross-polytope hashing.

A hash turns a unit vector by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) and takes the nearest
signed axis. A table concatenates as many hashes, the last one over fewer axes, as make some MEAN vectors a bucket, so buckets
follow the number of rows. Every vector stands in one bucket of each table; a query probes the buckets of each table whose axes it
lies nearest to, and what it meets there is ranked by the exact inner product.

The number of probes is fitted: for a bounded sample of queries the true neighbours are found among all rows, and the probes are
as many as find a share RECALL of them. Data that fall into clusters need few, vectors without any structure many. Equal vectors
are one class, which keeps its smallest ids, as many as one answer can name. Buckets have no cap: members and queries of a full one
are dealt into tiles, each member meeting each query in one of them. Queries that meet too few vectors probe all buckets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonorant.llm.common import materialize, n_partitions, read_table
from sonorant.llm.embeddings import finite_rows, unit

NEAREST, TABLES, MEAN, SEED = 20, 4, 256, 17
#: Queries of the sample that the number of probes is fitted on, and the share of their neighbours to find.
SAMPLE, RECALL = 100, 0.97
#: Members and queries of a bucket that one tile has.
TILE = 1024
#: Rows that a task works on at once; answers that it holds before it hands them on.
SLICE, HELD = 256, 1 << 19


def packed(x: np.ndarray) -> bytes:
    """The values of a vector: f and floats where they tell them exactly, else d and doubles. Equal values, equal bytes."""
    x = x + 0.0  # no negative zeros
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    return b"f" + short.tobytes() if (short == x).all() else b"d" + x.astype("<f8").tobytes()


def unpacked(values: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<f4" if v[:1] == b"f" else "<f8", offset=1).astype(np.float64) for v in values])


def size_of(value: bytes) -> int:
    return (len(value) - 1) // (4 if value[:1] == b"f" else 8)


@lru_cache(maxsize=64)
def signs(d: int, table: int, at: int, seed: int = SEED) -> np.ndarray:
    """Three rows of random signs over the axes: the next power of two from d."""
    return np.random.default_rng((seed, d, table, at)).choice([-1.0, 1.0], (3, 1 << (d - 1).bit_length()))


def turned(x: np.ndarray, table: int, at: int) -> np.ndarray:
    """The rows of x under the pseudo-rotation `at` of a table."""
    d = x.shape[1]
    s = signs(d, table, at)
    n = s.shape[1]
    y = np.pad(x, ((0, 0), (0, n - d)))
    for row in s:
        y, h = y * row, 1
        while h < n:
            pairs = y.reshape(len(y), -1, 2, h)
            y, h = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], 2).reshape(len(y), n), 2 * h
        y /= np.sqrt(n)
    return y


def widths(rows: int, d: int, mean: int = MEAN) -> list[int]:
    """Axes of each hash of a table: as many buckets (twice the axes, multiplied) as leave about `mean` rows for each."""
    out, left, axes = [], rows / mean, 1 << (d - 1).bit_length()
    while left >= 2:
        out.append(min(axes, 2 ** int(np.log2(left)) // 2))
        left /= 2 * out[-1]
    return out


def buckets(w: list[int]) -> int:
    return int(np.prod([2 * k for k in w], dtype=np.int64)) if w else 1


def probes(x: np.ndarray, table: int, w: list[int], n: int) -> np.ndarray:
    """For each unit row of x its n nearest buckets of a table, the nearest first: those with the largest sums of products with the
    signed axes. The first one is the bucket that the row itself stands in."""
    key, score = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for at, k in enumerate(w):
        y = turned(x, table, at)[:, :k]
        sums = (score[:, :, None] + np.concatenate([y, -y], 1)[:, None, :]).reshape(len(x), -1)
        names = (key[:, :, None] * (2 * k) + np.arange(2 * k)).reshape(len(x), -1)
        if sums.shape[1] > n:
            best = np.argpartition(-sums, n - 1, 1)[:, :n]
            sums, names = np.take_along_axis(sums, best, 1), np.take_along_axis(names, best, 1)
        order = np.argsort(-sums, 1, kind="stable")
        key, score = np.take_along_axis(names, order, 1), np.take_along_axis(sums, order, 1)
    return key


def by_size(values: list[bytes]) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """(length, places, vectors) for each length of vectors."""
    sizes = np.array([size_of(v) for v in values])
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d).tolist()
        yield d, at, unpacked([values[k] for k in at])


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (packed) of the rows that take part, each once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, rows = finite_rows(batch.column("embedding"))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(where)), pa.array([packed(x) for x in rows], pa.binary())], ["vec_id", "vector"])

    rows = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(emit, "vec_id long, vector binary").distinct()


def bucket_rows(rows: DataFrame, n_rows: int, tables: int, n_probes: int | None, kind: int) -> DataFrame:
    """rows (cid, least, vector) -> size, key, kind, cid, least, vector: a row for each of the n_probes nearest buckets (None: all)
    of each table."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(SLICE, (1 << 20) // max(1, n_probes or n_rows // MEAN)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                for d, places, x in by_size(part.column("vector").to_pylist()):
                    w = widths(n_rows, d)
                    own, x = part.take(pa.array(places)), unit(x)
                    for table in range(tables):
                        found = probes(x, table, w, min(n_probes or buckets(w), buckets(w)))
                        out = own.take(pa.array(np.repeat(np.arange(len(x)), found.shape[1])))
                        n = out.num_rows
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d, np.int32)), pa.array(found.ravel() * tables + table), pa.array(np.full(n, kind, np.int32)), *(out.column(c) for c in ("cid", "least", "vector"))], ["size", "key", "kind", "cid", "least", "vector"])

    return rows.select("cid", "least", "vector").mapInArrow(emit, "size int, key long, kind int, cid long, least long, vector binary")


def best_of(q: np.ndarray, m: np.ndarray, least: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of q the places and inner products of its k nearest rows of m, ties to the smaller `least`. Products of a
    matrix choose, with a margin for their rounding; what is chosen is measured row by row, the same in every tile."""
    near, out = q @ m.T, []
    reach = np.partition(near, len(m) - k, 1)[:, len(m) - k] if len(m) > k else np.full(len(q), -np.inf)
    margin = 1e-13 * q.shape[1] * np.sqrt((q * q).sum(1)) * np.sqrt((m * m).sum(1).max())
    for i, row in enumerate(near):
        at = np.flatnonzero(~(row < reach[i] - margin[i]))
        exact = (q[i] * m[at]).sum(1)
        first = np.lexsort((least[at], -exact))[:k]
        out.append((at[first], exact[first]))
    return out


def groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """The tables of the rows that share the columns `names`, from rows sorted by them."""
    held, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = np.stack([batch.column(n).to_numpy() for n in names])
        cut = np.flatnonzero(np.r_[True, (g[:, 1:] != g[:, :-1]).any(0)])
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), batch.num_rows], strict=True):
            if (now := tuple(g[:, s].tolist())) != held and parts:
                yield pa.Table.from_batches(parts)
                parts = []
            held = now
            parts.append(batch.slice(s, e - s))
    if parts:
        yield pa.Table.from_batches(parts)


def best_held(held: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Of answers (qid, cid, least, same, score), each query's k nearest, each member once."""
    qid, cid, least, same, score = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((cid, least, -score, qid))
    q, c = qid[order], cid[order]
    order = order[np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])]]
    q = qid[order]
    order = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
    return qid[order], cid[order], least[order], same[order], score[order]


def tile_neighbours(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """For each query (kind 1) its k nearest of the members (kind 0) that share a tile of this task with it: qid, cid, least, same,
    score. One tile and HELD answers are held at a time; a query's answers of several tiles are merged before the shuffle."""
    held, n_held = [], 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["qid", "cid", "least", "same", "score"])
    for tile in groups(batches, ("size", "key", "x", "y")):
        kind = tile.column("kind").to_numpy()
        members, queries = (tile.take(pa.array(np.flatnonzero(kind == v))) for v in (0, 1))
        if not (members.num_rows and queries.num_rows):
            continue
        own, asked = members.column("vector").to_pylist(), queries.column("vector").to_pylist()
        cid, least, qid = members.column("cid").to_numpy(), members.column("least").to_numpy(), queries.column("cid").to_numpy()
        m, place = unpacked(own), {v: at for at, v in enumerate(own)}
        for lo in range(0, len(asked), SLICE):
            found = best_of(unpacked(asked[lo : lo + SLICE]), m, least, k)
            n = np.array([len(at) for at, _ in found])
            at, row = np.concatenate([a for a, _ in found]), np.repeat(np.arange(lo, lo + len(n)), n)
            same = np.array([place.get(v, -1) for v in asked[lo : lo + SLICE]])[row - lo] == at
            held.append((qid[row], cid[at], least[at], same, np.nan_to_num(np.concatenate([s for _, s in found]), nan=-np.inf, posinf=np.inf, neginf=-np.inf)))
            n_held += len(row)
            if n_held > HELD:
                held = [best_held(held, k)]
                n_held = len(held[0][0])
                if n_held > HELD // 2:
                    yield out()
                    held, n_held = [], 0
    if held:
        held = [best_held(held, k)]
        yield out()


def met(members: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Of bucket rows of members (kind 0) and queries (kind 1): qid, cid, least, same, score of each query's k nearest members of
    each tile that it is in."""
    keys = ["size", "key"]

    def tiled(rows: DataFrame, name: str) -> DataFrame:
        """Full buckets only: at most one for each TILE rows."""
        return rows.groupBy(*keys).agg(F.ceil(F.count("*") / TILE).cast("int").alias(name)).where(F.col(name) > 1)

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        chunk = F.pmod(F.xxhash64("cid"), F.coalesce(own, F.lit(1))).cast("int").alias(own)
        each = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(other)
        return rows.join(full, keys, "left").select(*keys, "kind", "cid", "least", "vector", chunk, each)

    full = materialize(tiled(members, "x").join(tiled(queries, "y"), keys, "full"), "full-buckets")
    rows = dealt(members, "x", "y").unionByName(dealt(queries, "y", "x"))
    placed = rows.repartition(n_partitions(rows.sparkSession), *keys, "x", "y").sortWithinPartitions(*keys, "x", "y", "kind")
    return placed.mapInArrow(lambda batches: tile_neighbours(batches, k), "qid long, cid long, least long, same boolean, score double")


def fitted_probes(classes: DataFrame, queries: DataFrame, n_rows: int, k: int) -> int:
    """How many probes of each table find a share RECALL of the k nearest neighbours of SAMPLE queries, drawn by a hash. What comes
    to the driver is SAMPLE * k vectors at most."""
    chosen = [bytes(r.vector) for r in queries.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).collect()]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, bytes]]] = [[] for _ in chosen]
        for batch in batches:
            values = batch.column("vector").to_pylist()
            for d, places, x in by_size(values):
                mine = [i for i, v in enumerate(chosen) if size_of(v) == d]
                if mine:
                    for i, (at, score) in zip(mine, best_of(unpacked([chosen[i] for i in mine]), x, np.arange(len(x)), k + 1), strict=True):
                        new = [(s, values[places[a]]) for a, s in zip(at.tolist(), score.tolist(), strict=True) if values[places[a]] != chosen[i]]
                        best[i] = sorted(best[i] + new, reverse=True)[:k]
        rows = [(i, s, v) for i, b in enumerate(best) for s, v in b]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.binary()), strict=True)], ["i", "score", "vector"])

    found = classes.select("vector").mapInArrow(emit, "i int, score double, vector binary")
    found = found.withColumn("at", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "vector"))).where(F.col("at") <= k)
    rank = []
    pairs = [(chosen[r.i], bytes(r.vector)) for r in found.select("i", "vector").collect()]
    for d in {size_of(q) for q, _ in pairs}:
        w, own = widths(n_rows, d), [p for p in pairs if size_of(p[0]) == d]
        asked = sorted({q for q, _ in own})
        row = np.array([asked.index(q) for q, _ in own])
        x, y, n = unit(unpacked(asked)), unit(unpacked([v for _, v in own])), 8
        while True:
            least = np.full(len(own), np.iinfo(np.int64).max)
            for table in range(TABLES):
                hit = probes(x, table, w, min(n, buckets(w)))[row] == probes(y, table, w, 1)
                least = np.where(hit.any(1), np.minimum(least, hit.argmax(1)), least)
            if n >= buckets(w) or (least < n).mean() >= RECALL:
                break
            n *= 2
        rank.append(least)
    return int(np.sort(np.concatenate(rank))[int(np.ceil(RECALL * len(pairs))) - 1]) + 1 if pairs else 1


def nearest(vectors: DataFrame, asked, k: int = NEAREST) -> DataFrame:
    """vectors (vec_id, embedding; other columns are dropped) -> query_id, rank, vec_id, score: for each row that `asked` (a column
    of vec_id) holds for, the k rows with the largest inner product in double precision among those found, ties to the smaller id.

    Rows whose id or vector is null, and vectors that are empty, zero or hold null or non-finite components, take no part; vectors of
    different lengths never meet. Rows equal in id and vector are one. A row is no answer to itself; another row of the same id
    is. An empty table, or one without queries, gives an empty table."""
    rows = materialize(valid(vectors), "vectors")
    ask = materialize(rows.where(asked).select("vector").distinct().withColumn("cid", F.monotonically_increasing_id()).withColumn("least", F.lit(0).cast("long")), "queries")
    # A class of equal vectors keeps as many ids as one answer can name, and the query's own.
    some = rows.withColumn("at", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    classes = some.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = materialize(classes.withColumn("least", F.element_at("ids", 1)).withColumn("cid", F.monotonically_increasing_id()), "classes")
    n_rows = classes.count()
    n_probes = fitted_probes(classes, ask, n_rows, k)

    def best(tables: int, n: int | None, queries: DataFrame) -> DataFrame:
        members = materialize(bucket_rows(classes, n_rows, tables, 1, 0), "members")
        probed = materialize(bucket_rows(queries, n_rows, tables, n, 1), "probes")
        once = met(members, probed, k + 1).groupBy("qid", "cid").agg(F.min("least").alias("least"), F.max("same").alias("same"), F.max("score").alias("score"))
        by = Window.partitionBy("qid").orderBy(F.desc("score"), "least")
        return materialize(once.withColumn("at", F.row_number().over(by)).where(F.col("at") <= k + 1).drop("at"), "nearest")

    top = best(TABLES, n_probes, ask)
    several = classes.where(F.size("ids") > 1).select("cid", "ids")
    wide = top.join(several, "cid", "left").withColumn("ids", F.coalesce("ids", F.array("least")))
    enough = wide.groupBy("qid").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") > k)
    short = materialize(ask.join(enough.withColumnRenamed("qid", "cid"), "cid", "left_anti"), "short")
    if not short.isEmpty():
        again = best(1, None, short)
        top = top.join(short.select(F.col("cid").alias("qid")), "qid", "left_anti").unionByName(again)
        wide = top.join(several, "cid", "left").withColumn("ids", F.coalesce("ids", F.array("least")))
    # At most (k + 1) classes with (k + 1) ids each.
    named = F.flatten(F.collect_list(F.transform("ids", lambda v: F.struct((-F.col("score")).alias("less"), v.alias("vec_id"), "same", "score"))))
    lists = wide.groupBy("qid").agg(F.slice(F.array_sort(named), 1, k + 1).alias("near"))
    answers = ask.select("vector", F.col("cid").alias("qid")).join(lists, "qid").drop("qid")
    out = rows.where(asked).join(answers, "vector").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("near", lambda v: ~(v["same"] & (v["vec_id"] == F.col("vec_id")))), 1, k).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0)

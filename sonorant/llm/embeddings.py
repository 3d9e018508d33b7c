"""Near-duplicate vectors by spherical-cap filters.

A filter direction is the concatenation of one codeword from each of two random codes, one for each half of the space, so
SIZE * SIZE directions come from 2 * SIZE codewords. A vector lies in the cap of every direction whose inner product with it
exceeds CAP; because the product splits into the halves, the caps are listed by pruning sorted lists instead of trying all
directions. Vectors join on the caps that they share, and each pair is verified in double precision, in the first cap that it
shares only, so it counts once.

The number of directions grows with the number of vectors, and caps get higher, so that the pairs compared grow by about the
power 1.5 of the vectors, not by their square.

Expected recall: a cap of height 3 / sqrt(d) takes 0.00135 of the sphere, and two vectors at cosine 0.9 share one with
probability 0.0007 or more; over 128 * 128 caps that is 11 shared caps on average, and more for closer pairs. Products with
two codewords vary more than with one random direction, so some vectors exceed few or no caps; such a vector lowers its own
height to that of its `fewest` best caps. Close vectors have close heights and still meet. Among higher caps close vectors share a
smaller part of theirs, so each takes more of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.llm.common import materialize, n_partitions, read_table
from sonorant.llm.components import components

COSINE, SIZE, SIZED_FOR, HEIGHT, FEWEST, SEED = 0.9, 128, 2000, 3.0, 32, 11
#: Sums of two products that are tried at a time.
DECODED = 1 << 22
#: Vectors of a cap that one task compares with one another.
TILE = 1024


@lru_cache(maxsize=4)
def codes(d: int, size: int = SIZE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Two random codes of unit codewords, for the first d // 2 coordinates and the others."""
    rng = np.random.default_rng((seed, d))
    out = []
    for n in (d // 2, d - d // 2):
        c = rng.standard_normal((n, size))
        out.append(c / np.maximum(np.linalg.norm(c, axis=0), 1e-30))
    return out[0], out[1]


def code_size(n: int) -> int:
    """Codewords in each code for n vectors: directions grow as n to 0.8."""
    return max(SIZE, round(SIZE * (n / SIZED_FOR) ** 0.4))


def fewest(size: int) -> int:
    """Caps that a vector takes at least: more where directions are many, as close vectors then share fewer of their best ones."""
    return FEWEST + round(FEWEST / 3 * np.log2(size / SIZE)) if size > SIZE else FEWEST


def height(size: int) -> float:
    """How many spreads high a cap of size * size directions is: HEIGHT for SIZE, then so that the mean number of caps of a vector
    keeps its proportion to the fewest."""
    if size <= SIZE:
        return HEIGHT
    beyond = NormalDist().cdf(-HEIGHT) * (SIZE / size) ** 2 * fewest(size) / FEWEST
    return -NormalDist().inv_cdf(beyond)


def caps(x: np.ndarray, size: int = SIZE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(row, cap) of all caps that hold the unit rows of x: list decoding. A vector's products with the first code are taken
    while they and its best product with the second code still reach the height."""
    d, few = x.shape[1], fewest(size)
    first, second = codes(d, size, seed)
    # Directions are (c1, c2) / sqrt(2); the inner product has a spread of 1 / sqrt(d).
    least = min(height(size) / np.sqrt(d), 0.8) * np.sqrt(2)
    a, b = x[:, : d // 2] @ first, x[:, d // 2 :] @ second
    # The best sums come from the best products of each half.
    best = [-np.sort(-np.partition(v, size - few, 1)[:, -few:], 1) for v in (a, b)]
    sums = (best[0][:, :, None] + best[1][:, None, :]).reshape(len(x), -1)
    least = np.minimum(least, -np.partition(-sums, few - 1, 1)[:, few - 1])[:, None] - 1e-12
    row, i = np.nonzero(a + b.max(1, keepdims=True) >= least)
    found = []
    for at in range(0, len(row), max(1, DECODED // size)):
        r, c = row[at : at + DECODED // size], i[at : at + DECODED // size]
        k, j = np.nonzero(a[r, c][:, None] + b[r] >= least[r])
        found.append((r[k], c[k] * size + j))
    rows, cap = (np.concatenate(v) for v in zip(*found, strict=True))
    return rows, cap


def finite_rows(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places and double values of the vectors that can link: not null, no null or non-finite component, not zero."""
    where, out = [], []
    for k, v in enumerate(column):
        if v.is_valid and len(v.values):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all() and x.any():
                where.append(k)
                out.append(x)
    return np.array(where, np.int64), out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def packed(x: np.ndarray) -> list[bytes]:
    """The rows' bytes, as single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return [(s if same else v).tobytes() for v, s, same in zip(x, short, (short == x).all(1), strict=True)]


def unpacked(raw: bytes, d: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * d else np.float64).astype(np.float64)


def cap_type(size: int) -> str:
    return "<u4" if size**2 < 2**32 else "<i8"


def cap_rows(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """vectors (cid, w, embedding) -> (cap, cid, w, vector, others): a row for each cap that holds a vector; `others` are the
    smaller ones of its caps, sorted. Vectors of different lengths never meet: a cap's number carries the length."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                where, rows = finite_rows(part.column("embedding"))
                cid, w = part.column("cid").to_numpy(), part.column("w").to_numpy()
                for d in {len(r) for r in rows}:
                    pick = [k for k, r in enumerate(rows) if len(r) == d]
                    x = np.stack([rows[k] for k in pick])
                    r, cap = caps(unit(x), size)
                    order = np.lexsort((cap, r))
                    r, cap = r[order], cap[order]
                    raw, held = packed(x), cap.astype(cap_type(size))
                    start, own = np.searchsorted(r, np.arange(len(pick))), where[pick][r]
                    smaller = [held[start[k] : n].tobytes() for n, k in enumerate(r)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cap + d * size**2), pa.array(cid[own]), pa.array(w[own]), pa.array([raw[k] for k in r], pa.binary()), pa.array(smaller, pa.binary())],
                        ["cap", "cid", "w", "vector", "others"],
                    )

    return vectors.mapInArrow(emit, "cap long, cid long, w long, vector binary, others binary")


def first_shared(smaller: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of the pairs i, j of vectors that share a cap, those that share none of their sorted smaller ones."""
    if len(i) > 4 * len(smaller):  # many pairs: products of the lists' incidence rows
        known, place = np.unique(np.concatenate(smaller), return_inverse=True)
        rows = np.zeros((len(smaller), len(known)), np.float32)
        rows[np.repeat(np.arange(len(smaller)), [len(x) for x in smaller]), place] = 1
        return (rows @ rows.T)[i, j] == 0
    return np.array([not len(np.intersect1d(smaller[a], smaller[b], True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)


def tile_links(tile: pa.Table, size: int = SIZE) -> list[tuple[int, int, int]]:
    """Of one tile's vectors: for each that links, (cid, root, n): n, the weight of the vectors that it links with where their
    pair counts here; root, a vector of its group of links in the tile."""
    if tile.num_rows < 2:
        return []
    d = tile.column("cap")[0].as_py() // size**2
    ids, weight, c = (tile.column(n).to_numpy() for n in ("cid", "w", "chunk"))
    v = unit(np.stack([unpacked(raw.as_py(), d) for raw in tile.column("vector")]))
    across = tile.column("x")[0].as_py() != tile.column("y")[0].as_py()
    links = []
    for lo in range(0, len(v), TILE):
        i, j = np.nonzero(v[lo : lo + TILE] @ v.T >= COSINE)
        i = i + lo
        fit = (i < j) & ((c[i] != c[j]) | (not across))
        links.append((i[fit], j[fit]))
    i, j = (np.concatenate(x) for x in zip(*links, strict=True))
    if not len(i):
        return []
    n, root = np.zeros(len(v), np.int64), np.arange(len(v))
    while True:  # a link joins its ends in whatever cap it is seen; it counts in the first one
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            break
    once = first_shared([np.frombuffer(raw.as_py(), cap_type(size)) for raw in tile.column("others")], i, j)
    np.add.at(n, i[once], weight[j[once]])
    np.add.at(n, j[once], weight[i[once]])
    return [(int(ids[k]), int(ids[root[k]]), int(n[k])) for k in np.flatnonzero((n > 0) | (root != np.arange(len(v))))]


def sorted_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Table]]:
    """The tiles of a task's rows, which are sorted by them; a batch's last tile waits for the next batch, so no more than a batch
    and a tile are held."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        key = np.stack([table.column(n).to_numpy() for n in ("cap", "x", "y")])
        cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist()]
        yield [table.slice(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]
        rest = table.slice(cut[-1])
    if rest is not None:
        yield [rest]


def links_within(tiles: DataFrame, size: int = SIZE) -> DataFrame:
    """(cid, root, n) of all tiles, rows (cap, x, y, chunk, cid, w, vector, others) of a partition sorted by the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_tiles(b for b in batches if b.num_rows):
            out = [row for tile in group for row in tile_links(tile, size)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["cid", "root", "n"])

    return tiles.mapInArrow(run, "cid long, root long, n long")


def link(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding; other columns are dropped) -> vec_id, n_links, component_id for each row.

    Equal vectors are one class with a weight, so copies are never paired. Vectors that are null, zero, empty or hold null
    or non-finite components link with nothing, and so do vectors of different lengths; their component is their own id.
    Rows that repeat an id are vectors of their own. A component's id is the smallest non-null id. An empty table gives an
    empty table."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    able = rows.where(good)
    classes = materialize(able.groupBy("embedding").agg(F.count("*").alias("w"), F.min("vec_id").alias("least")).withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    size = code_size(classes.count())
    held = materialize(cap_rows(classes.select("cid", "w", "embedding"), size), "caps")
    tiles = held.groupBy("cap").agg(F.ceil(F.count("*") / TILE).cast("int").alias("k")).where("k > 1")  # at most one row for each cap
    dealt = held.join(tiles, "cap", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("cap", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "cid", "w", "vector", "others")
    placed = dealt.repartition(n_partitions(spark), "cap", "x", "y").sortWithinPartitions("cap", "x", "y")
    links = materialize(links_within(placed, size), "cap-links")
    counts = links.groupBy("cid").agg(F.sum("n").alias("n"))
    comps = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    keyed = classes.select("cid", "least", "w").join(comps.select(F.col("node").alias("cid"), "root"), "cid", "left").join(counts, "cid", "left").withColumn("key", F.coalesce("root", "cid"))
    first = keyed.groupBy("key").agg(F.min("least").alias("component_id"))
    done = keyed.join(first, "key").select("cid", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    by_vector = classes.select("cid", "embedding").join(done, "cid").drop("cid")
    linked = able.join(by_vector, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone)


def op2_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read_table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))

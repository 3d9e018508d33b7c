"""Mixing sources to target weights.

A source's documents, in an order of hashes, form one stream of words; the stream is cut into blocks of a fixed number of
words. Each epoch permutes the blocks by an affine map; a source gives its whole stream once for each full epoch and the
first blocks of one more permutation, the last of them in part, so that exactly its rounded target is taken. A
hypergeometric splitting tree deals the sources' draws to output shards: each shard gets its share of every source as if all
draws had been shuffled, exactly as many draws as the others, and draws that no other shard has; a shard's draws are then
shuffled among themselves."""

from __future__ import annotations

from math import gcd
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonorant.llm.common import SPACE, materialize, n_partitions, new_folder, read_table

BLOCK_WORDS, SHARDS, SEED, MOST = 256, 64, 17, 3
#: Documents that a bucket of a source's order holds on average; a bucket is one sort group.
BUCKET = 4096


class Source(NamedTuple):
    source: str | None
    words: int
    docs: int


def targets(sources: list[Source], most: int = MOST) -> list[float]:
    """Words that each source should give. Sources weigh 1, 2, 3, repeating, in the order of the list, and share all words;
    what exceeds `most` times a source's words goes to the others by weight, until none exceeds it."""
    weights = [k % 3 + 1 for k in range(len(sources))]
    total = float(sum(s.words for s in sources))
    out = [0.0] * len(sources)
    free = list(range(len(sources)))
    while free:
        rest = total - sum(out[k] for k in range(len(sources)) if k not in free)
        share = rest / sum(weights[k] for k in free)
        over = [k for k in free if share * weights[k] > most * sources[k].words]
        for k in over or free:
            out[k] = float(most * sources[k].words) if over else share * weights[k]
        free = [k for k in free if k not in over] if over else []
    return out


#: Standard deviations from the mode beyond which chances vanish in double precision.
REACH = 12


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of n draws without replacement are good, for counts of any size: inversion over the chances relative to the mode's,
    by their ratios, as far from it as they count. Arrays are as long as some standard deviations."""
    low, high, total = max(0, n - bad), min(good, n), good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    spread = int(REACH * (n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5) + 40
    up, down = np.arange(mode, min(high, mode + spread), dtype=np.float64), np.arange(mode, max(low, mode - spread), -1, dtype=np.float64)
    above = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    below = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    chances = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    at = int(np.searchsorted(chances, rng.random() * chances[-1], "right"))
    return min(mode - len(below) + at, high)


def cuts_of(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): draws of each source before each shard ends."""
    return np.cumsum(split(quotas, shards, rng), axis=0)


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): draws of each source for each shard; rows sum to equal numbers, columns to the quotas."""
    if shards == 1:
        return quotas[None, :]
    left, total = shards // 2, int(quotas.sum())
    take = total * left // shards
    got = np.zeros_like(quotas)
    rest, need = total, take
    for k, q in enumerate(map(int, quotas)):  # the multivariate draw, one margin at a time
        got[k] = hypergeometric(q, rest - q, need, rng) if need and q else 0
        rest, need = rest - q, need - int(got[k])
    return np.vstack([split(got, left, rng), split(quotas - got, shards - left, rng)])


def plan(sources: list[Source], block: int, shards: int, seed: int, most: int) -> list[tuple]:
    """For each source: its number, words, target, n blocks, full epochs, words of the last epoch, rank of the last block by
    epoch, multipliers and shifts of the epochs' permutations, draws before each shard ends."""
    rng = np.random.default_rng(seed)
    out, quotas = [], []
    for s, target in zip(sources, targets(sources, most), strict=True):
        n, take = -(-s.words // block), round(target)
        full, part = divmod(take, s.words) if s.words else (0, 0)
        top = max(2, min(n, 2**62 // max(n, 1)))  # products with a block's number stay within 63 bits
        a = [next(int(x) for x in iter(lambda: rng.integers(1, top), None) if gcd(int(x), n) == 1) if n > 1 else 1 for _ in range(full + 1)]
        c = [int(rng.integers(0, max(n, 1))) for _ in range(full + 1)]
        out.append((s.words, target, n, full, part, a, c))
        quotas.append(full * n + (min(n, -(-part // block) + 1) if part else 0))
    cuts = cuts_of(np.array(quotas, np.int64), shards, rng)
    return [(k, *row, [int(x) for x in cuts[:, k]]) for k, row in enumerate(out)]


PLAN = "p_k long, source_size long, target double, p_n long, p_full long, p_part long, p_a array<long>, p_c array<long>, p_cuts array<long>"


#: Sources up to which their rows are broadcast.
FEW_SOURCES = 10_000
DRAWS = "array<struct<epoch:long,block:long,shard:int,place:long,first:long,words:long>>"


def with_sizes(docs: DataFrame) -> DataFrame:
    """docs with `size`, the words of `text`, written down once: everything after this reads sizes and not texts."""
    size = F.coalesce(F.regexp_count("text", F.lit(SPACE.replace("[", "[^", 1))), F.lit(0)).cast("long")
    return materialize(docs.drop("size").withColumn("size", size), "sized")


def small(df: DataFrame, n: int) -> DataFrame:
    """df, which has n rows, for a join: broadcast where n is known to be small."""
    return F.broadcast(df) if n <= FEW_SOURCES else df


def mix(sized: DataFrame, block: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED, most: int = MOST) -> DataFrame:
    """sized (doc_id, source, size, any others; see `with_sizes`) with added columns source_size, target, row (a number of its
    own for each document with words) and `draws`, an array of struct(epoch, block, shard, place, first, words): the slices of
    the document that the mix takes, `first` counted in the document's words, `place` a number by whose order the shard is
    shuffled.

    Null sources are a source of their own, the last; null, empty and blank texts have size 0 and no draws. Rows with equal
    ids are documents of their own. An empty table gives an empty table. Input columns with the names of added ones are
    replaced, others may have any name. The driver holds one row for each source."""
    spark = sized.sparkSession
    sized = sized.drop("source_size", "target", "row", "draws")
    found = [Source(r.source, r.words, r.docs) for r in sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()]
    found.sort(key=lambda s: (s.source is None, s.source or ""))
    buckets = spark.createDataFrame([(k, s.source, s.docs // BUCKET + 1) for k, s in enumerate(found)], "p_k long, b_source string, b_n long")
    params = spark.createDataFrame(plan(found, block, shards, seed, most), PLAN)
    whole = sized.select(F.struct(*sized.columns).alias("p_doc"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.xxhash64("doc_id", F.lit(seed)).alias("p_key"))
    placed = whole.join(small(buckets, len(found)), F.col("p_source").eqNullSafe(F.col("b_source"))).withColumn("p_bucket", F.pmod("p_key", "b_n")).drop("b_source", "b_n")
    narrow = placed.groupBy("p_k", "p_bucket").agg(F.sum("p_size").alias("s"))
    before = Window.partitionBy("p_k").orderBy("p_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = narrow.select("p_k", "p_bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("p_start"))
    inner = Window.partitionBy("p_k", "p_bucket").orderBy("p_key", "p_doc.doc_id", "p_size").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("p_at", F.coalesce(F.sum("p_size").over(inner), F.lit(0)))
    at = at.join(starts, ["p_k", "p_bucket"]).withColumn("p_at", F.col("p_at") + F.col("p_start"))
    at = at.join(small(params, len(found)), "p_k")
    draws = F.expr(f"""
        flatten(transform(sequence(0L, p_full), e -> transform(sequence(p_at div {block}, (p_at + p_size - 1) div {block}), b ->
            struct(e AS epoch, b AS block,
                   (p_a[cast(e AS int)] * b + p_c[cast(e AS int)]) % p_n AS rank,
                   (p_a[cast(e AS int)] * (p_n - 1) + p_c[cast(e AS int)]) % p_n AS last_rank))))""")
    # Words of the block that the epoch takes: all of a full epoch's; of the last epoch's, what its earlier ranks leave.
    taken = f"""transform(p_draws, d -> named_struct('d', d, 'n',
        if(d.epoch < p_full, {block}L, least({block}L, greatest(0L, p_part - d.rank * {block} + if(d.rank > d.last_rank, p_n * {block} - source_size, 0L))))))"""
    slices = f"""filter(transform({taken}, x -> named_struct('epoch', x.d.epoch, 'block', x.d.block,
        'shard', size(filter(p_cuts, c -> c <= x.d.epoch * p_n + x.d.rank)), 'place', xxhash64(p_k, x.d.epoch, x.d.block, {seed}L),
        'first', greatest(p_at, x.d.block * {block}) - p_at,
        'words', least(p_at + p_size, x.d.block * {block} + x.n) - greatest(p_at, x.d.block * {block}))), x -> x.words > 0)"""
    out = at.withColumn("p_draws", F.when(F.col("p_size") > 0, draws)).withColumn("p_slices", F.when(F.col("p_size") > 0, F.expr(slices)).otherwise(F.array().cast(DRAWS)))
    row = F.when(F.col("p_size") > 0, F.struct(F.col("p_k").alias("k"), F.col("p_at").alias("at")))
    return out.select("p_doc.*", "source_size", "target", row.alias("row"), F.col("p_slices").alias("draws"))


def write_shards(mix: DataFrame, folder: str) -> DataFrame:
    """Write the draws of a mix under `folder` as shard=N folders and return them as read from there: shard, place, row, epoch,
    block, first, words. Each shard holds the draws that the splitting tree deals to it and no others, shuffled: dealt to its
    files by a hash and sorted by `place` within each. A reader takes the words of a row's document from `first` on."""
    spark = mix.sparkSession
    rows = mix.where("row IS NOT NULL").select("row", F.explode("draws").alias("d")).select("row", "d.*")
    sub = F.pmod(F.col("place"), F.lit(n_partitions(spark)))
    out = rows.repartition(n_partitions(spark), "shard", sub).sortWithinPartitions("shard", "place")
    out.write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    return spark.read.schema(out.schema).parquet(folder)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each document once for each epoch that draws the block of its first word, in the columns that
    it came with. Whole documents are drawn, so a source comes near its target, not to it. A document without words is in no
    mix."""
    whole = with_sizes(docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", "source", "text")).drop("text")
    return mix(whole, **options).select("whole", F.explode(F.expr("filter(draws, d -> d.first = 0)"))).select("whole.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the written shards hold of each document, counted from their rows."""
    sized = with_sizes(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    out = materialize(mix(sized), "mix")
    taken = write_shards(out, new_folder(spark, "mixed-shards")).groupBy("row").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_set("shard")).alias("shards"))
    both = out.select("doc_id", "size", "source_size", "target", "row").join(taken, "row", "left")
    return both.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.array_join("shards", ",").alias("shards"))

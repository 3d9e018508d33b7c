"""Resharding by minimum-cost flow.

Old shards hold bytes, new shards have capacities. A minimum-cost flow says how many bytes go from which old shard to which
new one so that the fewest bytes move; blocks (hash groups of an old shard's documents, a fixed number of them whatever the
data) are dealt out along the flow, and the files of shards that gain or lose a block are rewritten."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonorant.llm.common import n_partitions, new_folder, read_table

OLD_SHARDS, NEW_SHARDS, BLOCKS = 32, 40, 256
#: What stands for a null old shard.
NONE = -1


def least_moves(supply: list[int], demand: list[int], cost=lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """The flow of a transport problem by successive shortest paths: (old, new) -> bytes. `cost` is what a byte's move costs,
    0 or more. Supply and demand must have equal sums."""
    n, m = len(supply), len(demand)
    left, need = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    height = [0] * (n + m)  # potentials: keep the reduced costs of residual edges at 0 or more
    while any(left):
        dist, came, queue = [float("inf")] * (n + m), [-1] * (n + m), []
        for i in range(n):
            if left[i]:
                dist[i] = 0
                queue.append((0, i))
        heapq.heapify(queue)
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u]:
                continue
            edges = ((n + j, cost(u, j)) for j in range(m)) if u < n else ((i, -cost(i, u - n)) for i in range(n) if flow[i, u - n])
            for v, c in edges:
                if (x := d + c + height[u] - height[v]) < dist[v]:
                    dist[v], came[v] = x, u
                    heapq.heappush(queue, (x, v))
        end = min((n + j for j in range(m) if need[j]), key=dist.__getitem__)
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        path.reverse()
        most = min([left[path[0]], need[end - n], *(flow[v, u - n] for u, v in zip(path, path[1:], strict=False) if u >= n)])
        for u, v in zip(path, path[1:], strict=False):
            if u < n:
                flow[u, v - n] += most
            else:
                flow[v, u - n] -= most
        left[path[0]] -= most
        need[end - n] -= most
        height = [h + min(d, dist[end]) for h, d in zip(height, dist, strict=True)]
    return {k: v for k, v in flow.items() if v}


def deal(blocks: dict[tuple[int, int], int], flow: dict[tuple[int, int], int], shards: int) -> dict[tuple[int, int], int]:
    """(old shard, block) -> new shard: an old shard's blocks, the largest first, go where most of its flow is unmet; then
    blocks move from the fullest shard to the emptiest while that brings the two closer."""
    unmet: dict[int, dict[int, int]] = defaultdict(dict)
    for (i, j), b in flow.items():
        unmet[i][j] = b
    to: dict[tuple[int, int], int] = {}
    for (i, k), size in sorted(blocks.items(), key=lambda x: (-x[1], x[0])):
        j = max(unmet[i], key=lambda j: (unmet[i][j], -j)) if unmet[i] else i % shards
        to[i, k] = j
        unmet[i][j] = unmet[i].get(j, 0) - size
    held: list[list[tuple[int, tuple[int, int]]]] = [[] for _ in range(shards)]
    total = [0] * shards
    for key, j in to.items():
        insort(held[j], (blocks[key], key))
        total[j] += blocks[key]
    for _ in range(4 * len(blocks)):
        a, b = max(range(shards), key=total.__getitem__), min(range(shards), key=total.__getitem__)
        gap = total[a] - total[b]
        near = bisect_left(held[a], (gap // 2 + 1,))
        moves = [(abs(gap - 2 * held[a][k][0]), k, None) for k in (near - 1, near) if 0 <= k < len(held[a])]
        for k, (size, _) in enumerate(held[a][:: max(1, len(held[a]) // 64)]):  # or an exchange
            at = bisect_left(held[b], (size - gap // 2,))
            moves += [(abs(gap - 2 * (size - held[b][x][0])), k * max(1, len(held[a]) // 64), x) for x in (at - 1, at) if 0 <= x < len(held[b])]
        # Of the moves that at least halve the gap, one that brings most bytes home or takes fewest away; else what closes it most.
        def added(move, a=a, b=b):
            out, back = held[a][move[1]], held[b][move[2]] if move[2] is not None else None
            cost = out[0] * ((out[1][0] != b) - (out[1][0] != a))
            return cost + (back[0] * ((back[1][0] != a) - (back[1][0] != b)) if back else 0)

        best = min(moves, key=lambda x: (x[0] > gap // 2, added(x) if x[0] <= gap // 2 else x[0], x[0], x[1]), default=None)
        if best is None or best[0] >= gap:
            break
        out = held[a].pop(best[1])
        back = held[b].pop(best[2]) if best[2] is not None else None
        for item, x, y in ((out, a, b), (back, b, a)):
            if item:
                insort(held[y], item)
                total[x] -= item[0]
                total[y] += item[0]
                to[item[1]] = y
    return to


def reshard(docs: DataFrame, folder: str, new_shards: int = NEW_SHARDS, old_shards: int = OLD_SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """docs (doc_id, text, any others) in shards of near equal sizes: all rows, with size (UTF-8 bytes and 16), old_shard, shard
    and slot (gapless from 0 in the shard).

    An old shard is the column old_shard if there is one, else a hash of doc_id. Shards that gain or lose a block are written
    under `folder` as shard=N folders and read back; the rows of shards that keep all their blocks and gain none are returned as
    they came, from where they stand (with the default layout each shard changes). A null old_shard is a row that has no shard
    yet: it moves wherever it is needed. Null texts have 16 bytes; rows with equal ids are documents of their own and fall into
    one block; an empty table gives an empty table. Input columns with the names of added ones are replaced, others may have any
    name. The driver holds the sizes of old_shards * blocks blocks, whatever the data."""
    spark = docs.sparkSession
    given = docs.drop("size", "shard", "slot")
    known = "old_shard" in given.columns
    old = F.col("old_shard").cast("int") if known else F.pmod(F.xxhash64("doc_id"), F.lit(old_shards)).cast("int")
    rest = [c for c in given.columns if c != "old_shard"]
    size = (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size")
    marked = given.select(F.struct(*rest).alias("r_doc"), old.alias("old_shard"), F.coalesce(old, F.lit(NONE)).alias("r_old"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(blocks)).cast("int").alias("r_block"), size)
    found = marked.groupBy("r_old", "r_block").agg(F.sum("size").alias("bytes"), F.count("*").alias("docs")).collect()
    # Old shards by number, those without one last; a new shard of an old one's number keeps what it can.
    numbers = sorted({r.r_old for r in found if r.r_old != NONE})
    place = {n: n for n in range(max([n + 1 for n in numbers] + [0]))}
    place[NONE] = max(len(place), new_shards)
    sizes = {(place[r.r_old], r.r_block): r.bytes for r in found}
    count = {(place[r.r_old], r.r_block): r.docs for r in found}
    supply = [0] * (max([i for i, _ in sizes], default=0) + 1)
    for (i, _), b in sizes.items():
        supply[i] += b
    total = sum(supply)
    demand = [total * (j + 1) // new_shards - total * j // new_shards for j in range(new_shards)]
    to = deal(sizes, least_moves(supply, demand), new_shards)
    first: dict[int, int] = defaultdict(int)
    back = {v: k for k, v in place.items()}
    rows = []
    for key in sorted(to):
        rows.append((back[key[0]], key[1], to[key], first[to[key]]))
        first[to[key]] += count[key]
    changed = {x for (i, _), j in to.items() if i != j for x in (i, j)} if known else set(range(new_shards))
    # old_shards * blocks rows, as many as the driver has just held.
    places = spark.createDataFrame([(*r, r[2] in changed) for r in rows], "r_old int, r_block int, shard int, r_first long, r_new boolean")
    parts = -(-n_partitions(spark) // new_shards) * 2
    placed = marked.join(F.broadcast(places), ["r_old", "r_block"]).withColumn("r_sub", F.pmod(F.xxhash64("r_old", "r_block"), F.lit(parts)))
    own = Window.partitionBy("shard", "r_sub", "r_old", "r_block").orderBy("r_doc.doc_id", "size")
    slot = F.col("r_first") + F.row_number().over(own) - 1
    columns = [*(F.col(f"r_doc.`{c}`") for c in rest), "size", "old_shard", "shard", slot.alias("slot")]
    out = placed.where("r_new").repartition(parts * new_shards, "shard", "r_sub").select(*columns)
    out.write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    written = spark.read.schema(out.schema).parquet(folder)
    if changed >= set(range(new_shards)):
        return written
    return written.unionByName(placed.where("NOT r_new").select(*columns))


def op9_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reshard(read_table(spark, sf_dir, "documents").select("doc_id", "text"), new_folder(spark, "shards"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

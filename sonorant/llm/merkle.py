"""Merkle manifests by sibling-shift self-joins.

Leaves are numbered within their group by a distributed ordinal: a range partitioning, counts of each partition, running sums of
those counts. On every level the nodes then equijoin with themselves on the sibling's computed index (XOR for two slots, slot
offsets for more), and the rows of slot zero emit the parents. The groups' roots are the leaves of one more tree, built alike. On
the way down each node takes its parent's path and puts its own siblings before it, so a proof is carried, never looked up.

Index pairs are unique, so no join has a hot key, however large a group is. A level is half of the one below: all of them hold
twice the leaves, each written to the shared folder."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonorant.llm.common import materialize, n_partitions, read_table

#: The row number in monotonically_increasing_id() takes the lower 33 bits.
ROW_BITS = 33
#: Levels of so few nodes are written as one file. Descents are written every so many levels.
SMALL, EVERY = 4096, 6


def field(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(n_chars: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))), F.lit("")), 256))


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with idx, from 0 without gaps in each group in the given order, and n, the group's rows. A group may hold any share
    of the rows: its partitions are numbered apart and shifted by the counts of those before. Nulls come first."""
    placed = rows.repartitionByRange(n_partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    placed = materialize(placed.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", ROW_BITS)), "placed")
    # A row for each group and partition that meet: at most the groups and the partitions together.
    met = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    by = Window.partitionBy(group)
    before = F.sum("rows").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = materialize(met.select(group, "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(by).alias("n")), "shifts")
    return placed.join(shifts, [group, "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (tree, idx, n, digest, any others) with `left` and `right`: the digests of the run's other nodes before and after
    each one, joined; empty where there are none."""
    slot, empty, out = F.pmod("idx", F.lit(arity)), F.lit(b""), nodes
    for o in range(1, arity):
        to = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + F.pmod(slot + o, F.lit(arity))
        other = nodes.select("tree", F.col("idx").alias("to"), F.col("digest").alias(f"s{o}"))
        out = out.withColumn("to", to).join(other, ["tree", "to"], "left").drop("to")
    part = lambda fits: F.concat(empty, *(F.coalesce(F.when(fits(slot + o), F.col(f"s{o}")), empty) for o in range(1, arity)))
    return out.withColumns({"left": part(lambda at: at >= arity), "right": part(lambda at: at < arity)}).drop(*(f"s{o}" for o in range(1, arity)))


class Tree(NamedTuple):
    """levels[k] has the nodes of level k whose tree goes on, with their siblings; tops (tree, level, digest) has a row for each
    tree: its root and the level where it stands."""

    levels: list[DataFrame]
    tops: DataFrame


def build(leaves: DataFrame, arity: int = 2) -> Tree:
    """leaves (tree, idx, n, digest; any others, kept on level 0 only)."""
    if arity < 2:
        raise ValueError("a node needs two children at least")
    most, nodes, levels, tops = leaves.agg(F.max("n")).first()[0] or 0, leaves, [], []
    top = lambda k: nodes.where("n = 1").select("tree", F.lit(k).alias("level"), "digest")
    while most > 1:
        tops.append(top(len(levels)))
        level = siblings(nodes.where("n > 1"), arity)
        level = materialize(level.coalesce(1) if levels and most <= SMALL else level, "level")
        levels.append(level)
        first, most = level.where(F.pmod("idx", F.lit(arity)) == 0), -(-most // arity)
        up = lambda c: F.floor(c / arity) if arity & (arity - 1) else F.shiftright(c, arity.bit_length() - 1)
        nodes = first.select("tree", up(F.col("idx")).cast("long").alias("idx"), up(F.col("n") + (arity - 1)).cast("long").alias("n"), F.unhex(F.sha2(hexed(F.concat("digest", "right")), 256)).alias("digest"))
    tops.append(top(len(levels)))
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return Tree(levels, materialize(out, "tops"))


def descend(tree: Tree, leaves: DataFrame, tops: DataFrame, arity: int = 2) -> DataFrame:
    """The leaves with the columns of their tree's row in `tops` (tree, level, path array of (left, right), any others), their own
    siblings and those of all nodes above them put before its path."""
    kept = [c for c in tops.columns if c not in ("tree", "level", "path")]
    at = lambda k: tops.where(F.col("level") == k).select("tree", F.lit(0).cast("long").alias("up"), *kept, "path")
    above = at(len(tree.levels))
    for k in reversed(range(len(tree.levels))):
        own = tree.levels[k].withColumn("up", F.floor(F.col("idx") / arity) if arity & (arity - 1) else F.shiftright("idx", arity.bit_length() - 1))
        path = F.concat(F.array(F.struct("left", "right")), F.col("path")).alias("path")
        joined = own.join(above, ["tree", "up"])
        if k == 0:
            alone = leaves.where("n = 1").join(at(0).drop("up"), "tree")
            return joined.select(*leaves.columns, *kept, path).unionByName(alone.select(*leaves.columns, *kept, "path"))
        above = joined.select("tree", F.col("idx").alias("up"), *kept, path).unionByName(at(k))
        if k % EVERY == 0:
            above = materialize(above, "paths")
    return leaves.join(above.drop("up"), "tree").select(*leaves.columns, *kept, "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and a path give, as hex text."""
    return F.aggregate(path, hexed(leaf), lambda acc, s: F.sha2(F.concat(hexed(s["left"]), acc, hexed(s["right"])), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, arity: int = 2) -> DataFrame:
    """docs (doc_id, source, lang, n_chars, text; other columns are dropped) -> doc_id, leaf, changed, subroot, root (hex text),
    path (array of (left, right) digests, from the leaf's level to the root): one row for each row.

    `tampered` tells the rows whose leaf is also taken with n_chars + 1, as `changed`; elsewhere, where it is null and where
    n_chars is null (or the largest long, which has no next one), that is the leaf itself. Null values count as `-`, so a null
    text differs from an empty one; rows of a null lang are a group of their own, the first one. Rows of equal doc_id stand in the
    order of their digests; rows that repeat are leaves of their own. Texts of any length are hashed whole. An empty table gives
    an empty one."""
    more = F.coalesce(F.try_add(F.col("n_chars").cast("long"), F.lit(1)), F.col("n_chars"))
    hit = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    # The salt deals equal rows out; they are alike, so it changes no digest.
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"), leaf_digest(F.col("n_chars")).alias("digest"), F.when(hit, leaf_digest(more)).alias("changed"), F.monotonically_increasing_id().alias("salt"))
    leaves = materialize(numbered(materialize(rows, "leaves"), "tree", ["doc_id", "digest", "salt"]).drop("salt"), "numbered")
    tree = build(leaves, arity)
    groups = materialize(numbered(tree.tops.withColumnRenamed("tree", "name").withColumn("tree", F.lit("")), "tree", ["name"]), "groups")
    whole = build(groups, arity)
    top = whole.tops.first()
    no_path = F.expr("filter(array(named_struct('left', X'', 'right', X'')), x -> false)")
    tops = descend(whole, groups, whole.tops.select("tree", "level", no_path.alias("path")), arity)
    tops = materialize(tops.select(F.col("name").alias("tree"), "level", F.col("digest").alias("subroot"), "path"), "group-paths")
    root = F.lit(bytes(top["digest"]).hex() if top else None).cast("string")
    out = descend(tree, leaves, tops, arity)
    return out.select("doc_id", hexed(F.col("digest")).alias("leaf"), hexed(F.coalesce("changed", "digest")).alias("changed"), hexed(F.col("subroot")).alias("subroot"), root.alias("root"), "path")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    out = manifest(read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text"), tampered)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: hexed(F.concat(s["left"], s["right"]))), ""), 256)
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.unhex("changed"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

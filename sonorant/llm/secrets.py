"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its SHA-256; the ledger says which (blob, rule version) pairs have been scanned and
what was found. A run scans each blob that lacks a pair once, whichever paths hold it, appends to the ledger, and joins the
findings back to all paths. DataFrame functions only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.llm.common import new_folder, read_table


class Rule(NamedTuple):
    """`pattern` is matched leftmost and without overlap; a match whose `group` has fewer than `least` characters is dropped."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


#: The patterns of the base rules, then those of two more public formats.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
)

#: A finding carries the tag of the rule version that made it, so a rule's older findings never count for a newer one.
LEDGER = "blob binary, scanned array<string>, findings array<struct<start:int,rank:int,stop:int,kind:string,tag:string>>"
NO_FINDING = "filter(array(named_struct('start', 0, 'rank', 0, 'stop', 0, 'kind', '', 'tag', '')), x -> false)"


def let(x: Column, body) -> Column:
    """body of x, with x evaluated once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


#: Matches of a text whose places are summed up in one fold; an array that grows is copied with each match of its block only.
BLOCK = 256


def places(parts: Column) -> Column:
    """parts, an array of struct(gap, m, n): the pieces of a text by their lengths in order -> array<struct<start, stop, n>>. Running
    sums block by block, then over the blocks: a text of many matches costs what they are, not their square."""
    rows = F.expr("filter(array(named_struct('start', 0, 'stop', 0, 'n', 0)), x -> false)")

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        return F.struct((start + x["m"]).alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), (start + x["m"]).alias("stop"), x["n"].alias("n")))).alias("out"))

    def joined(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        before = F.aggregate(blocks, start, lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        shifted = lambda x, at: F.transform(x["out"], lambda y: F.struct((y["start"] + at).alias("start"), (y["stop"] + at).alias("stop"), y["n"].alias("n")))
        return F.flatten(F.zip_with(blocks, before, shifted))

    def blocks(p: Column) -> Column:
        last = F.floor((F.size(p) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(p, k * BLOCK + 1, BLOCK), F.struct(F.lit(0).alias("at"), rows.alias("out")), step))

    return let(let(parts, blocks), joined)


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, stop, kind, tag>> of a rule's matches in code points, stop exclusive. Matches and the pieces
    between them alternate, so running sums of their lengths give the places."""

    def placed(found: Column) -> Column:
        pieces = F.split(text, rule.pattern, -1)
        tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
        lengths = lambda c: F.transform(c, F.length)
        parts = F.arrays_zip(lengths(F.slice(pieces, 1, F.size(found))).alias("gap"), lengths(found).alias("m"), lengths(tested).alias("n"))
        row = lambda x: F.struct(x["start"], F.lit(rank).alias("rank"), x["stop"], F.lit(rule.kind).alias("kind"), F.lit(rule.tag).alias("tag"))
        return F.transform(F.filter(places(parts), lambda x: x["n"] >= rule.least), row)

    none = F.expr(NO_FINDING)
    return let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (doc_id, text; other columns are dropped), one row for each path and version -> doc_id, blob, findings, an array
    of struct(start, rank, stop, kind) sorted by start, then by the rules' order. `ledger` is a folder in shared storage; what
    it lacks is scanned and appended to it, and a rule counts as seen in its version only.

    Null texts are empty; texts of any length are scanned whole, in time that follows their matches; matches of equal start come in
    the rules' order; repeated rows are paths of one blob; an empty table gives an empty table and leaves the ledger."""
    spark = docs.sparkSession
    tags = [r.tag for r in rules]
    paths = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob"))
    try:
        seen = spark.read.schema(LEDGER).parquet(ledger)
        seen.isEmpty()
    except Exception as e:  # no ledger yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        seen = spark.createDataFrame([], LEDGER)
    # Any one path of each blob, by its id; its text follows through one shuffle, and is not sorted.
    held = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"), F.count("doc_id").alias("named"))
    done = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("done"))
    todo = held.join(done, "blob", "left").select("blob", F.col("doc_id").alias("one"), F.array_except(F.array(*map(F.lit, tags)), F.coalesce("done", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    unseen = texts.join(todo.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("one"))).where(F.col("blob") == F.unhex(F.sha2("text", 256)))
    none = F.expr(NO_FINDING)
    found = F.flatten(F.array(*(F.when(F.array_contains("todo", r.tag), spans(F.col("text"), r, k)).otherwise(none) for k, r in enumerate(rules))))
    # A path that repeats id and text brings its blob again; the ledger takes it once.
    unseen.select("blob", F.col("todo").alias("scanned"), found.alias("findings")).dropDuplicates(["blob"]).write.mode("append").option("compression", "zstd").parquet(ledger)
    # Findings of these rule versions only; their place among the rules is this run's, whatever it was when they were made.
    rank = (F.array_position(F.array(*map(F.lit, tags)), F.col("x.tag")) - 1).cast("int")
    own = spark.read.schema(LEDGER).parquet(ledger).select("blob", F.explode("findings").alias("x")).where(F.col("x.tag").isin(tags)).select("blob", F.struct("x.start", rank.alias("rank"), "x.stop", "x.kind").alias("x"))
    ours = own.groupBy("blob").agg(F.sort_array(F.collect_set("x")).alias("findings"))
    empty = F.expr("filter(array(named_struct('start', 0, 'rank', 0, 'stop', 0, 'kind', '')), x -> false)")
    return paths.join(ours, "blob", "left").select("doc_id", "blob", F.coalesce("findings", empty).alias("findings"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read_table(spark, sf_dir, "documents"), new_folder(spark, "secret-ledger"))
    text = lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])
    base = ("assign", "access", "hex")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    counts = {f"n_{k}": count(k) for k in base}
    listed = F.array_join(F.transform(F.filter("findings", lambda x: x["kind"].isin(*base)), text), ",")
    return out.withColumns(counts).select("doc_id", *counts, F.sha2(listed, 256).alias("base_sha256"), F.array_join(F.transform("findings", text), ",").alias("spans"))

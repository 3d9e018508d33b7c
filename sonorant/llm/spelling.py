"""Spelling variants by pivotal grams.

Bigrams are ordered by how rare they are over the vocabulary. A word's prefix is its three rarest bigrams (all places of the third
one's kind included); among them, dynamic programming chooses its pivots: the two disjoint ones that are rarest together. One
edit destroys at most one of two disjoint bigrams, and a bigram of one word that survives lies in the other's prefix whenever the
other's prefix reaches as far in the order. So of two words one edit apart, a pivot of one stands in the prefix of the other.

Position limits: with pivots p < q, an edit right of p leaves the word through p as it was, any other edit leaves it from q on as
it was. So a pivot is looked up at its own distance from the unedited end, together with that end's letters. The edit lies in the
first or second half of what remains, so one half of it is equal too and goes into the key. What shares a key is verified.

The global order is a table of pairs of 90 letters, 8,100 rows at most; nothing else leaves the tasks. Spark takes a word's keys for one
row and a stored table for as large as its compressed files, and would broadcast tables many times its limit: joins of those are merges."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.llm.common import materialize, read_table

#: Shortest word, least occurrences, how much more frequent a form is; one deletion where DAMAGE divides the checksum.
LENGTH, LEAST, RATIO, DAMAGE = 7, 2, 10, 31
#: Bigrams of a prefix: 2 for each edit and one.
PREFIX = 3
#: Words that a task counts before it hands counts on.
HELD = 200_000


def occurrences(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text) -> word, n: counts of each task, to be summed."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{length},}}")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                if not text.is_valid:
                    continue
                # bytes.lower() takes A to Z only.
                found = Counter(runs.findall(text.as_py().lower().decode("utf-8", "replace")))
                if doc_id is not None:
                    start = zlib.crc32(b"%d:" % doc_id)
                    for w in [*found]:
                        h = zlib.crc32(w.encode(), start)
                        if h % DAMAGE == 0:
                            k, at = found.pop(w), h % len(w)
                            if len(w) > length:
                                held[w[:at] + w[at + 1 :]] += k
                held.update(found)
                if len(held) > HELD:
                    yield counted(held)
                    held = Counter()
        if held:
            yield counted(held)

    def counted(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(emit, "word string, n long")


def gram_order(words: DataFrame) -> dict[str, int]:
    """Place of each bigram in the order, the rarest first. Letters are a to z and U+00C0 to U+00FF: 8,100 bigrams at most."""
    grams = words.where(F.length("word") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("g"))
    rows = grams.groupBy("g").agg(F.count("*").alias("k")).collect()
    return {r.g: at for at, r in enumerate(sorted(rows, key=lambda r: (r.k, r.g)))}


def prefix_grams(word: str, order: dict[str, int]) -> list[tuple[int, int]]:
    """(order, place) of the word's PREFIX rarest bigrams and of all that are of the last one's kind, by place."""
    grams = [(order[word[i : i + 2]], i) for i in range(len(word) - 1)]
    last = sorted(grams)[PREFIX - 1][0]
    return [g for g in grams if g[0] <= last]


def pivots(grams: list[tuple[int, int]]) -> tuple[int, int]:
    """Places of the two disjoint bigrams that are rarest together: the best pair that ends at each bigram is made of it and the
    best one among those that end before it begins."""
    single, pair, ahead = None, None, 0
    for rank, at in grams:
        while grams[ahead][1] <= at - 2:
            single, ahead = min(single or grams[ahead], grams[ahead]), ahead + 1
        if single and (pair is None or (single[0] + rank, single[1], at) < pair):
            pair = (single[0] + rank, single[1], at)
    return pair[1], pair[2]


def keys(word: str, places: list[tuple[int, int]]) -> Iterator[int]:
    """Keys of (side, place): the unedited end through a bigram (side 0: from the start, 1: from the end) and either half of the
    rest, for words no shorter than this one and for words one letter shorter."""
    n, seen = len(word), (word, word[::-1])
    for side, i in places:
        w, c = seen[side], i + 2 if side == 0 else n - i
        for low in (n, n - 1):
            half = (low - c) // 2
            if low >= c:
                yield xxhash.xxh64_intdigest(f"{side}a{low}.{c}.{w[: c + half]}") - (1 << 63)
            if half > 0:
                yield xxhash.xxh64_intdigest(f"{side}b{low}.{c}.{w[:c]}.{w[n - (low - c - half) :]}") - (1 << 63)


def keyed(words: DataFrame, order: dict[str, int], of_pivots: bool) -> DataFrame:
    """words (word, n) -> key, word, n: the keys of the pivots, or of the prefixes on either side."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                out, row = [], []
                for k, word in enumerate(part.column("word").to_pylist()):
                    grams = prefix_grams(word, order)
                    if of_pivots:
                        p, q = pivots(grams)
                        places = [(0, p), (1, q)]
                    else:
                        places = [(side, i) for _, i in grams for side in (0, 1)]
                    before = len(out)
                    out += {*keys(word, places)}
                    row += [k] * (len(out) - before)
                own = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), own.column("word"), own.column("n")], ["key", "word", "n"])

    return words.mapInArrow(emit, "key long, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """words (word of LENGTH letters or more, n), no word twice -> a, b, a_n, b_n with a < b: each pair one edit apart, once."""
    order = gram_order(words)
    one = keyed(words, order, True).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    other = keyed(words, order, False).select("key", F.col("word").alias("b"), F.col("n").alias("b_n")).hint("merge")
    fits = (F.col("a") != F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    found = one.alias("x").join(other.alias("y"), (F.col("x.key") == F.col("y.key")) & fits)
    first = F.col("a") < F.col("b")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    return found.select(pick("a", "b", "a"), pick("b", "a", "b"), pick("a_n", "b_n", "a_n"), pick("b_n", "a_n", "b_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form), forms not null -> word, root: forms followed to the last. Every step leads to a word RATIO times as
    frequent, so steps are few and none returns; each round doubles those followed."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next")).hint("merge")
        step = materialize(now.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text; other columns are dropped) -> word, form, root, n, n_near, form_n: a row for each word.

    Words are the runs of LENGTH letters (a to z, U+00C0 to U+00FF) or more, A to Z lower-cased, that occur LEAST times or more; in
    one of DAMAGE of (document, run) pairs a letter is missing. Null and empty texts have none; rows of a null id count and lose no
    letters; repeated rows count each. Ties of frequency go to the smaller word in code-point order. Texts and words of any length
    are read whole. An empty table gives an empty one."""
    words = materialize(occurrences(docs).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST), "vocabulary")
    pairs = near_pairs(words)
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    best = pairs.select(sides.alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    far = -F.col("best.less") >= RATIO * F.col("n")
    forms = words.join(best, "word", "left").select("word", F.when(far, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, -F.col("best.less")).alias("form_n"))
    forms = materialize(forms, "forms")
    last = roots(forms.where("form IS NOT NULL").select("word", "form"))
    return forms.join(last.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents"))

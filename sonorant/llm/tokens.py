"""Token ids of whole texts, and their binary files.

Files: documents in ascending doc_id order, each compressed alone by zstandard with one shared dictionary that is trained on
serialized id arrays. A file is
    magic (8 bytes) | SHA-256 of the dictionary (32) | frames | index | footer,
the index has a record (doc_id, offset, length, tokens) for each document, the footer the index's place and record count. A
reader of one short document takes the footer, the index and one frame."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonorant.llm.common import materialize, new_folder, read_table

END_ID = 2
MAGIC, FOOTER = b"SNRTIDS1", "<QQ8s"
RECORD = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("tokens", "<u4")])

#: Documents whose ids train the dictionary, characters of each that it sees, and the dictionary's size.
TRAIN_DOCS, TRAIN_CHARS, DICTIONARY_BYTES = 1000, 4096, 65536
FILE_BYTES = 16 << 20


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: ASCII marks that end a word without touching its ids, letters beyond which composition may matter, bytes of text cut at once.
ENDS, COMBINING, SLICE = ".,;:!?)", re.compile("[\u0300-\U0010ffff]"), 2 << 20
#: How the vocabulary spells bytes: printable ones of Latin-1 by themselves, the others by the next letters from U+0100 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in PRINTABLE)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, by the tokenizers library.

    The tokenizer splits at white space before anything else, so a text's ids are those of its pieces between spaces and line
    feeds, one after the other. Arrow cuts a slice of texts into pieces and numbers the distinct ones; only words that are not
    known yet are encoded, all of a slice in one call, and numpy gathers the ids of all pieces. A piece is a word and the marks
    that end it: marks are a token of their own, so words repeat more than pieces do. Two generations of known words bound the
    memory: a word that returns moves to the younger one."""

    KEPT = 300_000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def parts(piece: str) -> tuple[str, str]:
        """(word, end) with the ids of `piece` one after the other. The tokenizer lower-cases; doing so for A to Z beforehand
        makes words repeat more. Not where a letter may first join a combining mark, nor where a special token's name stands
        or could arise."""
        if "<|" in piece or not piece.isascii() and COMBINING.search(piece):
            return piece, ""
        low = piece.lower() if piece.isascii() else piece.encode().lower().decode()
        word = low.rstrip(ENDS)
        if len(word) == len(low) or not word or not (word[-1].lower().isalpha() or "0" <= word[-1] <= "9"):
            return low, ""
        return word, low[len(word) :]

    def word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word. One of letters alone, none of which can be composed or lower-cased any further, passes the
        tokenizer's steps before the model unchanged but for the spelling of its bytes, so the model is asked at once."""
        out, rest = [], []
        for w in words:
            if w.isalpha() and (w.isascii() or not COMBINING.search(w)) and w == w.lower():
                spelled = w if w.isascii() else w.encode().decode("latin-1").translate(BYTES)
                out.append(np.array([t.id for t in self.tokenizer.model.tokenize(spelled)], "<u4").tobytes())
            else:
                rest.append(w)
                out.append(None)
        found = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        return [np.array(next(found).ids, "<u4").tobytes() if x is None else x for x in out]

    def lookup(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of distinct pieces; pieces and words that an older slice had are moved up."""
        young, old = self.young, self.old
        known = [young.get(p) for p in pieces]
        missed = [k for k, x in enumerate(known) if x is None]
        pairs = {}
        for k in missed:
            p = pieces[k]
            if (x := old.get(p)) is not None:
                young[p] = known[k] = x
            else:
                pairs[k] = self.parts(p)
        new = {x for pair in pairs.values() for x in pair if x not in young}
        young.update((x, old[x]) for x in new if x in old)
        new = [x for x in new if x not in old]
        young.update(zip(new, self.word_ids(new), strict=True))
        for k, (word, end) in pairs.items():
            known[k] = young[word] + young[end]
        young.update((pieces[k], known[k]) for k in pairs if pieces[k].isascii())
        if len(young) >= self.KEPT:
            self.old, self.young = young, {}
        return known

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's ids end). Null is empty: no ids."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        known = self.lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        table = np.frombuffer(b"".join(known), "<u4")
        length = np.fromiter(map(len, known), np.int64, len(known)) // 4
        own = length[codes]
        stop = np.cumsum(own)
        # Where an id stands in the table: its place here, less where its piece starts here, and where that starts there.
        shift = (np.cumsum(length) - length)[codes] - (stop - own)
        out = table[np.repeat(shift, own) + np.arange(stop[-1] if len(stop) else 0)]
        return out, np.concatenate([[0], stop])[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()]

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids. Texts are taken in slices of SLICE bytes, or one longer text."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right")))
            ids, stops = self.ids(texts.slice(at, end - at))
            start = 0
            for stop in stops.tolist():
                yield ids[start:stop].tobytes()
                start = stop
            at = end


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for a worker process: its known words serve all of its tasks."""
    return Encoder(path)


def document_ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids with the end id) of each row of batches of doc_id, text."""
    encode, end = encoder(path), np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
            yield doc_id, ids + end


def train_dictionary(docs: DataFrame, path: str, n_docs: int = TRAIN_DOCS) -> bytes:
    """A dictionary from the ids of the n_docs documents with the least hash of their id: a bounded sample, as it shapes
    the compression and not what is stored. The ids are chosen first, from that column alone; of the chosen documents only
    TRAIN_CHARS characters leave their tasks. Too few documents for training: the raw sample is the
    dictionary."""
    import zstandard

    def first(batches):
        for _, ids in document_ids(batches, path):
            yield pa.RecordBatch.from_arrays([pa.array([ids], pa.binary())], ["ids"])

    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = docs.select("doc_id").orderBy(*order).limit(n_docs).distinct()
    cut = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", F.substring("text", 1, TRAIN_CHARS).alias("text"))
    samples = [bytes(r.ids) for r in cut.orderBy(*order, "text").limit(n_docs).mapInArrow(first, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"\0" * 8


def writer(path: str, folder: str, dictionary: bytes) -> Callable:
    """For mapInArrow over rows of one range of ids in order: writes files, gives a manifest row for each. A task that runs
    twice writes other file names; readers go by the manifest, so its first files are never seen."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)).compress
        part, number = TaskContext.get().partitionId(), 0
        head = MAGIC + hashlib.sha256(dictionary).digest()
        frames: list[bytes] = []
        records: list[tuple] = []
        at = len(head)

        def close() -> pa.RecordBatch:
            nonlocal frames, records, at, number
            name = f"ids-{part:06d}-{number:04d}-{uuid.uuid4().hex}.bin"
            index = np.array(records, RECORD)
            with store.open_output_stream(f"{root}/{name}") as out:
                for x in (head, *frames, index.tobytes(), struct.pack(FOOTER, at, len(records), MAGIC)):
                    out.write(x)
            row = {"part": [part], "number": [number], "name": [name], "docs": [len(records)], "tokens": [int(index["tokens"].sum())]}
            number, frames, records, at = number + 1, [], [], len(head)
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int64()), ("number", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

        for doc_id, ids in document_ids(batches, path):
            frame = pack(ids)
            records.append((doc_id or 0, doc_id is None, at, len(frame), len(ids) // 4))
            frames.append(frame)
            at += len(frame)
            if at >= FILE_BYTES:
                yield close()
        if records:
            yield close()

    return write


def write_ids(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Write the files of docs (doc_id, text; other columns are ignored) into `folder`; returns the manifest: part, number,
    name, docs, tokens, start (tokens in the files before). Null texts have the end id alone, null ids come first, rows
    with equal ids follow one another, an empty table has no files and an empty manifest."""
    path = path or vocabulary_path()
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), dictionary)], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    manifest = ordered.mapInArrow(writer(path, f"{folder}/files", dictionary), "part long, number long, name string, docs long, tokens long")
    manifest = materialize(manifest, "manifest")
    # Running sums over a task's files, and over tasks: the second has one row for each task that wrote.
    up = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", up(Window.orderBy("part")).alias("before"))
    within = manifest.withColumn("start", up(Window.partitionBy("part").orderBy("number")))
    return within.join(tasks, "part").withColumn("start", F.col("start") + F.col("before")).drop("before")


def read_file(content: bytes, dictionary: bytes) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) of each document of a file; the dictionary must be the one that the file names."""
    import zstandard

    start, count, magic = struct.unpack_from(FOOTER, content, len(content) - struct.calcsize(FOOTER))
    if magic != MAGIC or content[: len(MAGIC)] != MAGIC or content[len(MAGIC) : len(MAGIC) + 32] != hashlib.sha256(dictionary).digest():
        raise ValueError("not a file of this format, or of another dictionary")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress
    for doc_id, null, at, length, _ in np.frombuffer(content, RECORD, count, start).tolist():
        yield None if null else doc_id, unpack(content[at : at + length])


def read_document(content: bytes, dictionary: bytes, doc_id: int) -> np.ndarray | None:
    """One document's ids from a file, without unpacking the others."""
    import zstandard

    start, count, _ = struct.unpack_from(FOOTER, content, len(content) - struct.calcsize(FOOTER))
    index = np.frombuffer(content, RECORD, count, start)
    found = np.flatnonzero((index["doc_id"] == doc_id) & (index["is_null"] == 0))
    if not len(found):
        return None
    r = index[found[0]]
    frame = content[int(r["offset"]) : int(r["offset"]) + int(r["length"])]
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress(frame), "<u4")


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The documents of the files that the manifest lists: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first().dictionary)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, start in zip(batch.column("content"), batch.column("start").to_pylist(), strict=True):
                rows = []
                for doc_id, ids in read_file(content.as_py(), dictionary):
                    rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(f"{folder}/files").select("content", F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.join(manifest.select("name", "start"), "name").select("content", "start").mapInArrow(parse, schema)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-ids")
    return read_ids(spark, folder, write_ids(read_table(spark, sf_dir, "documents"), folder))

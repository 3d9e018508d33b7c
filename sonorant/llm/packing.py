"""Bounded-space online packing of token ids into sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.llm.common import materialize, read_table
from sonorant.llm.tokens import document_ids, vocabulary_path

SEQUENCE, OPEN = 4096, 32
#: Partitions whose left-over windows one task merges: at most GROUP * OPEN windows.
GROUP = 8

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
COLUMNS = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")])


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: bytes

    @property
    def length(self) -> int:
        return len(self.ids) // 4


def cut(doc_id: int | None, ids: bytes, sequence: int) -> Iterator[Piece]:
    for at in range(0, len(ids), 4 * sequence):
        yield Piece(doc_id, at // 4, len(ids) // 4, ids[at : at + 4 * sequence])


def place(pieces: Iterator[Piece], sequence: int = SEQUENCE, n_open: int = OPEN) -> Iterator[tuple[bool, list[Piece]]]:
    """(full, window) of each window. A piece goes to the open window that it leaves least room in; where none has room and
    n_open are open, the fullest is emitted and the piece opens one. At the end the open windows follow with full False."""
    open_: list[tuple[int, int, list[Piece]]] = []  # (room, number, pieces), by room
    number = 0
    for piece in pieces:
        n = piece.length
        if n >= sequence:
            yield True, [piece]
            continue
        k = bisect_left(open_, (n,))
        if k < len(open_):
            room, tag, window = open_.pop(k)
            window.append(piece)
            if room == n:
                yield True, window
            else:
                insort(open_, (room - n, tag, window))
            continue
        if len(open_) >= n_open:
            yield True, open_.pop(0)[2]
        insort(open_, (sequence - n, number, [piece]))
        number += 1
    for _, _, window in open_:
        yield False, window


def rows(windows: Iterator[tuple[bool, list[Piece]]], first_id: int, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows of windows, numbered from first_id; those of windows that aren't full carry their ids."""
    out: list[tuple] = []
    for sequence_id, (full, window) in enumerate(windows, first_id):
        at = 0
        for p in window:
            out.append((p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, sequence_id, at, None if full else p.ids))
            at += p.length
        if len(out) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), COLUMNS, strict=True)], schema=COLUMNS)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), COLUMNS, strict=True)], schema=COLUMNS)


def packer(path: str, sequence: int, n_open: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces = (p for doc_id, ids in document_ids(batches, path) for p in cut(doc_id, ids, sequence))
        yield from rows(place(pieces, sequence, n_open), TaskContext.get().partitionId() << 32)

    return run


def refill(pieces: Iterator[Piece], sequence: int) -> Iterator[tuple[bool, list[Piece]]]:
    """Pieces one after the other, cut where a sequence is full: only the last has padding."""
    window: list[Piece] = []
    room = sequence
    for piece in pieces:
        while piece.length > room:
            window.append(piece._replace(ids=piece.ids[: 4 * room]))
            piece = piece._replace(start=piece.start + room, ids=piece.ids[4 * room :])
            yield True, window
            window, room = [], sequence
        window.append(piece)
        room -= piece.length
    if window:
        yield True, window


def merger(sequence: int) -> Callable:
    def run(key, table):
        left = sorted(zip(*(table.column(c).to_pylist() for c in ("sequence_id", "offset", "doc_id", "start", "doc_tokens", "ids")), strict=True), key=lambda r: r[:2])
        pieces = (Piece(doc_id, start, n, ids) for _, _, doc_id, start, n, ids in left)
        return pa.Table.from_batches(list(rows(refill(pieces, sequence), ((1 << 29) + key[0].as_py()) << 32)), COLUMNS)

    return run


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, n_open: int = OPEN) -> DataFrame:
    """docs (doc_id, text; other columns are ignored) -> a row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    Null and empty texts are their end id alone. Longer documents than a sequence are cut at its length. Rows with equal
    ids are packed one by one. An empty table gives an empty table. Each partition keeps n_open windows; what is open at
    its end is merged with that of up to GROUP - 1 other partitions, so a task never holds more than GROUP * n_open windows."""
    packed = materialize(docs.select("doc_id", "text").mapInArrow(packer(path or vocabulary_path(), sequence, n_open), SCHEMA), "packed")
    done = packed.where("ids IS NULL")
    left = packed.where("ids IS NOT NULL").withColumn("g", F.expr(f"(sequence_id >> 32) div {GROUP}"))
    merged = left.groupBy("g").applyInArrow(merger(sequence), SCHEMA)
    return done.unionByName(merged).drop("ids")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))

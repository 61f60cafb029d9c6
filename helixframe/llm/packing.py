"""Harmonic packing of documents into training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.vocab import byte_bpe

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Bits of sequence_id left to a worker's own count.
SEQUENCE_BITS = 36


def cut(tokens: int, capacity: int, slack: float) -> list[int]:
    """Lengths of a document's pieces.

    Full sequences first. A rest whose class (k of them to a bin) would leave
    more than ``slack`` of the bin empty gives up a piece of capacity // (k + 1),
    which fills its own class's bins, until what is left fits well.
    """
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        k = capacity // rest
        if k * rest >= (1 - slack) * capacity:
            out.append(rest)
            break
        part = capacity // (k + 1)
        out.append(part)
        rest -= part
    return out


class Packer:
    """One worker's bins: a piece of class k (capacity // length) joins a bin of exactly k pieces."""

    def __init__(self, worker: int, capacity: int):
        self.capacity, self.next = capacity, worker << SEQUENCE_BITS
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for p in pieces:
            yield (*p, self.next, at)
            at += p[2]
        self.next += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        k = self.capacity // piece[2]
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            del self.open[k]
            yield from self._close(bin_)

    def finish(self) -> Iterator[tuple]:
        """The unfilled bins of all classes, at most one each, largest pieces first into the first that has room."""
        bins: list[list[tuple]] = []
        room: list[int] = []
        for p in sorted((p for b in self.open.values() for p in b), key=lambda p: -p[2]):
            i = next((i for i, r in enumerate(room) if r >= p[2]), None)
            if i is None:
                bins.append([])
                room.append(self.capacity)
                i = len(bins) - 1
            bins[i].append(p)
            room[i] -= p[2]
        for b in bins:
            yield from self._close(b)
        self.open = {}


def pack(docs: DataFrame, path: str, capacity: int = 1024, slack: float = 0.02, end_id: int = 0) -> DataFrame:
    """One row per piece of each document: where it lies in the document and in its sequence.

    A document is its byte-level BPE ids by the file at ``path`` and then
    ``end_id``. Each worker fills its own bins while its rows stream by, so
    nothing is shuffled and a hot source or group of copies costs no more than
    other rows; memory is one unfilled bin per class. Only a worker's last bins
    are padded by more than ``slack``. Null or empty text: one piece, the end id.
    Null doc_id: packed like the rest. Repeated rows are packed each on its own.
    Other columns are ignored. An empty table gives no rows. ``sequence_id`` is
    the worker's number times 2**36 plus a count.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, end = byte_bpe(path), np.array([end_id], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId(), capacity)
        plans: dict[int, list[int]] = {}

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        rows: list[tuple] = []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = bpe.encode(text.as_py() or "") + end
                n, at = len(ids) // 4, 0
                lengths = plans.get(n)
                if lengths is None:
                    lengths = cut(n, capacity, slack)
                    if len(plans) < 100_000:
                        plans[n] = lengths
                for size in lengths:
                    crc = zlib.crc32(ids[4 * at : 4 * (at + size)])
                    rows.extend(packer.add((doc, at, size, crc, n)))
                    at += size
                if len(rows) >= 20_000:
                    yield batch(rows)
                    rows = []
        rows.extend(packer.finish())
        if rows:
            yield batch(rows)

    return source.mapInArrow(run, SCHEMA)

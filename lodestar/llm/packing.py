"""Best-fit packing of token sequences, online and in bounded space.

A document longer than a sequence is cut into full pieces, of which only the first may be shorter; only that one
and whole shorter documents need packing. A packer keeps a fixed number of open bins, listed by free space, and a
bitset of the free spaces that occur: the best fit for a piece is the lowest set bit at or above its length. Where
none fits, a new bin opens; if all are in use the fullest closes first. Every packer takes a share of the pieces in
hashed order and keeps its own open bins, so their number grows with the data and each needs constant memory.

Defined results: null text is empty, one end id long; rows that repeat, or that have no doc_id, are packed each; ties (pieces of
one length, bins of one free space) go to the bin that came to that space last; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .arrays import slices, text_bytes
from .byte_bpe import vocabulary

#: Tokens of a sequence, open bins of a packer, pieces a packer takes.
LENGTH, OPEN_BINS, PACKER_PIECES = 2048, 1024, 50_000


class Packer:
    """Bounded-space best fit: ``place`` gives (bin number, offset)."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS) -> None:
        self.length, self.open_bins = length, open_bins
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]  # open bins by free space
        self.free, self.open, self.made = 0, 0, 0  # the bitset of free spaces, bins open, bins made

    def _take(self, space: int) -> int:
        number = self.bins[space].pop()
        if not self.bins[space]:
            self.free ^= 1 << space
        self.open -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.length, self.made
            self.made += 1
            if self.open == self.open_bins and size < self.length:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
        left = space - size
        if left:
            if not self.bins[left]:
                self.free |= 1 << left
            self.bins[left].append(number)
            self.open += 1
        return number, self.length - space


def pieces(docs: DataFrame, path: str, end_id: int = 0, length: int = LENGTH, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, if asked for)."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for part in slices(source, "text"):
            ids, counts = words.encode_special(*text_bytes(part.column("text")))
            ends = np.cumsum(counts)
            ids = np.insert(ids.astype("<u4"), ends, end_id)
            counts = counts + 1
            number = -(-counts // length)
            doc = np.repeat(np.arange(len(counts)), number)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
            head = (counts - (number - 1) * length)[doc]
            start = np.where(piece == 0, 0, head + (piece - 1) * length)
            size = np.where(piece == 0, head, length)
            at = np.repeat(np.cumsum(counts) - counts, number) + start
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), size.tolist())]
            columns = [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
            for a in range(0, len(doc), 10_000):
                yield pa.RecordBatch.from_arrays([c.slice(a, 10_000) for c in columns], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(items: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, packer_pieces: int = PACKER_PIECES, size_col: str = "length", order_by: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``items`` with sequence_id and offset; ``size_col`` is 1 to ``length``."""
    packers = max(1, -(-items.count() // packer_pieces))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(length, open_bins), TaskContext.get().partitionId() << 40
        for batch in source:
            placed = [packer.place(n) for n in batch.column(size_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns)], pa.array([base + n for n, _ in placed], pa.int64()), pa.array([at for _, at in placed], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    key = F.xxhash64(*order_by)
    dealt = items.repartition(packers, *order_by).sortWithinPartitions(key, *order_by)
    return dealt.mapInArrow(batches, f"{columns}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, **columns) -> DataFrame:
    """The pieces of all documents and where each lies."""
    return pack(stage(pieces(docs, path, **columns), "pieces"))

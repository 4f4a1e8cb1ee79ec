"""Token ids in blocks of an adaptive context-mixing range coder.

For each id the model mixes three predictions. Order 2 is one id: what followed the last two ids in this block (a hashed
table of an id and a confidence each), or, until the block has come to trust that, what follows them most in the segment. It
gets the share of the code space that predictions of its kind and confidence earned in the block so far. Order 1 is a distribution over the ids that follow the last one, with an escape; after an escape, order 0 is a
distribution over all ids. A block of BLOCK_IDS ids is coded on its own and has a CRC: it begins from the first state of its
segment, which is written with the segment (the counts that make orders 1 and 0, quantised, and the segment's order-2
predictions), with an empty order-2 table of its own and the first shares; no block needs another one. Blocks are lanes of
arrays: all blocks of a segment take each step together, when writing as when reading; a shorter block stops at its own end.

A segment (a row of the output, Parquet on any file system) has the ids of some consecutive documents: their doc_ids
and lengths, the first state and the blocks. Files are numbered and segments ordered so that documents ascend by doc_id.

Defined results: null text is empty, one end id long; repeated doc_ids each count, in order of their text; a null
doc_id comes first; an empty table gives no segments; other columns are not read. Ids are below 65,536; others raise ValueError.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .arrays import pack, slices, text_bytes, unpack
from .byte_bpe import vocabulary

BLOCK_IDS, SEGMENT_BYTES = 4096, 24 << 20
#: Slots of a block's order-2 table, steps between updates of the shares, ids that have an order-1 distribution (and are in them).
SLOTS, REFRESH, CONTEXTS = 1024, 64, 4096
#: The segment's order-2 predictions: slots (bits), least share in sixteenths and least count of those kept, confidence from which
#: a block's own prediction goes before the segment's.
SEGMENT_BITS, SURE, SEEN, TRUST = 16, 8, 8, 4
#: Cells of code space: of the shares, of an order-1 distribution at most, of order 0. Least count of a pair of ids in order 1.
SHARE_BITS, PAIR_BITS, SINGLE_BITS, LEAST = 16, 12, 18, 2
#: The coder's interval is below 1 << 52 (float division of such numbers is exact) and gives off 32 bits when it is below 1 << 20.
LOW, OUT = 20, 32
MAGIC = 0x4C535433
#: What a confidence changes by: after a wrong prediction, after a right one.
STEP = np.array([0, 0, *[-2] * 14, *[1] * 15, 0], np.int32)
#: Multiplier of the last code in an order-2 context's hash.
HASH = np.int32(0x9E3B1)
#: Shares of 1 << SHARE_BITS that predictions have at first, by confidence.
FIRST = np.array([1, *[(1 << SHARE_BITS) * (i + 2) // 20 for i in range(15)], *[(1 << SHARE_BITS) * (2 * i + 1) // 32 for i in range(16)]], np.int64)
#: Ids are kept in 16 bits.
MOST_IDS = 1 << 16


def _quantised(counts: np.ndarray, owner: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Whole cells for each count, at least one, summing to ``cells`` of its owner (which has at most half as many entries)."""
    entries, total = np.bincount(owner, minlength=len(cells)), np.bincount(owner, weights=counts, minlength=len(cells))
    size = 1 + np.floor(counts * ((cells - entries) / np.maximum(1, total))[owner]).astype(np.int64)
    left = cells - np.bincount(owner, weights=size, minlength=len(cells)).astype(np.int64)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
    size[first] += left[owner[first]]  # what rounding left goes to the first
    return size


class FirstState:
    """The distributions of orders 1 and 0 that all blocks of a segment begin with.

    Ids have codes by falling frequency. A context is a code below CONTEXTS, or CONTEXTS for all rarer ones and a block's start.
    An entry is a context's successor; the first entry of every context is its escape.
    """

    def __init__(self, ids: np.ndarray, single: np.ndarray, bits: np.ndarray, held: np.ndarray, successor: np.ndarray, size: np.ndarray, follows: np.ndarray | None = None) -> None:
        self.ids, self.single, self.bits, self.held, self.successor, self.size = ids, single, bits, held, successor, size
        first = np.cumsum(held) - held
        ends = np.cumsum(size)
        self.base = np.concatenate([[0], np.cumsum(np.int64(1) << bits)])[:-1]
        self.start = ends - size - np.repeat(self.base, held)
        self.first = first
        #: Of every entry: its first cell << 32 | cells << 16 | successor + 1; of every context: its first cell among all << 5 | bits.
        self.place = self.start << 32 | size << 16 | successor + 1
        self.where = self.base << 5 | bits
        self.follows = np.zeros(1 << SEGMENT_BITS, np.int32) if follows is None else follows  # code << 4 | sixteenths, by slot
        self.codes = np.full(MOST_IDS, len(ids), np.int32)
        self.codes[ids] = np.arange(len(ids))
        self.single_start = np.cumsum(single) - single

    @classmethod
    def learn(cls, ids: np.ndarray, block: int) -> tuple[FirstState, np.ndarray, np.ndarray]:
        """The state that suits ``ids`` in blocks, and the code and entry of each id."""
        count = np.bincount(ids)
        if len(count) > MOST_IDS:
            raise ValueError(f"ids from {MOST_IDS} on have no place in the format")
        by_rank = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
        state = cls(by_rank, np.ones(len(by_rank), np.int64), *[np.zeros(0, np.int64)] * 4)
        code = state.codes.take(ids)
        known = np.minimum(code, CONTEXTS)
        pair = np.empty_like(known)  # context and successor as one number
        np.multiply(known[:-1], CONTEXTS + 1, out=pair[1:])
        pair[::block] = CONTEXTS * (CONTEXTS + 1)
        pair += known
        keys = np.sort(pair)
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        times, keys = np.diff(np.append(at, len(keys))), keys[at].astype(np.int64)
        owner, successor = keys // (CONTEXTS + 1), keys % (CONTEXTS + 1)
        n = np.bincount(owner, weights=times, minlength=CONTEXTS + 1).astype(np.int64)
        bits = np.clip(np.frexp(n.astype(np.float64))[1] - 1, 2, PAIR_BITS)
        kept = (successor < CONTEXTS) & (times >= np.maximum(LEAST, n[owner] >> PAIR_BITS))
        more = np.bincount(owner[kept], minlength=CONTEXTS + 1)
        bits = np.maximum(bits, np.frexp(more.astype(np.float64) + 1)[1] + 1)  # half of the cells at least are for counts
        escaped = n - np.bincount(owner[kept], weights=times[kept], minlength=CONTEXTS + 1).astype(np.int64)
        where = np.concatenate([np.arange(CONTEXTS + 1), owner[kept]])
        order = np.argsort(where, kind="stable")  # the escape comes first
        size = _quantised(np.concatenate([np.maximum(escaped, 0), times[kept]])[order], where[order], np.int64(1) << bits)
        found = cls(by_rank, state.single, bits, np.bincount(where, minlength=CONTEXTS + 1), np.concatenate([np.full(CONTEXTS + 1, -1), successor[kept]])[order], size)
        entry_of = found.first[owner]  # of every pair its entry, which is its context's escape if it has none
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        entry_of[kept] = place[CONTEXTS + 1 :]
        table = np.zeros((CONTEXTS + 1) * (CONTEXTS + 1), np.int32)
        table[keys] = entry_of
        entry = table.take(pair)
        rest = np.bincount(code[found.successor.take(entry) < 0], minlength=len(by_rank))
        found.single = _quantised(rest, np.zeros(len(rest), np.int64), np.array([1 << SINGLE_BITS]))
        found.single_start = np.cumsum(found.single) - found.single
        found.follows = _follows(code, block)
        return found, code, entry

    def to_bytes(self) -> bytes:
        gaps = np.diff(self.successor, prepend=-1)
        gaps[self.first] = 0
        parts = [pack(x.astype(t)) for x, t in ((self.ids, np.uint16), (self.single, np.uint32), (self.bits, np.uint8), (self.held, np.uint16), (gaps, np.uint16), (self.size - 1, np.uint16))]
        slots = np.flatnonzero(self.follows)
        parts += [pack(x.astype(t)) for x, t in ((np.diff(slots, prepend=0), np.uint16), (self.follows[slots] >> 4, np.uint16), (self.follows[slots] & 15, np.uint8))]
        return b"".join(len(p).to_bytes(4, "little") + p for p in parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> FirstState:
        parts, at = [], 0
        for kind in (np.uint16, np.uint32, np.uint8, np.uint16, np.uint16, np.uint16, np.uint16, np.uint16, np.uint8):
            n = int.from_bytes(raw[at : at + 4], "little")
            parts.append(unpack(raw[at + 4 : at + 4 + n], kind).astype(np.int64))
            at += 4 + n
        ids, single, bits, held, gaps, size, slots, codes, sure = parts
        follows = np.zeros(1 << SEGMENT_BITS, np.int32)
        follows[np.cumsum(slots)] = codes << 4 | sure
        run, first = np.cumsum(gaps), np.cumsum(held) - held
        return cls(ids, single, bits, held, run - np.repeat(run[first] + 1, held), size + 1, follows)


def _follows(code: np.ndarray, block: int) -> np.ndarray:
    """Of every slot of the contexts of order 2 the code that follows most and its share in sixteenths; 0 where that is too small or too rare."""
    mixed = np.zeros(len(code), np.int32)  # as ``Shares.learn`` hashes them
    np.multiply(code[:-1], HASH, out=mixed[1:])
    earlier = code[:-2] << 5
    earlier[block - 1 :: block] = 0  # the second id of a block
    mixed[2:] += earlier
    mixed[::block] = 0
    keys = np.sort((mixed >> 7 & (1 << SEGMENT_BITS) - 1).astype(np.uint32) << 16 | code.astype(np.uint32))
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    times, keys = np.diff(np.append(at, len(keys))).astype(np.int64), keys[at].astype(np.int64)
    slot = keys >> 16
    first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
    most = np.maximum.reduceat(times << 16 | keys & 0xFFFF, first)
    best, total = most >> 16, np.add.reduceat(times, first)
    sure = np.minimum(best * 16 // total, 15)
    kept = (sure >= SURE) & (best >= SEEN)
    found = np.zeros(1 << SEGMENT_BITS, np.int32)
    found[slot[first][kept]] = (most[kept] & 0xFFFF) << 4 | sure[kept]
    return found


class Shares:
    """The blocks' order-2 predictions, and the share of the code space each has."""

    def __init__(self, lanes: int, follows: np.ndarray) -> None:
        lane = np.arange(lanes)
        self.lane_slots, self.lane_levels, self.lane_cases = lane * SLOTS, lane * 32, lane * 64
        self.follows = follows
        self.table = np.zeros(lanes * SLOTS, np.int32)  # code << 4 | confidence
        self.share = np.tile(FIRST, lanes)
        self.hash, self.last = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.past, self.steps = np.empty((REFRESH, lanes), np.uint8), 0

    def keep(self, lanes: int) -> None:
        """Goes on with the first ``lanes`` lanes only."""
        for name in ("lane_slots", "lane_levels", "lane_cases", "hash", "last"):
            setattr(self, name, getattr(self, name)[:lanes])
        self.table, self.share, self.past = self.table[: lanes * SLOTS], self.share[: lanes * 32], self.past[:, :lanes]

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """(code predicted, share of 1 << SHARE_BITS)."""
        mixed = self.hash >> 7
        self.slot = (mixed & SLOTS - 1) + self.lane_slots
        self.held = self.table[self.slot]
        self.own = self.held & 15
        known = self.follows[mixed & (1 << SEGMENT_BITS) - 1]
        use = (self.own < TRUST) & (known > 0)
        guess = np.where(use, known, self.held)
        self.level = (guess & 15) + (use << 4)
        return guess >> 4, self.share[self.level + self.lane_levels]

    def learn(self, code: np.ndarray, hit: np.ndarray) -> None:
        """The confidence of the block's own prediction grows by one up to 15 if it was right, else falls by two; below two the code (32 bits) is replaced."""
        self.past[self.steps] = self.level + (hit.astype(np.int32) << 5)
        case = self.own + ((self.held >> 4 == code) & (self.own > 0)).astype(np.int32) * 16
        self.table[self.slot] = np.where(case < 2, code << 4 | 1, self.held + STEP[case])
        self.hash = code * HASH + (self.last << 5)
        self.last = code
        self.steps += 1
        if self.steps == REFRESH:  # a mean in which the past weighs as much as eight predictions
            n = np.bincount((self.past + self.lane_cases).ravel(), minlength=len(self.share) * 2).reshape(-1, 2, 32)
            right = (self.share.reshape(-1, 32) * 8 + (n[:, 1] << SHARE_BITS)) // (8 + n.sum(1))
            self.share = np.clip(right, 1, 15 << SHARE_BITS - 4).ravel()
            self.steps = 0


def _columns(x: np.ndarray, lanes: int, width: int) -> np.ndarray:
    """The values of all lanes at each step; what is beyond the last lane's end isn't coded."""
    full = np.empty(lanes * width, x.dtype)
    full[: len(x)], full[len(x) :] = x, x[-1]
    return np.ascontiguousarray(full.reshape(lanes, width).T)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, list[bytes]]:
    """(the first state, blocks of BLOCK_IDS ids, of which the last may have fewer)."""
    if not len(ids):
        return b"", []
    lanes, width = -(-len(ids) // BLOCK_IDS), min(BLOCK_IDS, len(ids))
    state, code, entry = FirstState.learn(ids, BLOCK_IDS)
    codes, entries = (_columns(x, lanes, width) for x in (code, entry))
    place = state.place << 5 | np.repeat(state.bits, state.held)
    model, tail = Shares(lanes, state.follows), len(ids) - (lanes - 1) * width
    low, span, used = np.zeros(lanes, np.int64), np.full(lanes, 1 << LOW + OUT, np.int64), np.zeros(lanes, np.int64)
    words_of = used  # of all lanes, while ``used`` narrows
    out = np.zeros((lanes, width + 4), np.int64)  # 32-bit words, each with the carries that reach it

    def shift(rows: np.ndarray) -> None:
        at, gone = used[rows], low[rows]
        out[rows, at] = gone >> LOW
        used[rows] = at + 1
        low[rows] = (gone & (1 << LOW) - 1) << OUT
        span[rows] <<= OUT

    def finish(rows: np.ndarray) -> None:
        for _ in range(2):
            shift(rows)

    for t, (now, entry) in enumerate(zip(codes, entries)):
        if t == tail:  # the last block ends here
            finish(np.array([lanes - 1]))
            low, span, used = low[:-1], span[:-1], used[:-1]
            model.keep(lanes - 1)
        now, entry = now[: len(low)], entry[: len(low)]
        guess, share = model.predict()
        edge = (span >> SHARE_BITS) * share
        hit = guess == now
        rows = hit.nonzero()[0]
        kept_low, kept_span = low[rows], edge[rows]
        found = place[entry]
        unit = (span - edge) >> (found & 31)
        low += edge
        low += (found >> 37) * unit
        span = (found >> 21 & 0xFFFF) * unit
        low[rows], span[rows] = kept_low, kept_span
        escape = found & 0xFFFF << 5 == 0
        escape[rows] = False
        rows = escape.nonzero()[0]
        if len(rows):
            shift(rows[span[rows] < 1 << LOW])
            unit = span[rows] >> SINGLE_BITS
            own = now[rows]
            low[rows] += state.single_start[own] * unit
            span[rows] = state.single[own] * unit
        shift((span < 1 << LOW).nonzero()[0])
        model.learn(now, hit)
    finish(np.arange(len(low)))
    for i in range(out.shape[1] - 1, 0, -1):
        over = out[:, i] >> OUT
        if over.any():
            out[:, i - 1] += over
            out[:, i] &= (1 << OUT) - 1
    words, raw, blocks = out.astype("<u4"), np.asarray(ids, "<u4"), []
    for i in range(lanes):
        own = raw[i * width : (i + 1) * width].tobytes()
        blocks.append(b"".join(x.to_bytes(4, "little") for x in (MAGIC, len(own) // 4, width, zlib.crc32(own))) + words[i, : words_of[i]].tobytes())
    return state.to_bytes(), blocks


def decode_blocks(first: bytes, blocks: list[bytes]) -> np.ndarray:
    """The ids of these blocks of one segment, one after another; raises ValueError for a damaged one."""
    if not blocks:
        return np.zeros(0, np.int64)
    heads = np.array([np.frombuffer(b[:16], "<u4") for b in blocks], np.int64)
    if (heads[:, 0] != MAGIC).any() or len(np.unique(heads[:, 2])) > 1:
        raise ValueError("not blocks of token ids of one segment")
    if (heads[:, 1] > heads[0, 2]).any():
        raise ValueError("a block's head is damaged")
    by_length = np.argsort(-heads[:, 1], kind="stable")
    rows = np.empty((len(blocks), int(heads[:, 1].max())), np.int64)
    rows[by_length] = _decode_lanes(FirstState.from_bytes(first), [blocks[i] for i in by_length], heads[by_length, 1])
    ids = []
    for row, n, crc in zip(rows, heads[:, 1].tolist(), heads[:, 3].tolist()):
        ids.append(row[:n])
        if zlib.crc32(ids[-1].astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum differs")
    return np.concatenate(ids)


def _decode_lanes(state: FirstState, blocks: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """The ids of blocks in order of falling length, each as many places long as the longest."""
    lanes, width = len(blocks), int(lengths[0])
    most = max(len(b) for b in blocks) // 4
    words = np.zeros((lanes, most + 4), np.int64)
    for i, b in enumerate(blocks):
        payload = np.frombuffer(b, "<u4", offset=16)
        words[i, : len(payload)] = payload
    flat, at = words.ravel(), np.arange(lanes) * words.shape[1]
    inverse = np.repeat(np.arange(len(state.size), dtype=np.int32), state.size)  # the entry of every cell
    place, where = state.place, state.where
    singles = np.repeat(np.arange(len(state.single), dtype=np.int32), state.single)
    single_start, single = state.single_start, state.single
    code = flat[at] << LOW | flat[at + 1] >> OUT - LOW  # the first 52 bits
    spare = (flat[at + 1] & (1 << OUT - LOW) - 1) << LOW  # of the word that is partly read: its other 12 bits, then 20 of the next
    at = at + 2
    span, model = np.full(lanes, 1 << LOW + OUT, np.int64), Shares(lanes, state.follows)
    out = np.zeros((width, lanes), np.int64)
    context, last_cell = np.full(lanes, CONTEXTS), (1 << np.arange(32)) - 1

    def shift(rows: np.ndarray) -> None:
        here = np.minimum(at[rows], len(flat) - 1)  # a damaged block may run on
        word = flat[here]
        code[rows] = code[rows] << OUT | spare[rows] | word >> OUT - LOW
        spare[rows] = (word & (1 << OUT - LOW) - 1) << LOW
        at[rows] = here + 1
        span[rows] <<= OUT

    for t in range(width):
        if lengths[lanes - 1] <= t:  # the lanes that have an id here
            lanes = int(np.searchsorted(-lengths, -t))
            code, spare, at, span, context = (x[:lanes] for x in (code, spare, at, span, context))
            model.keep(lanes)
        guess, share = model.predict()
        edge = (span >> SHARE_BITS) * share
        hit = code < edge
        rows = hit.nonzero()[0]
        kept_code, kept_span = code[rows], edge[rows]
        at_context = where[context]
        bits = at_context & 31
        unit = (span - edge) >> bits
        code -= edge
        cell = (code / unit).astype(np.int64)  # exact: both are below 1 << 53
        np.minimum(cell, last_cell[bits], out=cell)
        cell[rows] = 0
        cell += at_context >> 5
        found = place[inverse[cell]]
        code -= (found >> 32) * unit
        span = (found >> 16 & 0xFFFF) * unit
        now = (found & 0xFFFF) - 1
        code[rows], span[rows], now[rows] = kept_code, kept_span, guess[rows]
        rows = (now < 0).nonzero()[0]
        if len(rows):
            shift(rows[span[rows] < 1 << LOW])
            unit = span[rows] >> SINGLE_BITS
            own = singles[np.minimum((code[rows] / unit).astype(np.int64), (1 << SINGLE_BITS) - 1)]
            code[rows] -= single_start[own] * unit
            span[rows] = single[own] * unit
            now[rows] = own
        shift((span < 1 << LOW).nonzero()[0])
        out[t, :lanes] = now
        context = np.minimum(now, CONTEXTS)
        model.learn(now.astype(np.int32), hit)
    return state.ids.take(out).T


_segment = [("file", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("first_state", pa.binary()), ("blocks", pa.list_(pa.binary()))]


def write(docs: DataFrame, path: str, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id", files: int | None = None) -> DataFrame:
    """Segments (file, segment, before: the ids before it in its file, n_ids, doc_ids, lengths, first_state, blocks) of all documents in ascending doc_id order; write them as Parquet."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, file, segment, before = vocabulary(path), TaskContext.get().partitionId(), 0, 0
        for part in slices(source, "text", SEGMENT_BYTES):
            got = [words.encode_special(*text_bytes(x.column("text"))) for x in slices(iter([part]), "text")]
            counts = np.concatenate([c for _, c in got])
            ids = np.insert(np.concatenate([i for i, _ in got]), np.cumsum(counts), end_id)
            row = [file, segment, before, len(ids), part.column("doc_id").to_pylist(), (counts + 1).tolist(), *encode_blocks(ids)]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, _segment)], [n for n, _ in _segment])
            segment += 1
            before += len(ids)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.repartitionByRange(files, "doc_id") if files else rows.repartitionByRange("doc_id")
    return rows.sortWithinPartitions("doc_id", "text").mapInArrow(batches, "file int, segment int, before long, n_ids long, doc_ids array<long>, lengths array<long>, first_state binary, blocks array<binary>")


def read(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, file, before (ids before it in its file), n_tokens, ids_crc32 (and ids, if asked for)."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                ids, lengths = decode_blocks(row["first_state"], row["blocks"]), np.array(row["lengths"], np.int64)
                edges = np.concatenate([[0], np.cumsum(lengths)])
                if edges[-1] != len(ids):
                    raise ValueError("a segment's ids and lengths differ")
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(len(lengths), row["file"], np.int32)), pa.array(row["before"] + edges[:-1]), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "file", "before", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return segments.mapInArrow(batches, "doc_id long, file int, before long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def round_trip(docs: DataFrame, path: str, **columns) -> DataFrame:
    """Writes the files, reads them back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    segments = stage(write(docs, path, **columns), "token-files")
    files = segments.groupBy("file").agg(F.sum("n_ids").alias("n"))  # a row per task that wrote
    base = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = files.select(F.col("file").alias("of_file"), base.alias("base"))
    return read(segments).join(F.broadcast(bases), F.col("file") == F.col("of_file")).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")

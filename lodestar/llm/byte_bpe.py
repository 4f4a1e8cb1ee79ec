"""Byte-level BPE, vectorised.

Pre-tokenisation knows no regex. Code points map to classes; a class is a function on the eight states of the
piece being read; functions compose associatively, so blocks of characters are composed side by side, a scan
over the blocks gives the state each begins in, and a boundary is looked up from (state, class, next class).
Pieces are hashed, each distinct one is looked up in a bounded cache, and the unknown ones are merged together,
one pair a piece and step. Offsets of every token into the text's bytes are kept, and decoding gathers the
tokens' bytes.

Defined results: null text is empty and has no ids; an empty table gives an empty result; repeated rows and rows
without a doc_id give a row each; other columns are not read. The vocabulary's path is a parameter and must be readable by executors.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import groups, slices, text_bytes, word_hashes

# classes of code points; AP1/AP2 are apostrophes before a one or two letter ending; FIRST is added to a text's first
LETTER, NUMBER, OTHER, BLANK, SPACE, AP1, AP2, PAD, FIRST = range(9)
# states: what the last character was, or how many characters of an ending are still to come
FRESH, IN_L, IN_N, IN_O, AFTER_BLANK, AFTER_SPACE, END1, END2 = range(8)
#: Characters composed to one function; the most distinct pieces kept; pieces longer than this are merged by a heap, uncached.
BLOCK, CACHE_PIECES, LONG_PIECE = 64, 400_000, 96
_NONE = np.int64(1) << np.int64(40)
#: Slots of the table of pairs, at least twice its entries.
_MASK = np.int64((1 << 20) - 1)


def _slot(key: np.ndarray) -> np.ndarray:
    return (key * np.int64(0x1E3779B97F4A7C15)) >> np.int64(40) & _MASK


def _transitions() -> np.ndarray:
    """[class, state] -> state."""
    step = np.empty((16, 8), np.uint8)
    for c, to in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O), (BLANK, AFTER_BLANK), (SPACE, AFTER_SPACE), (AP1, END1), (AP2, END2), (PAD, FRESH)):
        step[c] = step[FIRST + c] = to
    for c in (AP1, AP2):
        step[c, [IN_O, AFTER_BLANK]] = IN_O
    step[:FIRST, END1], step[:FIRST, END2] = FRESH, END1
    return step


def _boundaries() -> np.ndarray:
    """[class, state, whether a visible character of the same text follows] -> a piece begins here."""
    begins = np.ones((16, 8, 2), bool)
    for c, states in ((LETTER, (IN_L, AFTER_BLANK)), (NUMBER, (IN_N, AFTER_BLANK)), (OTHER, (IN_O, AFTER_BLANK)), (AP1, (IN_O, AFTER_BLANK)), (AP2, (IN_O, AFTER_BLANK))):
        begins[c, list(states)] = False
    for c in (BLANK, SPACE):
        for s in (AFTER_BLANK, AFTER_SPACE):
            begins[c, s] = [False, True]
    begins[:FIRST, [END1, END2]] = False
    return begins


#: Flat tables of class and state (and what follows); the state that a class leads to from states that wait for no ending.
STEP, BEGINS = _transitions().ravel(), _boundaries().ravel()
CONSTANT = np.ascontiguousarray(STEP.reshape(16, 8)[:, FRESH])
CONSTANT[[AP1, AP2, FIRST + AP1, FIRST + AP2]] = END1  # not constant


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        if (k := unicodedata.category(chr(c))[0]) in kinds:
            table[c] = kinds[k]
    for a, b in ((9, 13), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):  # fixed values: Unicode white space
        table[a : b + 1] = SPACE
    table[0x20] = BLANK
    return table


def _compose(columns: np.ndarray) -> np.ndarray:
    """The function of each column of classes: [column, state] -> state."""
    whole = np.broadcast_to(np.arange(8, dtype=np.uint8), (columns.shape[1], 8))
    for row in columns:
        whole = STEP.take(row[:, None] + whole)
    return whole


def states_before(classes: np.ndarray) -> np.ndarray:
    """The state before each character: an exclusive scan of the classes' functions, from FRESH.

    But for states that wait for an ending, a class that opens none is a constant function: its characters need no scan.
    Blocks in reach of an apostrophe that opens one are scanned from the state that the characters before them leave.
    """
    n = len(classes)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, PAD, np.uint8)
    grid[:n] = classes
    out = np.empty(rows * BLOCK, np.uint8)
    out[0], out[1:] = FRESH, CONSTANT.take(grid[:-1])
    opens = np.flatnonzero(CONSTANT.take(classes) == END1)
    if not len(opens):
        return out[:n]
    reached = np.unique(np.concatenate([opens, np.minimum(opens + 3, n - 1)]) // BLOCK)
    blocks = grid.reshape(rows, BLOCK)
    tail = np.ascontiguousarray(blocks[np.maximum(reached - 1, 0), -4:].T) << np.uint8(3)
    whole = _compose(tail)  # mostly a constant, which nothing before can change
    whole[reached == 0] = FRESH
    if (whole != whole[:, :1]).any():
        reached, whole = np.arange(rows), _scan(blocks)
    now = np.ascontiguousarray(whole[:, FRESH])
    columns, got = np.ascontiguousarray(blocks[reached].T) << np.uint8(3), np.empty((BLOCK, len(reached)), np.uint8)
    for t, column in enumerate(columns):
        got[t] = now
        now = STEP.take(column + now)
    out.reshape(rows, BLOCK)[reached] = got.T
    return out[:n]


def _scan(blocks: np.ndarray) -> np.ndarray:
    """The function of all that stands before each block."""
    whole = _compose(np.ascontiguousarray(blocks.T) << np.uint8(3)).copy()
    shift = 1
    while shift < len(blocks):  # inclusive: afterwards row i is the function of blocks 0..i
        whole[shift:] = np.take_along_axis(whole[shift:], whole[:-shift], 1)
        shift *= 2
    return np.concatenate([np.full((1, 8), FRESH, np.uint8), whole[:-1]])


def piece_starts(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each code point of texts of these lengths, laid end to end."""
    classes = code_point_classes()[points]
    ends = np.cumsum(lengths)
    first = (ends - lengths)[lengths > 0]
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        last = ends[np.searchsorted(ends, quote, "right")]
        padded = np.append(points, np.zeros(2, points.dtype))
        one, two = np.where(quote + 1 < last, padded[quote + 1], 0), np.where(quote + 2 < last, padded[quote + 2], 0)
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        classes[quote[pair]] = AP2
        classes[quote[np.isin(one, [ord(c) for c in "stmd"])]] = AP1
    seen = np.append((classes[1:] != BLANK) & (classes[1:] != SPACE), False)
    seen[first[1:] - 1] = False
    classes[first] += FIRST
    return BEGINS.take((classes << np.uint8(4)) + (states_before(classes) << np.uint8(1)) + seen)


class Vocabulary:
    """Tokens' bytes by id, and the pairs that merge: (rank, id of the merged token)."""

    def __init__(self, path: str) -> None:
        if path.endswith(".json"):
            model = json.load(open(path, encoding="utf-8"))
            visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that byte-level BPE writes as themselves
            hidden = [b for b in range(256) if b not in visible]
            byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
            ids = model["model"]["vocab"]
            self.special = [t["content"] for t in model["added_tokens"]]
            self.special_ids = {t["content"].encode(): t["id"] for t in model["added_tokens"]}
            to_bytes = lambda s: bytes(byte_of[c] for c in s)
            tokens = {i: (t.encode() if t in self.special else to_bytes(t)) for t, i in ids.items()}
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
            pairs = [(ids[a], ids[b], rank, ids[a + b]) for rank, (a, b) in enumerate(merges)]
        else:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
            self.special, tokens = [], {i: t for t, i in ranks.items()}
            pairs = [(ranks[t[:i]], ranks[t[i:]], rank, rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        size = max(tokens) + 1
        lengths = np.array([len(tokens.get(i, b"")) for i in range(size)], np.int64)
        self.first = np.concatenate([[0], np.cumsum(lengths)])
        self.pool = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)
        self.byte_ids = np.zeros(256, np.int64)
        for i, t in tokens.items():
            if len(t) == 1:
                self.byte_ids[t[0]] = i
        table = np.array(sorted((a << 20 | b, rank, to) for a, b, rank, to in pairs), np.int64)
        self.keys, self.value = table[:, 0].copy(), np.append(table[:, 1] << 20 | table[:, 2], _NONE)  # place -1: no such pair
        self.slots, slot, todo = np.full(_MASK + 1, -1, np.int32), _slot(self.keys), np.arange(len(self.keys))
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            self.slots[slot[free]] = free
            todo = todo[self.slots[slot[todo]] != todo]
            slot[todo] = (slot[todo] + 1) & _MASK
        self.known = np.zeros(0, np.uint64)  # the cache: sorted hashes of pieces, where their ids are, how many
        self.where, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id of each pair, _NONE where they don't merge."""
        key = a << 20 | b  # negative where either is
        slot = _slot(key)
        found = self.slots[slot]
        while len(again := np.flatnonzero((self.keys[found] != key) & (found >= 0))):  # linear probing
            slot.ravel()[again] = (slot.ravel()[again] + 1) & _MASK
            found.ravel()[again] = self.slots[slot.ravel()[again]]
        return self.value[found]

    def merge_alike(self, tokens: np.ndarray) -> np.ndarray:
        """Merges rows of token ids (padded with -1 at the right): each step takes every row's first pair of least rank."""
        out, rows, width = tokens.copy(), np.arange(len(tokens)), tokens.shape[1]
        if width < 2:
            return out
        now, live = tokens, self.pair(tokens[:, :-1], tokens[:, 1:])
        while True:
            at = live.argmin(1)
            best = live[np.arange(len(rows)), at]
            open_ = best < _NONE
            out[rows[~open_]] = now[~open_]
            rows, at, best, now, live = rows[open_], at[open_], best[open_], now[open_], live[open_]
            if not len(rows):
                return out
            each, later = np.arange(len(rows)), np.arange(width - 1) > at[:, None]
            np.copyto(now[:, :-1], now[:, 1:].copy(), where=later)
            now[:, -1] = -1
            now[each, at] = best & 0xFFFFF
            np.copyto(live[:, :-1], live[:, 1:].copy(), where=later[:, :-1])
            live[:, -1] = _NONE
            inner = at < width - 1
            live[each[inner], at[inner]] = self.pair(now[each[inner], at[inner]], now[each[inner], at[inner] + 1])
            left = at > 0
            live[each[left], at[left] - 1] = self.pair(now[each[left], at[left] - 1], now[each[left], at[left]])

    def merge_long(self, piece: bytes) -> list[int]:
        """One piece of any length in n log n steps."""
        ids: list[int | None] = [int(self.byte_ids[b]) for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)) if n > 1 else []
        heap = [(int(v), i, ids[i], ids[i + 1]) for i, v in enumerate(first) if v < _NONE]
        heapq.heapify(heap)
        one: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n:
                key = (ids[i], ids[j])
                if key not in one:
                    one[key] = int(self.pair(np.array([key[0]]), np.array([key[1]]))[0])
                if one[key] < _NONE:
                    heapq.heappush(heap, (one[key], i, *key))

        while heap:
            value, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = value & 0xFFFFF, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [x for x in ids if x is not None]

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these pieces one after another, how many each has)."""
        lengths = ends - starts
        order = np.argsort(lengths, kind="stable")
        counts, parts = np.zeros(len(starts), np.int64), []
        for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
            for a in range(0, len(rows), 20_000):
                own = rows[a : a + 20_000]
                tokens = self.byte_ids[data[starts[own][:, None] + np.arange(int(lengths[own[0]]))]]
                tokens = self.merge_alike(tokens)
                counts[own] = (tokens >= 0).sum(1)
                parts.append((own, tokens[tokens >= 0]))
        first = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), np.int32)
        for own, got in parts:
            ids[_spread(first[own], counts[own])] = got
        return ids, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids of each text)."""
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(texts, np.int64)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        begins = lead[piece_starts(points, np.diff(np.searchsorted(lead, offsets)))]
        ends = np.append(begins[1:], len(data))
        distinct, place = groups(word_hashes(data, begins, ends, LONG_PIECE + 8))
        sample = np.empty(len(distinct), np.int64)
        sample[place] = np.arange(len(place))
        long_ = np.flatnonzero(ends - begins > LONG_PIECE)
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        new &= (ends - begins)[sample] <= LONG_PIECE
        if new.any():
            if len(self.known) + new.sum() > CACHE_PIECES:  # begin again, with what this slice needs
                self.known, self.where, self.count, self.ids = self.known[:0], self.where[:0], self.count[:0], self.ids[:0]
                new = (ends - begins)[sample] <= LONG_PIECE
            rows = sample[new]
            ids, counts = self.merge(data, begins[rows], ends[rows])
            known = np.concatenate([self.known, distinct[new]])
            order = np.argsort(known, kind="stable")
            self.where = np.concatenate([self.where, len(self.ids) + np.cumsum(counts) - counts])[order]
            self.count, self.known = np.concatenate([self.count, counts])[order], known[order]
            self.ids = np.concatenate([self.ids, ids])
            at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        where, count, pool = (self.where[at], self.count[at], self.ids) if len(self.known) else (np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), self.ids)
        where, count = where.take(place), count.take(place)
        for i in long_.tolist():
            ids = np.array(self.merge_long(data[begins[i] : ends[i]].tobytes()), np.int32)
            where[i], count[i] = len(pool), len(ids)
            pool = np.concatenate([pool, ids])
        until = np.concatenate([[0], np.cumsum(count)])
        ids = pool.take(np.repeat(where - until[:-1], count) + np.arange(until[-1]))
        return ids, np.diff(until[np.searchsorted(begins, offsets)])

    def encode_special(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Like ``encode``, but the vocabulary's special tokens standing in a text become their ids."""
        raw = data.tobytes() if self.special else b""
        cuts = sorted({(m.start(), m.end()) for m in re.finditer(b"|".join(re.escape(t.encode()) for t in self.special), raw)}) if any(t.encode() in raw for t in self.special) else []
        owner = np.searchsorted(offsets, [a for a, _ in cuts], "right") - 1
        cuts = [c for c, o in zip(cuts, owner.tolist()) if c[1] <= offsets[o + 1]]
        if not cuts:
            return self.encode(data, offsets)
        edges = np.unique(np.concatenate([offsets, np.ravel(cuts)]))
        ids, counts = self.encode(data, edges)
        first = np.cumsum(counts) - counts
        keep, at = np.ones(len(ids), bool), np.searchsorted(edges, [a for a, _ in cuts])
        for (a, b), i in zip(cuts, at.tolist()):
            ids[first[i]] = self.special_ids[raw[a:b]]
            keep[first[i] + 1 : first[i] + counts[i]] = False
            counts[i] = 1
        total = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(edges, offsets)]
        return ids[keep], np.diff(total)

    def offsets_of(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The byte in its text at which each token begins."""
        size = self.first[ids + 1] - self.first[ids]
        ends = np.cumsum(size)
        begin = np.cumsum(counts) - counts
        base = np.concatenate([[0], ends])[begin]
        return ends - size - np.repeat(base, counts)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of these ids."""
        return self.pool[_spread(self.first[ids], self.first[ids + 1] - self.first[ids])]


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once in a worker."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, ids array<int>, offsets array<int> (the byte at which each token begins)."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for part in slices(source, "text"):
            ids, counts = words.encode(*text_bytes(part.column("text")))
            edges = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(edges, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(edges, pa.array(words.offsets_of(ids, counts), pa.int32()))], ["doc_id", "ids", "offsets"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``encoded``: doc_id, content binary."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in source:
            content = [words.decode(np.array(ids or [], np.int64)).tobytes() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(content, pa.binary())], ["doc_id", "content"])

    return encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(batches, "doc_id long, content binary")


def round_trip(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encodes and decodes each text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for part in slices(source, "text"):
            ids, counts = words.encode(*text_bytes(part.column("text")))
            edges = np.concatenate([[0], np.cumsum(counts)])
            raw, content = ids.astype("<u4"), words.decode(ids)
            size = np.concatenate([[0], np.cumsum(words.first[ids + 1] - words.first[ids])])[edges]
            hexes = lambda x, at: [hashlib.sha256(x[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(hexes(raw, edges)), pa.array(hexes(content, size))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

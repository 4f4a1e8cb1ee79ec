"""Vectorised helpers on Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a task: a bound on memory, whole texts always stay together.
SLICE_BYTES = 4 << 20
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Fixed odd multipliers of the hashes.
BASE, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Masks of the first n bytes of eight, little-endian.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes hashed at once.
WINDOW = 1 << 17
_CODEC = "zstd"
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``limit`` bytes of text, a text never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(size[stop - 1])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n."""
    global _powers
    if len(_powers[0]) < n:
        _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))]) for x in (BASE, pow(int(BASE), -1, 1 << 64)))
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of data[starts[i]:ends[i]], for spans in order that don't overlap."""
    raw = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # windows that stay in the processor's cache
        base = int(starts[first])
        stop = max(first + 1, int(np.searchsorted(ends, base + WINDOW, "right")))
        width = int(ends[stop - 1]) - base
        up, down = powers(width + 1)
        sums = np.zeros(width + 1, np.uint64)
        np.cumsum((data[base : base + width].astype(np.uint64) + np.uint64(1)) * up[:width], out=sums[1:])
        a, b = starts[first:stop] - base, ends[first:stop] - base
        raw[first:stop] = (sums[b] - sums[a]) * down[a]
        first = stop
    return mix(raw + (ends - starts).astype(np.uint64) * MIX1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """64-bit hashes of the lengths and the first ``most`` bytes of data[starts[i]:ends[i]], eight bytes at a time; for many short spans."""
    padded = np.zeros(len(data) + most + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + most, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    left = ends - starts
    out, rows, at = left.astype(np.uint64) * MIX1, None, starts
    for _ in range(0, most, 8):
        word = eight[at] & _FIRST_BYTES[np.minimum(left, 8)]
        now = (word ^ (out if rows is None else out[rows])) * BASE
        now ^= now >> np.uint64(32)
        if rows is None:
            out, rows = now, np.flatnonzero(left > 8)
            at, left = at[rows] + 8, left[rows] - 8
        else:
            out[rows] = now
            more = left > 8
            rows, at, left = rows[more], at[more] + 8, left[more] - 8
        if not len(rows):
            break
    return mix(out)


def list_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the lists values[starts[i]:ends[i]] of 64-bit numbers."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MIX2)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text number) of the runs of bytes that are not white space, in order."""
    solid = ~SPACES[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys ascending, for each key its place there). One sort of keys packed with positions; full keys decide."""
    n = len(keys)
    if not n:
        return keys, np.zeros(0, np.int64)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = np.sort((keys & ~low) | np.arange(n, dtype=np.uint64))
    at = (packed & low).astype(np.int64)
    ordered = keys[at]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if (ordered[1:] < ordered[:-1]).any():  # some keys differ in their low bits only
        return np.unique(keys, return_inverse=True)
    inverse = np.empty(n, np.int64)
    inverse[at] = np.cumsum(new) - 1
    return ordered[new], inverse


def pack(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of their first, second, ... bytes."""
    raw = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_CODEC, asbytes=True) if raw else b""


def unpack(x: bytes, dtype) -> np.ndarray:
    if not x:
        return np.zeros(0, dtype)
    raw = np.frombuffer(pa.decompress(x[8:], decompressed_size=int.from_bytes(x[:8], "little"), codec=_CODEC, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def range_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def tail(keys: np.ndarray, bits: int, dropped: int = 8) -> np.ndarray:
    """The bits after the range's ``bits``, but for the last ``dropped`` of the rest."""
    return keys << np.uint64(bits) >> np.uint64(dropped)

"""Document fingerprints by Order MinHash.

Every k-mer of a text is numbered by how often it occurred before; the numbered k-mers are hashed into BINS bins, and in
each bin the ROW least are selected, put back in the order they have in the text, and their k-mers hashed as a tuple to
one signature value. An edit changes the tuples whose k-mers it removes, adds or moves, so the share of equal values falls
with the edit distance. One hash of each k-mer serves all bins (one-permutation hashing): time is linear in the text, and
a bin with fewer than ROW k-mers takes those it has. Signatures are alike to the share of equal values among bins that
either text fills.

The query's edited text needs each document's successor in descending doc_id order. Documents are dealt into ranges whose
bounds are quantiles of doc_id; the first document of a range is sent to the range before it as well (of the first range:
to the last), so one shuffle brings every document beside its successor.

Defined results: null text is empty (its fingerprint has only empty bins and is like itself); rows with equal doc_id are
ordered by text; a null doc_id comes last; a single row follows itself; very long texts are whole, in time linear in their length; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import task_count
from .arrays import BASE, MIX1, mix

#: Code points of a k-mer, bins (a power of two), k-mers selected in each, rows of a range at most (unless ids tie).
K, BINS, ROW, RANGE_ROWS = 5, 64, 2, 20_000
_U = np.uint64
_SPREAD = _U(0xD6E8FEB86659FD93)
_K_POWERS = [_U(pow(int(BASE), i, 1 << 64)) for i in range(64)]


def _numbered(kmers: np.ndarray) -> np.ndarray:
    """How often each k-mer occurred before."""
    n = len(kmers)
    bits = _U(max(1, (n - 1).bit_length()))
    low = (_U(1) << bits) - _U(1)
    packed = np.sort((kmers & ~low) | np.arange(n, dtype=_U))
    at = (packed & low).astype(np.int64)
    ordered = kmers[at]
    if (ordered[1:] < ordered[:-1]).any():  # some differ in their low bits only
        at = np.argsort(kmers, kind="stable")
        ordered = kmers[at]
    first = np.zeros(n, np.int64)
    new = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    first[new] = new
    out = np.empty(n, _U)
    out[at] = (np.arange(n) - np.maximum.accumulate(first)).astype(_U)
    return out


def fingerprint(text: str, k: int = K, bins: int = BINS, row: int = ROW) -> np.ndarray:
    """The signature: a 32-bit value for each bin, 0 for an empty one."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(_U)
    out = np.zeros(bins, np.uint32)
    if not len(points):
        return out
    n = max(1, len(points) - k + 1)  # a text shorter than k is one k-mer
    kmers = np.zeros(n, _U)
    for i in range(min(k, len(points))):
        kmers += (points[i : i + n] + _U(1)) * _K_POWERS[i]
    kmers = mix(kmers)
    keys = mix(kmers + _numbered(kmers) * _SPREAD)
    bits = _U(bins.bit_length() - 1)
    where = None
    if n > 40 * bins * row:  # few of them can be among the least: first look below a bound, in all bins at once
        bound = _U(int(2.0**64 * 12 * bins * row / n))
        where = np.flatnonzero((keys << bits) < bound)
        if (np.bincount((keys[where] >> (_U(64) - bits)).astype(np.int64), minlength=bins) < row).any():
            where = None
    if where is None:
        where = np.arange(n)
    where = where[np.argsort(keys[where], kind="stable")]
    place = (keys[where] >> (_U(64) - bits)).astype(np.int64)
    first = np.searchsorted(place, np.arange(bins + 1))
    held = np.minimum(np.diff(first), row)
    taken = np.full((bins, row), np.iinfo(np.int64).max)
    for j in range(row):
        own = held > j
        taken[own, j] = where[first[:-1][own] + j]
    taken.sort(1)  # back to text order
    value = held.astype(_U)
    for j in range(row):
        own = held > j
        value[own] = mix(value[own] * MIX1 + kmers[taken[own, j]])
    out[:] = (value >> _U(32)).astype(np.uint32) | 1
    out[held == 0] = 0
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a != 0) | (b != 0)
    return float((a[filled] == b[filled]).mean()) if filled.any() else 1.0


def to_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = K, bins: int = BINS, row: int = ROW) -> DataFrame:
    """One row per document: doc_id, fingerprint string (eight hexadecimal digits a bin)."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            signs = [to_text(fingerprint(t or "", k, bins, row)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signs, pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(batches, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def beside_successor(docs: DataFrame, ranges: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, text, range, guest), sorted so that within a range each row is followed by its successor; guests are the first rows of the next range."""
    ranges = ranges or max(task_count(docs.sparkSession), -(-docs.count() // RANGE_ROWS))
    lowest = -(1 << 63)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(lowest))
    found = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges).alias("q")).first()["q"] or []
    bounds = -np.unique(np.array(found, np.int64))[::-1].astype(object) if found else np.zeros(0, object)  # ascending in descending ids
    bounds = np.array([min(int(b), (1 << 63) - 1) for b in bounds], np.int64)

    def range_of(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = np.asarray(ids.fill_null(lowest), np.int64)
        return np.searchsorted(bounds, -np.maximum(ids, lowest + 1), "left"), ids

    def heads(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            part, ids = range_of(batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(ids)], ["part", "id"])

    first = {r["part"]: r["id"] for r in rows.select("doc_id").mapInArrow(heads, "part long, id long").groupBy("part").agg(F.max("id").alias("id")).collect()}  # a row per range
    parts = sorted(first)
    before = {p: parts[i - 1] for i, p in enumerate(parts)}

    def deal(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            part, ids = range_of(batch.column("doc_id"))
            guests = np.flatnonzero(ids == np.array([first[p] for p in part.tolist()], np.int64)) if len(part) else part
            take = np.concatenate([np.arange(len(part)), guests])
            to = np.concatenate([part, [before[p] for p in part[guests].tolist()]]).astype(np.int64)
            guest = np.arange(len(take)) >= len(part)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(take)) for c in batch.columns], pa.array(to), pa.array(guest)], ["doc_id", "text", "range", "guest"])

    dealt = rows.mapInArrow(deal, "doc_id long, text string, range long, guest boolean")
    return dealt.repartition(ranges, "range").sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), "text")


def edited_likeness(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """The fingerprint of each text, of its edited text (the last third replaced by the next document's beginning), and their likeness."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, doc_id, text, signature) whose successor is still to come
        for batch in source:
            out: list[tuple] = []
            for doc_id, text, part, guest in zip(*[c.to_pylist() for c in batch.columns]):
                if guest and held is None:
                    continue
                sign = fingerprint(text)
                if held is not None and held[0] == part:
                    _, own_id, own, own_sign = held
                    cut = len(own) // 3
                    edited = own[: len(own) - cut] + text[:cut]
                    edited_sign = fingerprint(edited)
                    out.append((own_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), to_text(own_sign), to_text(edited_sign), likeness(own_sign, edited_sign), likeness(own_sign, sign)))
                held = None if guest else (part, doc_id, text, sign)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return beside_successor(docs, ranges, text_col, id_col).mapInArrow(batches, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

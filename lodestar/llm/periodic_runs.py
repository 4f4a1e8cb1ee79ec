"""Periodic runs of words by bit-parallel lags.

A text's words are numbered, and bit b of all numbers is one big integer, a bit plane. For a lag q every plane is XORed with
itself shifted by q, and the ORed mismatches are zero just where word i equals word i + q. A run of period q and length L is a
stretch of L - q zeros; shift-doubling ANDs (by 1, 2, 4, ... places) of the complement leave a bit only where a stretch of the
needed length begins. A stretch that a smaller lag has found already, start and length alike, has that smaller period
(periodicity lemma), so lags ascend and the first one to find a stretch keeps it.

Lags below DENSE_LAGS are all tried. A longer one, of m to 2 m - 1 words, needs m matches in a row, which hold a whole block of
m / 2 words that begins at a multiple of m / 2; such blocks' hashes are compared with those at every lag of the octave, and only
lags at which some block recurs are tried. That excludes no lag: equal blocks have equal hashes. Blocks inside a run found
before, whose period isn't longer than the block, are left out, since the lags they recur at are that period's multiples. So a
text of n words costs n log n steps, and n / 64 for each lag tried.

Defined results: null text is empty and has no run; each row is worked on by itself, so repeated rows, ties and null doc_ids
change nothing; an empty table gives an empty result; other columns are not read. Whole texts, of any length, stay together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import mix
from .names import column

#: A run's least words and least number of periods.
LEAST_WORDS, LEAST_PERIODS = 12, 2
#: Lags below are tried on every text; planes that decide whether the others are looked at.
DENSE_LAGS, FIRST_PLANES = 32, 4
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def planes(ids: np.ndarray) -> list[int]:
    """Bit b of ids[i] is bit i of planes[b]."""
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(bool), bitorder="little").tobytes(), "little") for b in range(int(ids.max()).bit_length() if len(ids) else 0)]


def stretches(mismatch: int, places: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of the maximal stretches of at least ``least`` zeros among the first ``places`` bits."""
    left, have = ~mismatch & ((1 << places) - 1), 1
    while have < least and left:
        step = min(have, least - have)
        left &= left >> step
        have += step
    if not left:
        return []
    bits = np.unpackbits(np.frombuffer(left.to_bytes(places // 8 + 1, "little"), np.uint8), bitorder="little")
    edges = np.flatnonzero(np.diff(bits, prepend=np.uint8(0), append=np.uint8(0)))
    return [(int(a), int(b - a) + least - 1) for a, b in zip(edges[::2], edges[1::2])]


def _lags(names: np.ndarray, n: int, octave: int, ends: np.ndarray) -> np.ndarray:
    """The lags from ``octave`` to twice that, at which a block recurs. ``names``: hashes of the octave / 2 words from each word on; ``ends``: where the farthest run that begins at or before a word ends."""
    block = octave // 2
    starts = np.arange(0, len(names) - octave, block)
    window = np.lib.stride_tricks.sliding_window_view(np.append(names, np.zeros(octave, np.uint64)), octave)[starts + octave]
    lags = np.arange(octave, 2 * octave)
    to = starts[:, None] + lags
    met = (window == names[starts][:, None]) & (to < len(names)) & (to + block > ends[starts][:, None])
    return lags[met.any(axis=0) & (lags <= n // LEAST_PERIODS)]


def find_runs(ids: np.ndarray, dense: int = DENSE_LAGS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers from 0, by start, then period. ``dense``, a power of 2 from 16: lags that are all tried."""
    n, bits, found = len(ids), planes(ids), {}

    def attempt(q: int) -> None:
        places, least = n - q, max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q)
        if places < least:
            return
        mismatch, todo = 0, bits
        for part in (bits[:FIRST_PLANES], bits[FIRST_PLANES:]):
            for plane in part:
                mismatch |= plane ^ plane >> q
            todo = stretches(mismatch, places, least)
            if not todo:
                return
        for start, zeros in todo:
            found.setdefault((start, zeros + q), q)

    for q in range(1, min(dense, n // LEAST_PERIODS + 1)):
        attempt(q)
    names, have, octave = mix(ids.astype(np.uint64)), 1, dense
    while octave <= n // LEAST_PERIODS:
        while 2 * have < octave:  # names of ``have`` words become names of twice as many
            names, have = mix(names[:-have] * np.uint64(3) + names[have:]), 2 * have
        ends = np.zeros(n, np.int64)
        for (start, length), q in found.items():
            if q <= octave // 2:
                ends[start] = max(ends[start], start + length)
        for q in _lags(names, n, octave, np.maximum.accumulate(ends)).tolist():
            attempt(q)
        octave *= 2
    return sorted((start, length, q) for (start, length), q in found.items())


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def _runs(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        counts, found, collapsed = [], [], []
        for text in batch.column("text").to_pylist():
            words, numbers = WORD.findall(text or ""), {}
            ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
            runs = find_runs(ids)
            counts.append(len(words))
            found.append([{"start": a, "length": b, "period": q} for a, b, q in runs])
            collapsed.append(" ".join([w for w, keep in zip(words, kept(len(words), runs)) if keep] if runs else words))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period in words, by start, then period) and collapsed, the text of the words that stay when each run keeps only its first period."""
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_runs, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def made_periodic(doc_id: Column, text: Column) -> Column:
    """The text whose words repeat from a place on, for a tenth of the ids: with h the CRC-32 of the id's digits and g = h // 10, h % 10 = 0, word i >= a = g % n becomes word a + (i - a) % p, where p = 1 + (n - a) // (3 + g % 8). Other texts, those without words, and those of null ids stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def edited(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    chosen = F.when(h % 10 == 0, words)
    once = F.get(F.transform(F.array(chosen), edited), F.lit(0))  # the words as a lambda's variable are made once, not again for each word
    return F.when(F.size(chosen) > 0, once).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), its exponent in thousandths, and SHA-256 of all runs and of the collapsed text, from the rows of ``periodic_runs``."""
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"], r["length"]))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", F.col("r.start").alias("start"), F.col("r.length").alias("length"), F.col("r.period").alias("period"), F.floor(1000 * F.col("r.length") / F.col("r.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

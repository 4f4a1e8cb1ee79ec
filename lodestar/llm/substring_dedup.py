"""Substring dedup by content-defined chunking.

A gear hash rolls over the last WINDOW bytes; a chunk ends with a word at whose last byte the hash is in the lowest
1/MEAN_WORDS of its values, or after MAX_WORDS words, so the same passage is cut alike wherever it stands, whatever comes before
it. White space counts only as what parts words. Windows of consecutive chunks, the shortest of LEAST_WORDS words from each
chunk on and up to each chunk, are compared by 64-bit digest over all documents: blocks of texts ask the owner of each
digest range how many documents have a window and which two come first. A passage is a chain of windows that one other
document has, the least that has them; a passage of over 50 repeated words loses a chunk at either end at most, so it is
found. A window's first document is the least that has all of it, whoever has its single chunks. Where one document has a
part of a passage and another one the rest, each gets its own row and rows may overlap. In text that repeats itself (a word
a hundred times) a row may be longer than the other document's copy, but every window of it is there.

Blocks ask for distinct digests only, so a passage in every document costs one entry a block. Of a digest 56 bits
travel beside its range's number. Defined results: null text is empty; repeats inside one doc_id only don't count; rows
with a null doc_id are one document; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .arrays import groups, list_hashes, mix, pack, range_of, slices, span_hashes, tail, text_bytes, unpack, words
from .names import column, fresh

#: Bytes that the hash sees, words of a mean chunk and of the longest, least words of a passage, bytes of text in a block, chunks a range stands for.
WINDOW, MEAN_WORDS, MAX_WORDS, LEAST_WORDS, BLOCK_BYTES, RANGE_CHUNKS = 16, 3, 16, 25, 8 << 20, 1_000_000
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
_NULL = (1 << 63) - 1


def chunks(data: np.ndarray, offsets: np.ndarray, mean_words: int = MEAN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends in bytes, words, text number, digest) of the chunks. White space counts only as what parts words."""
    starts, ends, owner = words(data, offsets)
    if not len(starts):
        return starts, ends, starts, owner, np.zeros(0, np.uint64)
    lengths = ends - starts
    solid = np.zeros(len(data) + 1, np.int8)
    solid[starts] += 1
    solid[ends] -= 1
    bare = data[np.cumsum(solid[:-1], dtype=np.int8) > 0]
    stop = np.cumsum(lengths)
    fresh = np.append(True, owner[1:] != owner[:-1])
    begin = (stop - lengths)[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]  # where the word's text begins
    rolled = np.zeros(len(ends), np.uint16)
    for back in range(WINDOW):
        at = stop - 1 - back
        rolled += np.where(at >= begin, GEAR[bare[np.maximum(at, 0)]], np.uint16(0)) << np.uint16(back)
    last = rolled < 65536 // mean_words
    last[:-1] |= fresh[1:]
    last[-1] = True
    place = np.arange(len(last))
    natural = np.maximum.accumulate(np.append(0, np.where(last, place + 1, 0)[:-1]))
    last |= (place - natural + 1) % MAX_WORDS == 0  # text that repeats itself may have no boundary of its own
    final = np.flatnonzero(last)
    first = np.concatenate([[0], final[:-1] + 1])
    return starts[first], ends[final], final - first + 1, owner[final], list_hashes(span_hashes(data, starts, ends), first, final + 1)


def windows(n: np.ndarray, counts: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first chunk, chunk after the last) of each text's windows in order: the shortest of ``least_words`` words from each chunk on and up to each chunk. ``n`` words of each chunk, ``counts`` chunks of each text."""
    until, place = np.append(0, np.cumsum(n)), np.arange(len(n))
    after = np.cumsum(counts)
    stop = np.searchsorted(until, until[:-1] + least_words)
    start = np.searchsorted(until, until[1:] - least_words, "right") - 1
    onward, back = stop <= np.repeat(after, counts), start >= np.repeat(after - counts, counts)
    keys = np.unique(np.concatenate([place[onward] * (len(n) + 1) + stop[onward], start[back] * (len(n) + 1) + place[back] + 1]))
    return keys // (len(n) + 1), keys % (len(n) + 1)


def _blocks(docs: DataFrame, text_col: str, id_col: str, mean_words: int, window_words: int) -> DataFrame:
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.binary()), ("asked", pa.binary()), ("digests", pa.binary()), ("codes", pa.binary()), ("words", pa.binary()), ("starts", pa.binary()), ("lengths", pa.binary()), ("windows", pa.int64())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for block in slices(source, "text", BLOCK_BYTES):
            got: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for part in slices(iter([block]), "text"):
                data, offsets = text_bytes(part.column("text"))
                a, b, n, owner, digest = chunks(data, offsets, mean_words)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                counts = np.bincount(owner, minlength=part.num_rows)
                begin, stop = windows(n, counts, window_words)
                for column, x in zip(got, (list_hashes(digest, begin, stop), n, points[a] - points[offsets[owner]], points[b] - points[a], counts, np.bincount(owner[begin], minlength=part.num_rows))):
                    column.append(x)
            hashes, n, start, length, counts, asked = map(np.concatenate, got)
            distinct, codes = groups(hashes)
            row = [number, block.column("doc_id").fill_null(_NULL).to_pylist(), pack(counts.astype(np.uint32)), pack(asked.astype(np.uint32)), pack(np.diff(distinct, prepend=np.uint64(0))), *[pack(x.astype(np.uint32)) for x in (codes, n, start, length)], len(hashes)]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)
            number += 1

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(batches, "block long, doc_ids array<long>, counts binary, asked binary, digests binary, codes binary, words binary, starts binary, lengths binary, windows long")


def _requests(bits: int):
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("first", pa.binary()), ("second", pa.binary())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                digests, codes = np.cumsum(unpack(row["digests"], np.uint64)), unpack(row["codes"], np.uint32).astype(np.int64)
                if not len(codes):
                    continue
                ids, rank = np.unique(np.array(row["doc_ids"], np.int64), return_inverse=True)
                doc = np.repeat(rank, unpack(row["asked"], np.uint32))
                pairs = np.sort(codes * len(ids) + doc)
                pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
                code = pairs // len(ids)
                begin = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                docs, first = np.bincount(code).astype(np.uint32), ids[pairs[begin] % len(ids)]
                second = ids[pairs[np.minimum(begin + 1, len(pairs) - 1)] % len(ids)]
                parts = range_of(digests, bits)
                edges = np.flatnonzero(np.diff(parts, prepend=-1, append=-1))
                columns: list[list] = [[] for _ in schema]
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    for column, value in zip(columns, (int(parts[a]), row["block"], pack(np.diff(tail(digests[a:b], bits), prepend=np.uint64(0))), pack(docs[a:b]), pack(first[a:b]), pack(second[a:b][docs[a:b] > 1]))):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return batches


def _answer(table: pa.Table) -> pa.Table:
    """All requests of a range: for each block the documents of its digests in its order, and of shared ones the first two documents."""
    rows = table.to_pylist()
    keys = [np.cumsum(unpack(r["keys"], np.uint64)) for r in rows]
    docs = np.concatenate([unpack(r["docs"], np.uint32) for r in rows])
    ids = np.concatenate([unpack(r[c], np.int64) for c in ("first", "second") for r in rows])
    distinct, place = groups(np.concatenate(keys) << np.uint64(8))
    where = np.concatenate([place, place[docs > 1]])
    # a document whose rows are in several blocks counts once: only a second document proves that a digest is shared
    docs = np.bincount(place, weights=docs, minlength=len(distinct)).astype(np.uint32)
    least, second, shared = np.full(len(distinct), _NULL), np.full(len(distinct), _NULL), np.zeros(len(distinct), bool)
    np.minimum.at(least, where, ids)
    later = ids > least[where]
    np.minimum.at(second, where[later], ids[later])
    shared[where[later]] = True
    docs[~shared] = 1
    told, edge, out = docs[place], 0, [[], [], [], [], []]
    for r, n in zip(rows, map(len, keys)):
        own = place[edge : edge + n]
        many = own[told[edge : edge + n] > 1]
        for column, value in zip(out, (r["block"], r["part"], pack(told[edge : edge + n]), pack(least[many]), pack(second[many]))):
            column.append(value)
        edge += n
    return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "part", "docs", "first", "second"])


def _passages(least_words: int, window_words: int, whole: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64()), ("n_chunks", pa.int64()), ("n_docs", pa.int64()), ("first_doc_id", pa.int64()), ("first", pa.bool_())])

    def passages(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in schema]
        told = sorted(answers.to_pylist(), key=lambda r: r["part"])
        for row in blocks.to_pylist():
            codes = unpack(row["codes"], np.uint32)
            if not len(codes):
                continue
            docs = np.concatenate([unpack(r["docs"], np.uint32) for r in told])
            first, second = np.full(len(docs), _NULL), np.full(len(docs), _NULL)
            for column, x in (("first", first), ("second", second)):
                x[docs > 1] = np.concatenate([unpack(r[column], np.int64) for r in told])
            docs, first, second = docs[codes].astype(np.int64), first[codes], second[codes]
            n, start, length, counts = (unpack(row[c], np.uint32).astype(np.int64) for c in ("words", "starts", "lengths", "counts"))
            a, b = windows(n, counts, window_words)
            until = np.append(0, np.cumsum(n))
            ids = np.array(row["doc_ids"], np.int64)
            doc = np.repeat(np.arange(len(ids)), counts)[a]
            shared = docs > 1
            follows = np.zeros(len(codes), bool)
            follows[1:] = shared[1:] & shared[:-1] & (doc[1:] == doc[:-1])
            if whole:
                other = np.where(first == ids[doc], second, first)
                follows[1:] &= other[1:] == other[:-1]
            begin = np.flatnonzero(shared & ~follows)
            if not len(begin):
                continue
            run = np.cumsum(shared & ~follows) - 1
            last = begin + np.bincount(run[shared]) - 1
            total = until[b[last]] - until[a[begin]]
            keep = np.flatnonzero(total >= least_words)
            lowest = np.minimum.reduceat(np.where(shared, first, _NULL), begin)
            most = np.maximum.reduceat(np.where(shared, docs, 0), begin)
            highest = np.maximum.reduceat(np.where(shared, first, -(1 << 63)), begin)
            own = ids[doc[begin]]
            for column, x in zip(out, (own, start[a[begin]], start[b[last] - 1] + length[b[last] - 1], total, b[last] - a[begin], most, lowest, (lowest == own) & (highest == own))):
                column += x[keep].tolist()
        back = lambda x: [None if v == _NULL else v for v in x]
        out[0], out[6] = back(out[0]), back(out[6])
        return pa.table([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    return passages


def _found(docs: DataFrame, text_col: str, id_col: str, least_words: int, mean_words: int, window_words: int, whole: bool) -> DataFrame:
    blocks = stage(_blocks(docs, text_col, id_col, mean_words, window_words), "chunk-blocks")
    total = blocks.agg(F.coalesce(F.sum("windows"), F.lit(0)).alias("n")).first()["n"]
    bits = int(total // RANGE_CHUNKS).bit_length()
    requests = blocks.select("block", "doc_ids", "asked", "digests", "codes").mapInArrow(_requests(bits), "part long, block long, keys binary, docs binary, first binary, second binary")
    answers = requests.groupBy("part").applyInArrow(_answer, "block long, part long, docs binary, first binary, second binary")
    payload = blocks.select("block", "doc_ids", "counts", "codes", "words", "starts", "lengths")
    return payload.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_passages(least_words, window_words, whole), "doc_id long, start long, end long, n_words long, n_chunks long, n_docs long, first_doc_id long, first boolean")


def repeated_passages(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_words: int = LEAST_WORDS, mean_words: int = MEAN_WORDS) -> DataFrame:
    """One row per run of chunks each of which some other document has, not all of them the same one: candidates, of which ``whole_passages`` verifies what one document has. doc_id, start, end (code points, end exclusive), n_words, n_chunks, n_docs (most documents with one of its chunks), first_doc_id (the least such doc_id) and first (whether this document is the first with each of its chunks)."""
    return _found(docs, text_col, id_col, least_words, mean_words, 1, False)


def whole_passages(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_words: int = LEAST_WORDS, mean_words: int = MEAN_WORDS) -> DataFrame:
    """One row per passage of a document that another document has as well: doc_id, start, end (code points, end exclusive), n_words, n_chunks, n_docs (most documents with one of its windows), first_doc_id (the least that has all of it) and first (whether that is this document)."""
    return _found(docs, text_col, id_col, least_words, mean_words, least_words, True)


def _cuts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document the spans in passages that it isn't the first to have, without what lies in one that it is."""
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in source:
        gone = []
        for spans in batch.column("spans").to_pylist():
            spans.sort(key=lambda x: x["start"])
            kept, cut = [x for x in spans if x["first"]], []
            for x in spans:
                if x["first"]:
                    continue
                at = max(x["start"], cut[-1]["end"] if cut else 0)
                for k in [*kept, {"start": x["end"], "end": x["end"]}]:
                    if at < (stop := min(k["start"], x["end"])):
                        cut.append({"start": at, "end": stop})
                    at = max(at, k["end"])
            gone.append(cut)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(gone, shape)], ["doc_id", "_gone"])


def without_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with every passage cut from the text of all documents but the first that has it, which keeps all of it. Rows whose doc_id is null or has several texts stay whole: no span says which text it is of."""
    spans = whole_passages(docs, text_col, id_col, **options).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "first")).alias("spans"))  # bounded by the text
    names = {n: fresh(docs, f"_{n}") for n in ("gone", "edges", "id")}
    text, own = column(text_col), column(id_col).cast("long")
    several = docs.groupBy(own.alias("doc_id")).agg((F.min(F.xxhash64(text)) != F.max(F.xxhash64(text))).alias("several")).filter("several").select("doc_id")
    gone = spans.mapInArrow(_cuts, "doc_id long, _gone array<struct<start: long, end: long>>").filter("size(_gone) > 0 AND doc_id IS NOT NULL").join(several, "doc_id", "left_anti")
    gone = gone.select(F.col("doc_id").alias(names["id"]), F.col("_gone").alias(names["gone"]))
    cut, edges = F.col(names["gone"]), F.col(names["edges"])
    starts_and_ends = F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform(cut, lambda s: F.array(s["start"], s["end"]))))
    edge = lambda i: F.element_at(edges, i.cast("int"))
    until = lambda i: F.coalesce(F.try_element_at(edges, (2 * i + 2).cast("int")), F.length(text).cast("long"))
    pieces = F.transform(F.sequence(F.lit(0), F.size(cut)), lambda i: F.substring(text, (edge(2 * i + 1) + 1).cast("int"), (until(i) - edge(2 * i + 1)).cast("int")))
    joined = docs.join(gone, own == F.col(names["id"]), "left").withColumn(names["edges"], starts_and_ends)
    return joined.select(*[F.when(cut.isNull(), text).otherwise(F.concat_ws("", pieces)).alias(c) if c == text_col else column(c) for c in docs.columns])

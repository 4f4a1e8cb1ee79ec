"""SCL-8, WIN-4, JOIN-7: chunking with exact code-point offsets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sizes in tokens, characters of a token, separators from the coarsest to the finest.
SIZE, OVERLAP, TOKEN_CHARS = 512, 64, 4
SEPARATORS = ("\n\n", "\n", ". ", " ")


def fragments(text: str, limit: int, separators: tuple[str, ...] = SEPARATORS, base: int = 0) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces of at most ``limit`` characters, cut at the coarsest separator that serves.

    A piece grows part by part, with the separator between; a part too long by itself is cut by the finer separators; what has
    no separator left is cut by length. A piece never begins with empty parts, and the separators between pieces are dropped.
    """
    if len(text) <= limit:
        yield base, base + len(text)
        return
    if not separators:
        for at in range(0, len(text), limit):
            yield base + at, base + min(at + limit, len(text))
        return
    mark, start, end, cursor = separators[0], 0, 0, 0
    for part in text.split(mark):
        stop = cursor + len(part)
        if start == end:  # nothing held: begin here
            start = cursor
        if stop - start <= limit:
            end = stop
        else:
            if start < end:
                yield base + start, base + end
            if len(part) > limit:
                yield from fragments(part, limit, separators[1:], base + cursor)
                start = end = stop
            else:
                start, end = cursor, stop
        cursor = stop + len(mark)
    if start < end:
        yield base + start, base + end


def page_of(page_map: list[tuple[int, int]], offset: int) -> int | None:
    """JOIN-7: the page that begins last at or before ``offset``, the first page before any, None without pages."""
    page = page_map[0][0] if page_map else None
    for number, start in page_map:
        if start > offset:
            break
        page = number
    return page


def chunk_text(text: str, page_map: list[tuple[int, int]] = (), size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int, int, int | None]]:
    """(chunk_idx, start, end, page): pieces reach back by the overlap; blank ones keep their number but are left out."""
    out = []
    for number, (start, end) in enumerate(fragments(text, size * TOKEN_CHARS)):
        if text[start:end].strip():
            begin = max(0, start - overlap * TOKEN_CHARS) if number else start
            out.append((number, begin, end, page_of(list(page_map), begin)))
    return out


def page_at(page_map: Column, offset: Column) -> Column:
    """JOIN-7 as a column: page_map is array<struct<page, start>>."""
    before = F.filter(page_map, lambda p: p["start"] <= offset)
    return F.coalesce(F.try_element_at(before, F.lit(-1))["page"], F.try_element_at(page_map, F.lit(1))["page"])


def page_offsets(pages: DataFrame, key: str, page: str = "page", text: str = "text") -> DataFrame:
    """WIN-5: pages (one row each) with the offset at which each begins in its document; nothing stands between pages."""
    before = Window.partitionBy(key).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("start", F.coalesce(F.sum(F.length(text)).over(before), F.lit(0)))


def chunks(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = SIZE, overlap: int = OVERLAP, pages_col: str | None = None) -> DataFrame:
    """One row per chunk: doc_id, chunk_id, chunk_idx, text, page, offset_start, offset_end. Null texts have none.

    An Arrow pass (no row-wise UDF); a task holds a batch of documents, never a group.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids, rows = batch.column("doc_id"), [[] for _ in range(6)]
            for i, text in enumerate(batch.column("text").to_pylist()):
                pages = [(p["page"], p["start"]) for p in batch.column("pages")[i].as_py() or []] if pages_col else []
                for number, start, end, page in chunk_text(text or "", pages, size, overlap):
                    for column, value in zip(rows, (i, number, text[start:end], page, start, end)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            arrays = [pa.array(c, t) for c, t in zip(rows, kinds)]
            yield pa.RecordBatch.from_arrays([ids.take(arrays[0]), *arrays[1:]], ["doc_id", "chunk_idx", "text", "page", "offset_start", "offset_end"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.col(pages_col).alias("pages")] if pages_col else []))
    out = rows.mapInArrow(batches, f"doc_id {kind}, chunk_idx int, text string, page int, offset_start int, offset_end int")
    return out.select("doc_id", F.concat_ws("::", "doc_id", "chunk_idx").alias("chunk_id"), "chunk_idx", "text", "page", "offset_start", "offset_end")


def fixed_chunks(docs: DataFrame, length: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """SCL-8's cut by length, without Python: doc_id, chunk_idx, text."""
    rows = docs.filter(F.length(text_col) > 0).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
    rows = rows.select("doc_id", "_t", F.explode(F.sequence(F.lit(0), F.floor((F.length("_t") - 1) / length).cast("int"))).alias("chunk_idx"))
    return rows.select("doc_id", "chunk_idx", F.substr("_t", F.col("chunk_idx") * length + 1, F.lit(length)).alias("text"))


def rescue(files: DataFrame) -> DataFrame:
    """2.11.9: files whose text is blank get one chunk, their name, so that they can be found by it."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return files.withColumn("note", F.when(blank, "empty text")).withColumn("text", F.when(blank, F.col("name")).otherwise(F.col("text")))

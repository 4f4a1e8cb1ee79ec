"""Substring dedup by suffixes: every byte covered by a string of ``length`` bytes that also starts elsewhere is removed.

A suffix of the corpus counts by its first ``length`` bytes, its window. Buckets of suffixes are made by content: the hash of the
least GRAM-byte gram inside the window, which equal windows share. Consecutive windows of a text with the same bucket are one
context, a stretch of bytes in which all of them lie; a context is cut after MOST_WINDOWS windows, and long texts at multiples
of PIECE, so memory is bounded. Only what can matter is moved:

1. Buckets with one context, in which the gram occurs once, hold no repeated window and are dropped. Counts, and the least and
   greatest digest of a bucket's contexts, are combined before the shuffle.
2. If all contexts of a bucket are alike, and there are several, or a context occurs again as a whole, all its windows repeat.
3. Of each other bucket the distinct contexts are brought together, one copy each, and their suffixes are sorted: blocks of
   whole buckets are laid out in memory, the suffixes at the places of a difference cover (COVER modulo PERIOD) get their ranks
   (by PERIOD bytes, then by doubling), and then one range of leading bytes is sorted at a time: by the first PERIOD bytes, and
   where those tie by the ranks of the two cover suffixes at the same distance below PERIOD from both. In order, equal windows are
   neighbours; neighbours are compared byte by byte.
4. A bucket of more than MOST_CONTEXTS distinct contexts would not be bounded in one task: its windows are counted one by one by
   64-bit hash, all of them.

Facts of buckets, contexts and hot windows come back to them in merge joins against one row a key, the other side of which
adaptive execution splits where a key has too many rows. The spans found go to their texts by the texts' hash. Texts are staged in buckets by that hash once; they aren't moved again.
Identity of whole contexts and hot windows is by 64-bit hash (beside the 64 bits of their bucket).

Defined results: null text is empty; texts shorter than ``length`` stay whole; rows that repeat, whatever their doc_id, even a
null one, are each other's copies; ties don't matter; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, stage_buckets, task_count
from .arrays import BASE, MIX1, MIX2, mix, powers, slices, text_bytes
from .names import column

#: Bytes of a string that may not start twice; bytes of a gram; windows of a context; bytes of a text that are worked on at once.
LENGTH, GRAM, MOST_WINDOWS, PIECE = 200, 64, 256, 1 << 18
#: Distinct contexts of a bucket that is sorted in one task; bytes of contexts in a block; suffixes sorted at a time.
MOST_CONTEXTS, BLOCK, BUCKET = 4096, 1 << 20, 1 << 16
PERIOD = 32


def difference_cover(period: int) -> np.ndarray:
    """Places modulo ``period`` of which some two are at any distance: each next one is the one that adds most distances."""
    chosen = [0, 1]
    distances = lambda places: {(a - b) % period for a in places for b in places}
    while len(distances(chosen)) < period:
        chosen.append(max((x for x in range(period) if x not in chosen), key=lambda x: len(distances([*chosen, x]))))
    return np.array(sorted(chosen))


COVER = difference_cover(PERIOD)
#: SHIFT[a, b]: the least k for which a + k and b + k are both in the cover, modulo PERIOD.
SHIFT = np.array([[next(k for k in range(PERIOD) if (a + k) % PERIOD in COVER and (b + k) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


def grams(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """64-bit hashes of the ``size`` bytes (a power of 2) from each place on, by doubling."""
    found, have, up = (data.astype(np.uint64) + np.uint64(1)) * MIX1, 1, int(BASE)
    while have < size:
        found = found[:-have] * np.uint64(up) + found[have:]
        have, up = 2 * have, up * up & (1 << 64) - 1
    return mix(found)


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """The least or greatest (``pick``) of each ``width`` consecutive values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return pick(x[:-rest], x[rest:]) if rest else x


def contexts(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, bucket, digest, whether the bucket's gram may occur twice) of the contexts of texts, windows counted in ``data``."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    hashes, width = grams(data), length - GRAM + 1
    least = sliding(hashes, width, np.minimum)
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    live = np.flatnonzero(sizes)
    first, stop = offsets[live], offsets[live] + sizes[live]
    edge = np.zeros(len(least) + 1, np.int8)
    edge[first] += 1
    edge[stop] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    new[first] = True
    begin = np.flatnonzero(new)
    text = np.searchsorted(first, begin, "right") - 1
    end = np.minimum(np.append(begin[1:], len(least)), stop[text])
    parts = -(-(end - begin) // MOST_WINDOWS)
    if (parts > 1).any():
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, end, text = np.repeat(begin, parts) + nth * MOST_WINDOWS, np.repeat(end, parts), np.repeat(text, parts)
        end = np.minimum(begin + MOST_WINDOWS, end)
    # a gram is chosen if it is the least of a window; of grams that occur twice in a context, two chosen ones in a row are alike
    rim = np.zeros(width - 1, np.uint64)
    values = hashes[hashes == sliding(np.concatenate([rim, least, rim]), width, np.maximum)]
    twice = np.isin(least[begin], values[1:][values[1:] == values[:-1]])
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    digest = mix((sums[end + length - 1] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * MIX2)
    return live[text], begin, end - begin, least[begin], digest, twice


def _contexts(length: int):
    """(row, start, windows, bucket, digest, twice) of every context of the texts (row, text)."""
    schema = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("bucket", pa.int64()), ("digest", pa.int64()), ("twice", pa.bool_())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(source, "text", PIECE):
            rows = part.column("row").to_numpy()
            data, offsets = text_bytes(part.column("text"))
            for at in range(0, max(1, len(data) - length + 1), PIECE):  # several texts are at most one piece
                piece = data[at : at + PIECE + length - 1]
                text, begin, windows, bucket, digest, twice = contexts(piece, offsets if part.num_rows > 1 else np.array([0, len(piece)]), length)
                columns = (rows[text], begin + at - (offsets[text] if part.num_rows > 1 else 0), windows.astype(np.int32), bucket.view(np.int64), digest.view(np.int64), twice)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return batches


def _refined(keys: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of ``places`` by the ``size`` bytes from them on, group numbers in that order: alike where those bytes are). ``keys``: the eight bytes from each place on."""
    first = keys[places]
    order = np.argsort(first)
    new = np.append(True, np.diff(first[order]) != 0)
    for at in range(8, size, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        tied = np.flatnonzero(tied)
        if not len(tied):
            break
        part, group = order[tied], (np.cumsum(new) - 1)[tied]
        more = keys[places[part] + at]
        by = np.lexsort((more, group))
        order[tied] = part[by]
        new[tied] |= np.append(True, more[by][1:] != more[by][:-1])
    return order, np.cumsum(new) - 1


def _cover_ranks(keys: np.ndarray, places: np.ndarray, ends: np.ndarray, depth: int, size: int) -> np.ndarray:
    """For each of ``size`` places of the layout the rank from 1 of its suffix among those of the cover's ``places``, by ``depth`` bytes at least; ``ends``: where each suffix ends. An ended suffix is before all others."""
    ranks = np.zeros(size, np.int64)
    order, group = _refined(keys, places, PERIOD)
    have = PERIOD
    while True:
        ranks[places[order]] = group + 1
        if have >= depth or group[-1] == len(places) - 1:
            return ranks
        on = places + have  # is in the cover too
        both = ranks[places] << 32 | np.where(on < ends, ranks[np.minimum(on, size - 1)], 0)
        order = np.argsort(both)
        group = np.cumsum(np.append(False, np.diff(both[order]) != 0))
        have *= 2


def _settled(places: np.ndarray, group: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """``places``, in order by their first bytes (``group``: which are alike), in order by the cover's ranks within the groups."""
    sizes = np.bincount(group)
    first = np.cumsum(sizes) - sizes
    residue = places % PERIOD
    same = (np.minimum.reduceat(residue, first) == np.maximum.reduceat(residue, first))[group]
    place = np.arange(len(places))
    simple, mixed = np.flatnonzero(same & (sizes[group] > 1)), np.flatnonzero(~same)
    if len(simple):  # one distance to the cover serves all
        key = group[simple] << 32 | ranks[places[simple] + SHIFT[residue[simple], residue[simple]]]
        place[simple] = simple[np.argsort(key)]
    order, part = mixed, group[mixed]
    while len(order):  # a pivot splits each group: any two suffixes have a distance of their own
        new = np.append(True, part[1:] != part[:-1])
        begin = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        middle = (begin + np.append(begin[1:], len(part))) // 2
        pivot = places[order[middle]][number]
        own = places[order]
        k = SHIFT[own % PERIOD, pivot % PERIOD]
        side = np.sign(ranks[own + k] - ranks[pivot + k]) + 1
        by = np.argsort(number * 3 + side, kind="stable")
        slots, order, part = np.sort(mixed), order[by], (number * 3 + side)[by]
        place[slots] = order
        counts = np.bincount(part)
        open_ = (part % 3 != 1) & (counts[part] > 1)
        mixed, order, part = slots[open_], order[open_], part[open_]
    return places[place]


def repeated_windows(texts: list[bytes], anchors: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each text whether each of its windows starts elsewhere too, in another text or in its own, by their sorted suffixes.

    ``anchors``: a place in each text; texts are laid out with them at the same place modulo PERIOD, so that windows that share
    bytes mostly have one distance to the cover. Any places give right results.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    room = -(-(sizes + 2 * PERIOD) // PERIOD) * PERIOD
    start = np.cumsum(room) - room + (-anchors) % PERIOD
    layout = np.zeros(int(room.sum()) + length + 8, np.uint8)
    for at, text in zip(start.tolist(), texts):
        layout[at : at + len(text)] = np.frombuffer(text, np.uint8)
    keys = np.ndarray(len(layout) - 7, ">u8", layout, strides=(1,))
    within = lambda counts: np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    covered = np.repeat(start, sizes) + within(sizes)
    chosen = np.isin(np.arange(PERIOD), COVER)[covered % PERIOD]
    ranks = _cover_ranks(keys, covered[chosen], np.repeat(start + sizes, sizes)[chosen], length, len(layout))
    counts = np.maximum(sizes - length + 1, 0)
    windows = np.repeat(start, counts) + within(counts)
    lead = layout[windows].astype(np.int64) << 8 | layout[windows + 1]
    ahead = np.cumsum(np.bincount(lead, minlength=1 << 16))
    bucket = ((ahead - 1) // BUCKET)[lead]  # ranges of leading bytes
    repeats = np.zeros(len(layout), bool)
    for number in np.unique(bucket):
        own = windows[bucket == number]
        order, group = _refined(keys, own, PERIOD)
        own = _settled(own[order], group, ranks)
        like = np.flatnonzero(group[1:] == group[:-1])
        for at in [*range(PERIOD, length - 7, 8), length - 8]:
            like = like[keys[own[like] + at] == keys[own[like + 1] + at]]
        repeats[own[like]] = True
        repeats[own[like + 1]] = True
    return np.split(repeats[windows], np.cumsum(counts)[:-1])


_SPAN = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _sorted_spans(length: int, block: int):
    """The spans of repeated windows of contexts (bucket, row, start, shared, text) that come by bucket; ``shared`` ones are repeated as a whole and are only looked at for the others."""

    def blocks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in source:
            held.append(batch)
            size += batch.nbytes
            if size >= block:
                table = pa.Table.from_batches(held).combine_chunks()
                buckets = table["bucket"].to_numpy()
                cut = int(np.flatnonzero(buckets == buckets[-1])[0])  # the last bucket may go on
                if cut:
                    yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                size = sum(b.nbytes for b in held)
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def parts(table: pa.Table) -> Iterator[pa.Table]:
        """Whole buckets of about ``block`` bytes."""
        buckets = table["bucket"].to_numpy()
        sizes = np.cumsum(np.asarray(pc.binary_length(table["text"]), dtype=np.int64))
        ends = np.flatnonzero(np.append(buckets[1:] != buckets[:-1], True)) + 1
        begin = 0
        for i, end in enumerate(ends):
            if i + 1 == len(ends) or sizes[ends[i + 1] - 1] - (sizes[begin - 1] if begin else 0) > block:
                yield table.slice(begin, end - begin)
                begin = end

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(source):
            for part in parts(table):
                texts, bucket = part["text"].to_pylist(), part["bucket"].to_numpy().view(np.uint64)
                sizes = np.array([len(t) for t in texts])
                hashes = grams(np.frombuffer(b"".join(texts) + bytes(GRAM), np.uint8))[: sizes.sum()]
                met = np.flatnonzero(hashes == np.repeat(bucket, sizes))
                begin = np.cumsum(sizes) - sizes
                anchors = np.append(met, 0)[np.searchsorted(met, begin)] - begin
                rows, starts, shared = part["row"].to_numpy(), part["start"].to_numpy(), part["shared"].to_numpy()
                found = repeated_windows(texts, anchors, length)
                out: list[list[np.ndarray]] = [[], [], []]
                for row, start, whole, repeats in zip(rows, starts, shared, found):
                    if whole or not repeats.any():
                        continue
                    edges = np.flatnonzero(np.diff(repeats.astype(np.int8), prepend=0, append=0))
                    for column, x in zip(out, (np.full(len(edges) // 2, row), edges[::2] + start, edges[1::2] + start + length - 1)):
                        column.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], schema=_SPAN)

    return batches


def _window_hashes(length: int):
    """(window, row, start, shared) of every window of contexts, ``window`` its 64-bit hash with its bucket's."""
    schema = pa.schema([("window", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("shared", pa.bool_())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row, start, shared, bucket, text in zip(*[batch.column(c).to_pylist() for c in ("row", "start", "shared", "bucket", "text")]):
                data = np.frombuffer(text, np.uint8)
                up, down = powers(len(data) + 1)
                sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]))
                hashes = mix(mix((sums[length:] - sums[:-length]) * down[: len(data) - length + 1]) ^ np.uint64(bucket & (1 << 64) - 1))
                n = len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.full(n, row)), pa.array(start + np.arange(n)), pa.array(np.full(n, shared))], schema=schema)

    return batches


def _cut_contexts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that are asked for of each text."""
    schema = pa.schema([("bucket", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("shared", pa.bool_()), ("hot", pa.bool_()), ("text", pa.binary())])
    for batch in source:
        for row, text, asked in zip(*[batch.column(c) for c in ("row", "text", "asked")]):
            raw = memoryview(text.as_buffer())
            columns = list(zip(*[(a["bucket"], row.as_py(), a["start"], a["shared"], a["hot"], bytes(raw[a["start"] : a["end"]])) for a in asked.as_py()]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _removed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in source:
        sizes, spans, kept = [], [], []
        for text, found in zip(batch.column("text"), batch.column("found").to_pylist()):
            raw = memoryview(text.as_buffer())
            runs = _merged(found)
            edges = [0, *[e for run in runs for e in run], len(raw)]
            sizes.append(len(raw))
            spans.append([{"start": a, "end": b} for a, b in runs])
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, shape), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def repeated_bytes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, most_contexts: int = MOST_CONTEXTS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (start, end in bytes, end exclusive, apart from each other) of the bytes covered by a string of ``length`` bytes that also starts elsewhere, and kept, the other bytes. ``length``: GRAM + PERIOD at least."""
    if length < GRAM + PERIOD:
        raise ValueError(f"length is at least {GRAM + PERIOD} bytes")
    text = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(column(id_col), text).alias("row"), column(id_col).alias("doc_id"), text.alias("text"))
    texts = stage_buckets(rows.repartition(task_count(docs.sparkSession), "row"), "texts", "row")
    found = texts.select("row", "text").mapInArrow(_contexts(length), "row long, start long, windows int, bucket long, digest long, twice boolean")

    several = found.groupBy("bucket").agg(F.count("*").alias("n"), (F.min("digest") == F.max("digest")).alias("alike"), F.max("twice").alias("twice"))
    several = stage(several.filter("n > 1 OR twice").select("bucket", (F.col("alike") & (F.col("n") > 1)).alias("alike")), "buckets")
    met = stage(found.drop("twice").join(several.hint("merge"), "bucket"), "contexts")
    whole = lambda rows: rows.select("row", "start", (F.col("start") + F.col("windows") + length - 1).alias("end"))

    mixed = met.filter("NOT alike").withColumn("context", F.xxhash64("bucket", "digest"))
    distinct = stage(mixed.groupBy("context").agg(F.count("*").alias("n"), F.min(F.struct("row", "start", "windows", "bucket")).alias("one")).select("context", "n", "one.*"), "distinct-contexts")
    copies = mixed.join(distinct.filter("n > 1").select("context").hint("merge"), "context")

    sizes = distinct.groupBy("bucket").agg(F.count("*").alias("held"))
    asked = distinct.join(sizes.hint("merge"), "bucket")
    asked = asked.groupBy("row").agg(F.collect_list(F.struct("bucket", "start", (F.col("start") + F.col("windows") + length - 1).alias("end"), (F.col("n") > 1).alias("shared"), (F.col("held") > most_contexts).alias("hot"))).alias("asked"))  # of one text
    cut = texts.select("row", "text").join(asked.hint("merge"), "row").mapInArrow(_cut_contexts, "bucket long, row long, start long, shared boolean, hot boolean, text binary")
    cut = stage(cut, "context-bytes")

    spans = "row long, start long, end long"
    cold = cut.filter("NOT hot").drop("hot").repartition(task_count(docs.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(_sorted_spans(length, block), spans)
    windows = cut.filter("hot").drop("hot").mapInArrow(_window_hashes(length), "window long, row long, start long, shared boolean")
    often = stage(windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window"), "hot-windows")
    hot = windows.filter("NOT shared").join(often.hint("merge"), "window").select("row", "start", (F.col("start") + length).alias("end"))

    every = whole(met.filter("alike")).unionByName(whole(copies)).unionByName(cold).unionByName(hot)
    every = every.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("found"))  # of one text
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.join(every.hint("merge"), "row", "left").select("doc_id", "text", "found").mapInArrow(_removed, f"doc_id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is kept."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

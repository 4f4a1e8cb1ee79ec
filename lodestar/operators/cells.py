"""Exact nearest neighbours by cosine, pruned by cells (JOIN-5, TOP-1).

``build`` picks pivots by a few rounds of k-means on a bounded sample, gives every vector to its nearest pivot's cell and writes
each cell as blocks of at most BLOCK vectors of unit length in order of their distance to the pivot, so a block is a ring with a
least and a greatest distance. For a query at distance d from the pivot, no vector of a ring is nearer than d - greatest or
least - d (triangle inequality). The nearest cells of each query are searched first; their k-th score is a threshold, and of the
other cells only those that it doesn't exclude are read, and in them only the rings that it doesn't exclude are compared.
Queries go to parts of the cells in packs, a pack and a ring being one product of matrices. Nothing is compared with everything, and no
vector that can be among the k best is left out: results are those of comparing all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage, staging_path, task_count
from .retrieval import AT_ONCE, ranked

#: Most cells, vectors sampled for each, rounds of k-means, vectors of a block or pack, cells of each query that are searched first, vectors of cells to which a query goes at once.
MOST_CELLS, SAMPLE, ROUNDS, BLOCK, FIRST_CELLS, PART_VECTORS = 1024, 8, 4, 4096, 1, 1 << 16
#: Scores are rounded, distances carry rounding errors.
_EPSILON = 1e-5


def _unit(column: pa.Array) -> np.ndarray:
    matrix = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    norms = np.linalg.norm(matrix, axis=1)
    return matrix / np.where(norms > 0, norms, 1)[:, None]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` from all rows of ``b``."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def pivots(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Means of the ``cells`` clusters that Lloyd's rounds find, the first of distinct rows to begin with."""
    found = np.unique(np.round(sample, 9), axis=0, return_index=True)[1]
    centre = sample[np.sort(found)[:cells]]
    for _ in range(rounds):
        own = _distances(sample, centre).argmin(1)
        for c in np.unique(own):
            centre[c] = sample[own == c].mean(0)
    return centre


class CellIndex:
    """An index that ``build`` has written at ``path``."""

    def __init__(self, spark: SparkSession, path: str, cells: list[tuple] | None = None) -> None:
        """``cells``: what the folder's ``cells`` holds, if that is known: (cell, near, far, n, centre) of cells with vectors."""
        self.spark, self.path = spark, path
        rows = sorted(cells if cells is not None else map(tuple, spark.read.parquet(f"{path}/cells").select("cell", "near", "far", "n", "centre").collect()))  # MOST_CELLS at most
        self.number, self.near, self.far, self.count = (np.array([r[i] for r in rows], t) for i, t in enumerate((np.int32, np.float64, np.float64, np.int64)))
        self.centre = np.array([r[4] for r in rows], np.float64)

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, cells: int | None = None, block: int = BLOCK) -> CellIndex:
        """Index all of ``vectors`` (id, vector); null vectors are left out. ``cells``: by default the square root of the number of rows."""
        spark, path = vectors.sparkSession, path or staging_path(vectors.sparkSession, "cell-index")
        vectors = vectors.select("id", "vector").filter(F.col("vector").isNotNull())
        total = vectors.count()
        cells = min(MOST_CELLS, cells or int(total**0.5) or 1)
        sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * cells).select("vector").toArrow()["vector"].combine_chunks()  # bounded
        centre = pivots(_unit(sample), cells) if len(sample) else np.zeros((0, 1))
        kind = vectors.schema["id"].dataType.simpleString()

        def dealt(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                if batch.num_rows:
                    matrix = _unit(batch.column("vector"))
                    away = _distances(matrix, centre)
                    cell = away.argmin(1)
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), matrix.shape[1]).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cell, pa.int32()), pa.array(away[np.arange(len(cell)), cell]), flat], ["id", "cell", "away", "vector"])

        def packed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def rings(table: pa.Table) -> Iterator[pa.RecordBatch]:
                cell = table["cell"].to_numpy()
                cuts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                for a, b in zip(cuts, np.append(cuts[1:], len(cell))):
                    for at in range(a, b, block):
                        ring = table.slice(at, min(block, b - at)).combine_chunks()
                        away = ring["away"].to_numpy()
                        columns = ([int(cell[at])], [float(away[0])], [float(away[-1])], [ring["id"].to_pylist()], [_unit_bytes(ring["vector"])])
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.float64(), pa.list_(ring["id"].type), pa.binary()))], ["cell", "near", "far", "ids", "matrix"])

            for batch in source:
                held.append(batch)
                if sum(b.num_rows for b in held) >= 4 * block:
                    table = pa.Table.from_batches(held)
                    whole = table.num_rows // block * block
                    yield from rings(table.slice(0, whole))
                    held = table.slice(whole).to_batches()
            if held:
                yield from rings(pa.Table.from_batches(held))

        rows = vectors.mapInArrow(dealt, f"id {kind}, cell int, away double, vector array<double>")
        rows = rows.repartition(task_count(spark), "cell", F.pmod(F.xxhash64("id"), F.lit(1 + total // (16 * block))))  # a large cell takes several tasks
        rows.sortWithinPartitions("cell", "away", "id").mapInArrow(packed, f"cell int, near double, far double, ids array<{kind}>, matrix binary").write.parquet(f"{path}/rings")
        held = spark.read.parquet(f"{path}/rings").groupBy("cell").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.sum(F.size("ids")).alias("n")).collect()  # MOST_CELLS at most
        found = [(*r, centre[r["cell"]].tolist()) for r in held]
        spark.createDataFrame(found, "cell int, near double, far double, n long, centre array<double>").coalesce(1).write.parquet(f"{path}/cells")
        return cls(spark, path, found)

    def rings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rings")

    def _asked(self, queries: DataFrame, first: int, k: int) -> DataFrame:
        """(qid, vector, cell, away, bound, begun) of each query and each cell that holds vectors: bound is the highest possible score there, and ``begun`` cells are the nearest ones, ``first`` of them and as many as hold ``k`` vectors."""
        centre, near, far, count, numbers = self.centre, self.near, self.far, self.count, self.number

        def told(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in source if len(count) else ():
                whole = whole.filter(whole.column("vector").is_valid())
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    away = _distances(_unit(batch.column("vector")), centre)
                    gap = np.maximum(np.maximum(away - far, near - away), 0)
                    order = np.argsort(away, axis=1)
                    before = np.cumsum(count[order], axis=1) - count[order]
                    begun = np.zeros(away.shape, bool)
                    np.put_along_axis(begun, order, (np.arange(away.shape[1]) < first) | (before < k), axis=1)
                    q, c = np.repeat(np.arange(batch.num_rows), away.shape[1]), np.tile(np.arange(away.shape[1]), batch.num_rows)
                    columns = (batch.column("qid").take(pa.array(q)), pa.array(numbers[c]), pa.array(away.ravel()), pa.array(1 - gap.ravel() ** 2 / 2), pa.array(begun.ravel()))
                    yield pa.RecordBatch.from_arrays(list(columns), ["qid", "cell", "away", "bound", "begun"])

        return queries.select("qid", "vector").mapInArrow(told, f"qid {queries.schema['qid'].dataType.simpleString()}, cell int, away double, bound double, begun boolean")

    def _compared(self, asked: DataFrame, queries: DataFrame, k: int, digits: int) -> DataFrame:
        """(qid, id, score): the ``k`` best of each query in each ring of its cells (qid, cell, away, least) that can hold one.

        Cells are dealt to parts; a query's vector goes once to each part where it has cells, not to each cell.
        """
        wanted = dict(map(tuple, asked.groupBy("cell").count().collect()))  # MOST_CELLS at most; other cells aren't read
        packs = max(1, -(-max(wanted.values(), default=0) // BLOCK))  # a part's rings meet about as few packs as hold its queries
        parts = max(1, min(len(wanted), max(task_count(self.spark) // 4, int(self.count.sum()) // PART_VECTORS)))
        part = F.pmod(F.xxhash64("cell"), F.lit(parts)).cast("int").alias("part")
        cells = asked.groupBy(part, "qid").agg(F.collect_list(F.struct("cell", "away")).alias("cells"), F.min("least").alias("least"))  # least is the query's
        rows = cells.join(queries.select("qid", "vector"), "qid").select("part", "qid", "vector", F.col("cells.cell").alias("cells"), F.col("cells.away").alias("aways"), "least")
        kind, id_type, block = queries.schema["qid"].dataType.simpleString(), self.rings().schema["ids"].dataType.elementType.simpleString(), BLOCK

        def packed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                part = batch.column("part").to_numpy()
                cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
                for a, b in zip(cuts, np.append(cuts[1:], len(part))):
                    for at in range(a, b, block):
                        pack = batch.slice(at, min(block, b - at))
                        owner = np.repeat(np.arange(pack.num_rows, dtype=np.int32), pack.column("cells").value_lengths().to_numpy())
                        flat = [pack.column(c).flatten().to_numpy() for c in ("cells", "aways")]
                        order = np.argsort(flat[0], kind="stable")
                        found = [x[order].tobytes() for x in (*flat, owner)]
                        columns = ([int(part[at])], [pack.column("qid").to_pylist()], [_unit_bytes(pack.column("vector"))], [pack.column("least").to_numpy().tobytes()], *([x] for x in found))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.list_(pack.column("qid").type), *[pa.binary()] * 5))], ["part", "qids", "queries", "leasts", "cells", "aways", "owners"])

        def nearest(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                for i in range(batch.num_rows):
                    one = lambda c, t=np.float64: np.frombuffer(batch.column(c)[i].as_buffer(), t)  # noqa: B023, E731
                    own = slice(*np.searchsorted(one("cells", np.int32), [batch.column("cell")[i].as_py(), batch.column("cell")[i].as_py() + 1]))
                    owner, away = one("owners", np.int32)[own], one("aways")[own]
                    gap = np.maximum(np.maximum(away - batch.column("far")[i].as_py(), batch.column("near")[i].as_py() - away), 0)
                    open_ = owner[1 - gap**2 / 2 >= one("leasts")[owner] - _EPSILON]
                    if not len(open_):
                        continue
                    ids, qids = batch.column("ids")[i].values, batch.column("qids")[i].values
                    have, want = one("matrix").reshape(len(ids), -1), one("queries").reshape(len(qids), -1)
                    for part in np.split(open_, range(AT_ONCE, len(open_), AT_ONCE)):
                        score = np.round(have @ want[part].T, digits) + 0.0
                        least = np.partition(score, -k, axis=0)[-k] if len(ids) > k else np.full(len(part), -np.inf)
                        row, q = np.nonzero(score >= np.maximum(least, one("leasts")[part] - _EPSILON))  # ties stay
                        yield pa.RecordBatch.from_arrays([qids.take(pa.array(part[q])), ids.take(pa.array(row)), pa.array(score[row, q])], ["qid", "id", "score"])

        made = rows.repartition(task_count(self.spark), "part", F.pmod(F.xxhash64("qid"), F.lit(packs))).sortWithinPartitions("part").mapInArrow(packed, f"part int, qids array<{kind}>, queries binary, leasts binary, cells binary, aways binary, owners binary")
        rings = self.rings().filter(F.col("cell").isin(list(wanted))).select("*", part)
        return rings.join(made, "part").select("cell", "near", "far", "ids", "matrix", *made.columns[1:]).mapInArrow(nearest, f"qid {kind}, id {id_type}, score double")

    def top(self, queries: DataFrame, k: int, digits: int = 6, first: int = FIRST_CELLS) -> DataFrame:
        """(qid, id, score, rank): the ``k`` nearest by cosine of each query (qid, vector); null vectors have no neighbours."""
        asked = stage(self._asked(queries, first, k), "asked-cells")
        begun = asked.filter("begun").select("qid", "cell", "away", F.lit(-2.0).alias("least"))
        found = stage(ranked(self._compared(begun, queries, k, digits), k, "score", "qid"), "first-neighbours")
        threshold = found.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("least"))
        rest = asked.filter("NOT begun").join(threshold, "qid").filter(F.col("bound") >= F.col("least") - _EPSILON).select("qid", "cell", "away", "least")
        return ranked(found.drop("rank").unionByName(self._compared(rest, queries, k, digits)), k, "score", "qid")


def _unit_bytes(column: pa.Array | pa.ChunkedArray) -> bytes:
    return _unit(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).tobytes()

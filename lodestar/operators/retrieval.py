"""Retrieval: exact kNN, BM25, fusion, reranking cuts and diversification. All operators take many queries at once.

``knn`` and ``bm25`` make one search of what they are given, in one lazy plan; ``cells`` and ``inverted`` keep indexes that many
searches share and that prune by bounds. Both ways are exact and give the same rows. Every ranking has a total order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

#: Fusion constants (1-based ranks), BM25 constants, the reranker's margin, the diversity weight.
RRF_APP, RRF_STORE = 60, 1
BM25_K1, BM25_B = 1.2, 0.75
MARGIN, LAMBDA, OVERFETCH = 1.2, 0.7, 2
#: Vectors of a block, queries of it whose scores are held at once.
QUERY_BLOCK, AT_ONCE = 4096, 256


def dense_limit(k: int) -> int:
    return max(4 * k, 20)


def sparse_limit(k: int) -> int:
    return max(2 * k, 20)


def cosine(a: Column, b: Column) -> Column:
    """SCL-3: 0 if either norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def ranked(rows: DataFrame, k: int | None, by: Column | str, *keys: str, order: str = "id", name: str = "rank") -> DataFrame:
    """WIN-1: ranks from 1 within ``keys``; ``k`` of them. The filter prunes before the shuffle (window group limit)."""
    window = Window.partitionBy(*keys).orderBy(F.desc(by) if isinstance(by, str) else by, F.asc(order))
    out = rows.withColumn(name, F.row_number().over(window))
    return (out.filter(F.col(name) <= k) if k else out).withColumn(name, F.col(name).cast("long"))


def _packed(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows of (ids, matrix): up to ``size`` vectors each as one block of doubles of unit length; null vectors are left out."""
    kind = rows.schema[key].dataType.simpleString()

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            batch = batch.filter(batch.column("vector").is_valid())
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                matrix = np.asarray(part.column("vector").flatten(), np.float64).reshape(part.num_rows, -1)
                norms = np.linalg.norm(matrix, axis=1)
                matrix = matrix / np.where(norms > 0, norms, 1)[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([part.column(key).to_pylist()], pa.list_(part.column(key).type)), pa.array([matrix.tobytes()], pa.binary())], ["ids", "matrix"])

    return rows.select(key, "vector").mapInArrow(batches, f"ids array<{kind}>, matrix binary")


def knn(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """JOIN-5, TOP-1: (qid, id, score, rank): the ``k`` nearest by cosine of each query; null vectors have no neighbours.

    ``vectors`` has id and vector, ``queries`` (the stated query set) qid and vector. Both are packed into blocks of at most
    QUERY_BLOCK rows; every pair of a query block and a vector block is one product of matrices in a task, of which only the
    ``k`` best of each query go on. Nothing is collected. For one search of some vectors; ``cells.CellIndex`` serves many.
    """
    blocks = _packed(vectors, "id", QUERY_BLOCK)
    wanted = _packed(queries, "qid", QUERY_BLOCK).select(F.col("ids").alias("qids"), F.col("matrix").alias("queries"))
    id_type, qid_type = blocks.schema["ids"].dataType.elementType, wanted.schema["qids"].dataType.elementType

    def nearest(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(batch.num_rows):
                ids, qids = batch.column("ids")[i].values, batch.column("qids")[i].values
                have = np.frombuffer(batch.column("matrix")[i].as_buffer(), np.float64).reshape(len(ids), -1)
                want = np.frombuffer(batch.column("queries")[i].as_buffer(), np.float64).reshape(len(qids), -1)
                for at in range(0, len(qids), AT_ONCE):
                    score = np.round(have @ want[at : at + AT_ONCE].T, digits) + 0.0
                    least = np.partition(score, -k, axis=0)[-k] if len(ids) > k else np.full(score.shape[1], -np.inf)
                    rows, q = np.nonzero(score >= least)  # ties stay, the last ranking decides
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(at + q)), ids.take(pa.array(rows)), pa.array(score[rows, q])], ["qid", "id", "score"])

    best = blocks.crossJoin(wanted).mapInArrow(nearest, f"qid {qid_type.simpleString()}, id {id_type.simpleString()}, score double")
    return ranked(best, k, "score", "qid")


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """AGG-17: (term, id, dl, tf): term counts of each document with its length in tokens."""
    from . import inverted

    return inverted.postings(docs, doc_id, text)


def corpus_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n documents, mean length avgdl."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.size(tx.tokens(F.col(text))), F.lit(0))).alias("avgdl"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text", saturated: bool = False, digits: int = 6) -> DataFrame:
    """JOIN-6, AGG-16, TOP-2: (qid, id, score, rank) of the ``k`` best documents of each query (qid, text).

    Terms of the query are distinct and weigh 1, or their saturated frequency if ``saturated``. Terms are counted within each
    document, and only the queries' terms are shuffled. For one search of some documents; ``inverted.InvertedIndex`` serves many.
    """
    terms = queries.select("qid", F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    weight = F.col("qtf") * (BM25_K1 + 1) / (F.col("qtf") + BM25_K1) if saturated else F.lit(1.0)
    held = postings(docs, doc_id, text).join(terms.select("term").distinct(), "term", "left_semi")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    size = F.broadcast(corpus_size(docs, text))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturation = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")))
    hits = held.join(df, "term").join(terms, "term").crossJoin(size)
    score = hits.groupBy("qid", "id").agg(F.round(F.sum(weight * idf * saturation), digits).alias("score"))
    return ranked(score, k, "score", "qid")


def rrf(rankings: DataFrame, constant: int = RRF_APP, digits: int = 9) -> DataFrame:
    """AGG-8, SET-3: (qid, id, score): sums of 1 / (constant + rank) over the rankings of a query (qid, ranking, id, rank from 1)."""
    return rankings.groupBy("qid", "id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), digits).alias("score"))


def rrf_or_single(rankings: DataFrame, constant: int = RRF_APP) -> DataFrame:
    """AGG-8: a query with one ranking keeps that ranking's scores (qid, ranking, id, rank, score)."""
    fused = rrf(rankings, constant).withColumnRenamed("score", "fused")
    n = rankings.groupBy("qid").agg(F.countDistinct("ranking").alias("n_rankings"))
    own = rankings.groupBy("qid", "id").agg(F.max("score").alias("own"))
    return fused.join(own, ["qid", "id"]).join(n, "qid").select("qid", "id", F.when(F.col("n_rankings") == 1, F.col("own")).otherwise(F.col("fused")).alias("score"))


def hybrid(dense: DataFrame, sparse: DataFrame, k: int, constant: int = RRF_STORE) -> DataFrame:
    """TOP-3, AGG-9: the fusion of both rankings (already at their limits), ``k`` best of each query."""
    both = dense.select("qid", F.lit("dense").alias("ranking"), "id", "rank").unionByName(sparse.select("qid", F.lit("sparse").alias("ranking"), "id", "rank"))
    return ranked(rrf(both, constant), k, "score", "qid")


def margin_cut(hits: DataFrame, margin: float | None = MARGIN) -> DataFrame:
    """PRJ-14: within ``margin`` of the query's best; None cuts nothing."""
    if margin is None:
        return hits
    best = F.max("score").over(Window.partitionBy("qid"))
    return hits.withColumn("_best", best).filter(F.col("score") >= F.col("_best") - margin).drop("_best")


def rerank(hits: DataFrame, scorer: Column, margin: float | None = MARGIN, digits: int = 6) -> DataFrame:
    """TOP-4: scores replaced by ``scorer``, the cut, ranks anew. A query with one hit stays as it is, and one for which the
    scorer failed (a null among its scores) keeps the scores and the order it had, without a cut."""
    window = Window.partitionBy("qid")
    scored = hits.withColumn("_new", F.round(scorer, digits)).withColumn("_usable", (F.count("*").over(window) > 1) & (F.count("_new").over(window) == F.count("*").over(window)))
    scored = scored.withColumn("score", F.when(F.col("_usable"), F.col("_new")).otherwise(F.col("score"))).withColumn("_best", F.max("score").over(window))
    held = scored if margin is None else scored.filter(~F.col("_usable") | (F.col("score") >= F.col("_best") - margin))
    return ranked(held.drop("rank", "_new", "_usable", "_best"), None, "score", "qid")


def min_max(hits: DataFrame, score: str = "score") -> DataFrame:
    """AGG-18: ``relevance``: 0 to 1 within the query, 1 if all scores are the same."""
    window = Window.partitionBy("qid")
    low, high = F.min(score).over(window), F.max(score).over(window)
    return hits.withColumn("relevance", F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.lit(1.0)))


def select_diverse(scores: list[float], vectors: list, k: int, weight: float = LAMBDA) -> list[int]:
    """TOP-5: indices in order of selection: the highest relevance, then relevance against the closest already selected; ties to the least index."""
    n, weight = len(scores), min(max(weight, 0.0), 1.0)
    if n <= k:
        return list(range(n))
    score = np.asarray(scores, np.float64)
    span = score.max() - score.min()
    relevance = (score - score.min()) / span if span else np.ones(n)
    size = next((len(v) for v in vectors if v is not None), 1)
    matrix = np.array([np.zeros(size) if v is None else v for v in vectors], np.float64)
    norms = np.linalg.norm(matrix, axis=1)
    matrix /= np.where(norms > 0, norms, 1)[:, None]
    present = np.array([v is not None for v in vectors])
    closest, open_, picked = np.full(n, -np.inf), np.ones(n, bool), []
    while len(picked) < k:
        penalty = np.where(np.isfinite(closest) & present, closest, 0.0)
        value = np.where(open_, weight * relevance - (1 - weight) * penalty if picked else relevance, -np.inf)
        best = int(np.argmax(np.round(value, 12)))
        picked.append(best)
        open_[best] = False
        if present[best]:
            closest = np.maximum(closest, matrix @ matrix[best])
    return picked


def mmr(hits: DataFrame, k: int, weight: float = LAMBDA) -> DataFrame:
    """TOP-5 for every query: (qid, id, score, pick) from hits (qid, id, score, vector); groups are the queries' candidate lists, bounded by their limit."""

    def select(table: pa.Table) -> pa.Table:
        table = table.sort_by([("score", "descending"), ("id", "ascending")])
        picked = select_diverse(table["score"].to_pylist(), table["vector"].to_pylist(), k, weight)
        return table.take(pa.array(picked, pa.int64())).select(["qid", "id", "score"]).append_column("pick", pa.array(range(1, len(picked) + 1), pa.int32()))

    kind = lambda c: hits.schema[c].dataType.simpleString()
    return hits.select("qid", "id", "score", "vector").groupBy("qid").applyInArrow(select, f"qid {kind('qid')}, id {kind('id')}, score double, pick int")


def best_per_key(rows: DataFrame, key: str, score: str, order: str, *columns: str) -> DataFrame:
    """AGG-7, WIN-2: the row of the highest score of each key, the first of equals, as one aggregation (no sort, combined before the shuffle)."""
    best = F.max_by(F.struct(*columns), F.struct(F.col(score), -F.col(order))).alias("best")
    return rows.groupBy(key).agg(best).select(key, "best.*")


def group_hits(hits: DataFrame, files: DataFrame, number: int, size: int, key: str = "file_id") -> DataFrame:
    """TOP-11, JOIN-1, PRJ-12 for every query: best chunk of each file, ranked, a page of them joined to the catalog.

    Hits (qid, file_id, score, rank, text). ``total`` counts files with a hit, also those the catalog no longer has.
    """
    best = hits.groupBy("qid", key).agg(F.max_by(F.struct("score", "text", "rank"), F.struct(F.col("score"), -F.col("rank"))).alias("b")).select("qid", key, "b.*")
    window = Window.partitionBy("qid").orderBy(F.desc("score"), "rank")
    placed = best.withColumn("place", F.row_number().over(window).cast("long")).withColumn("total", F.count("*").over(Window.partitionBy("qid")))
    shown = placed.filter((F.col("place") > (number - 1) * size) & (F.col("place") <= number * size))
    return shown.join(files, key).select("qid", "place", key, *[c for c in files.columns if c != key], F.round("score", 4).alias("relevance_score"), tx.search_snippet(F.col("text")).alias("snippet"), "total")

"""A persisted inverted index, and exact BM25 from it with block-max pruning (JOIN-6, AGG-16, AGG-17, TOP-2).

``build`` tokenises the documents once and writes, below one folder:

- ``postings``: a row for each term and range of documents, with their ids, term frequencies and lengths, their number, the sum of
  the frequencies, and two numbers that bound what the term can add to a score there, the highest frequency and the least length. Documents are dealt to ranges of
  about ``range_docs`` by the hash of their ids, so a row is bounded however frequent its term is. Files are sorted by term: a
  query's terms prune row groups and pages; and they are buckets by range, so ranges are scored where they are read;
- ``terms``: the document frequency of each term;
- ``size``: the number of documents, their mean length, the number of ranges.

``top`` reads no document. The bounds of a query's terms, summed by range, say what a document there can score at most. The
ranges with the highest bounds are scored first; the k-th score found is a threshold, and of the other ranges only those whose
bound reaches it are read and scored. No postings are shuffled for it, however many terms the queries have: queries come to the ranges
with their terms; there, a term's postings meet the queries that have it as an outer product, some queries at a time. Every score
of every document that can be among the k best is computed in full, so results are exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import stage, staging_path
from .retrieval import BM25_B, BM25_K1, ranked

#: Documents of a range; terms of the queries that are scored together in it; ranges of each query that are scored first; terms that are pushed into the scan.
RANGE_DOCS, BLOCK_TERMS, FIRST_RANGES, PUSHED_TERMS = 4096, 4096, 4, 1000
#: Texts whose tokens are found at once; most tasks that make postings.
SLICE_TEXTS, MOST_TASKS = 1024, 4096
_EPSILON = 1e-5  # scores are rounded


def _counted(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms in order, and of each term and text that has it: the term's number, the text's number, how often; tokens of each text) of lower-case texts."""
    pieces, lengths = [pa.array([], pa.string())], [np.zeros(0, np.int64)]
    for chunk in texts.chunks:
        for at in range(0, len(chunk), SLICE_TEXTS):
            found, n = tx.token_runs(chunk.slice(at, SLICE_TEXTS))
            pieces.append(found)
            lengths.append(n)
    lengths = np.concatenate(lengths)
    coded = pa.chunked_array(pieces).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    key, tf = np.unique(place[coded.indices.to_numpy()] * max(1, len(lengths)) + owner, return_counts=True)
    return coded.dictionary.take(pa.array(order)), key // max(1, len(lengths)), key % max(1, len(lengths)), tf, lengths


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """AGG-17: (term, id, dl, tf): term counts of each document with its length in tokens."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(at, SLICE_TEXTS) for batch in source for at in range(0, batch.num_rows, SLICE_TEXTS)):
            terms, term, doc, tf, lengths = _counted(pa.chunked_array([part.column("text")]))
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(term)), part.column("id").take(pa.array(doc)), pa.array(lengths[doc]), pa.array(tf, pa.int64())], ["term", "id", "dl", "tf"])

    rows = docs.select(F.col(doc_id).alias("id"), F.lower(F.col(text)).alias("text"))
    return rows.mapInArrow(batches, f"term string, id {rows.schema['id'].dataType.simpleString()}, dl long, tf long")


def document_frequencies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """AGG-16: (term, df, tf) of documents without an index: counted within documents, summed before the shuffle and after it."""
    return postings(docs, doc_id, text).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def _blocks(table: pa.Table) -> pa.Table:
    """The postings of one range of documents (id, text, range): a row for each term."""
    terms, term, doc, tf, lengths = _counted(table["text"])
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    edges = pa.array(np.append(first, len(term)), pa.int32())
    length, n = lengths[doc], len(first)
    most, least, total = (f.reduceat(x, first) if n else np.zeros(0, np.int64) for f, x in ((np.maximum, tf), (np.minimum, length), (np.add, tf)))
    lists = [pa.ListArray.from_arrays(edges, x) for x in (table["id"].combine_chunks().take(pa.array(doc)), pa.array(tf, pa.int32()), pa.array(length, pa.int64()))]
    number = table["range"][0].as_py()
    columns = [terms, pa.array([number] * n, pa.int32()), pa.array(most, pa.int32()), pa.array(least, pa.int64()), pa.array(np.diff(edges.to_numpy()), pa.int64()), pa.array(total, pa.int64()), *lists]
    return pa.table(columns, names=["term", "range", "most_tf", "least_length", "n", "total", "ids", "tfs", "lengths"])


class InvertedIndex:
    """An index that ``build`` has written at ``path``."""

    def __init__(self, spark: SparkSession, path: str, table: str | None = None) -> None:
        """``table``: the postings' name in the session's catalog, if they have one."""
        self.spark, self.path = spark, path
        size = spark.read.parquet(f"{path}/size").first()
        self.n, self.mean_length, self.ranges = size["n"], size["mean_length"], size["ranges"]
        self.table = table or ("kind" in size and self._table(size["kind"]))  # folders of before the buckets have none

    def _table(self, kind: str) -> str:
        """A name in the session's catalog for the postings of ids of this type, by which Spark knows their buckets."""
        name, place = f"lodestar_{uuid.uuid4().hex}", f"{self.path}/postings".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} ({_columns(kind)}) USING parquet CLUSTERED BY (`range`) SORTED BY (`term`, `range`) INTO {_buckets(self.ranges)} BUCKETS LOCATION '{place}'")
        return name

    @classmethod
    def build(cls, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, range_docs: int = RANGE_DOCS) -> InvertedIndex:
        """Index all of ``docs``; documents with null ids or texts count as documents without terms and are never found. ``path``: a new folder that all executors share, by default one below the checkpoint folder."""
        spark, path = docs.sparkSession, path or staging_path(docs.sparkSession, "inverted-index")
        n = docs.count()
        ranges = max(1, -(-n // range_docs))
        # the texts are dealt out by range, so that a range's terms are counted and its postings made in one task; no posting is shuffled
        each = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.lower(F.col(text)).alias("text")).withColumn("range", F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int"))
        kind = each.schema["id"].dataType.simpleString()
        blocks = each.repartition(_buckets(ranges), "range").groupBy("range").applyInArrow(_blocks, _columns(kind))
        table = f"lodestar_{uuid.uuid4().hex}"
        blocks.write.format("parquet").bucketBy(_buckets(ranges), "range").sortBy("term", "range").option("path", f"{path}/postings").saveAsTable(table)  # a task is a bucket
        counts = spark.table(table).groupBy("term").agg(F.sum("n").alias("df"), F.sum("total").alias("tf"))
        counts.sortWithinPartitions("term").write.parquet(f"{path}/terms")
        length = spark.read.parquet(f"{path}/terms").agg(F.sum("tf").alias("length")).first()["length"] or 0
        spark.createDataFrame([(n, length / n if n else 0.0, ranges, kind)], "n long, mean_length double, ranges int, kind string").coalesce(1).write.parquet(f"{path}/size")
        return cls(spark, path, table)

    def postings(self) -> DataFrame:
        return self.spark.table(self.table) if self.table else self.spark.read.parquet(f"{self.path}/postings")

    def terms(self) -> DataFrame:
        """AGG-16: (term, df, tf)."""
        return self.spark.read.parquet(f"{self.path}/terms")

    def _saturation(self, tf: Column, length: Column) -> Column:
        return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / F.lit(self.mean_length)))

    def weights(self, queries: DataFrame, saturated: bool = False) -> DataFrame:
        """(qid, term, weight) of the terms that some document has: distinct, by IDF, and by their own saturated frequency if ``saturated``."""
        terms = queries.select("qid", F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
        own = F.col("qtf") * (BM25_K1 + 1) / (F.col("qtf") + BM25_K1) if saturated else F.lit(1.0)
        idf = F.log(1 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return terms.join(self.terms().select("term", "df"), "term").select("qid", "term", (own * idf).alias("weight"))

    def _held(self, weights: DataFrame, rows: int) -> DataFrame:
        """The postings of the queries' terms (``rows`` in all) if those are few, which are pushed into the scan; else all, of which a range's are thinned out where they are scored, since a join by term would shuffle them."""
        if rows > 4 * PUSHED_TERMS:
            return self.postings()
        few = [r["term"] for r in weights.select("term").distinct().collect()]
        return self.postings().filter(F.col("term").isin(few)) if len(few) <= PUSHED_TERMS else self.postings()

    def _met(self, pairs: DataFrame, weights: DataFrame, held: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], columns: str) -> DataFrame:
        """What ``f`` makes of the postings ``held`` of each range and of the queries that are asked there, ``pairs`` (qid, range, ...) with their terms and weights.

        A range's postings are in one bucket and stay there; the queries come to it.
        """
        asked = weights.groupBy("qid").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))  # a query's terms
        asked = pairs.repartition(_buckets(self.ranges), "range").join(asked, "qid").select(*pairs.columns, F.col("terms.term").alias("terms"), F.col("terms.weight").alias("weights"))
        return held.groupBy("range").cogroup(asked.groupBy("range")).applyInArrow(f, f"qid {pairs.schema['qid'].dataType.simpleString()}, {columns}")

    def _every(self, weights: DataFrame) -> DataFrame:
        """(qid, range) of each query and range."""
        return weights.select("qid").distinct().withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(self.ranges - 1))))

    def bounds(self, weights: DataFrame, held: DataFrame) -> DataFrame:
        """(qid, range, bound): what a document of the range can score at most, if one has any of the query's terms."""
        most = self._saturation(F.col("most_tf"), F.col("least_length"))
        return self._met(self._every(weights), weights, held.select("range", "term", most.alias("most")), _bound, "range int, bound double")

    def _scored(self, pairs: DataFrame, weights: DataFrame, held: DataFrame, k: int, digits: int) -> DataFrame:
        """(qid, id, score): the ``k`` best of each query in each of its ranges (qid, range, least: the score below which nothing is wanted, or null), more if scores tie."""
        kind = held.schema["ids"].dataType.elementType.simpleString()
        return self._met(pairs, weights, held.select("range", "term", "ids", "tfs", "lengths"), _best(k, self.mean_length, digits), f"id {kind}, score double")

    def top(self, queries: DataFrame, k: int, saturated: bool = False, digits: int = 6, first: int = FIRST_RANGES) -> DataFrame:
        """(qid, id, score, rank) of the ``k`` best documents of each query (qid, text)."""
        weights = stage(self.weights(queries, saturated), "query-terms")
        rows = weights.count()
        held, least = self._held(weights, rows), F.lit(None).cast("double").alias("least")
        if self.ranges <= first:  # every range would be among the first
            return ranked(self._scored(self._every(weights).select("qid", "range", least), weights, held, k, digits), k, "score", "qid")
        bounds = stage(self.bounds(weights, held), "bounds")
        begun = ranked(bounds, first, "bound", "qid", order="range", name="place").select("qid", "range", least)
        found = stage(ranked(self._scored(begun, weights, held, k, digits), k, "score", "qid"), "first-scores")
        threshold = found.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        rest = bounds.join(begun, ["qid", "range"], "left_anti").join(threshold, "qid", "left").filter(f"least IS NULL OR bound >= least - {_EPSILON}").select("qid", "range", "least")
        more = self._scored(rest, weights, held, k, digits)
        return ranked(found.drop("rank").unionByName(more), k, "score", "qid")


def _buckets(ranges: int) -> int:
    return min(ranges, MOST_TASKS)


def _columns(kind: str) -> str:
    return f"term string, range int, most_tf int, least_length long, n long, total long, ids array<{kind}>, tfs array<int>, lengths array<long>"


def _flat(table: pa.Table, name: str) -> pa.Array:
    return table[name].combine_chunks().flatten()


def _owners(asked: pa.Table) -> np.ndarray:
    """Of all terms of the queries, the query's row."""
    return np.repeat(np.arange(asked.num_rows), np.asarray(pc.list_value_length(asked["terms"]))) if asked.num_rows else np.zeros(0, np.int64)


def _bound(table: pa.Table, asked: pa.Table) -> pa.Table:
    row = pc.index_in(_flat(asked, "terms"), table["term"].combine_chunks()).fill_null(-1).to_numpy()  # of each query and term, the postings
    query, part, n = _owners(asked)[row >= 0], _flat(asked, "weights").to_numpy()[row >= 0] * table["most"].to_numpy()[row[row >= 0]], asked.num_rows
    found = np.flatnonzero(np.bincount(query, minlength=n))
    return pa.table([asked["qid"].take(pa.array(found)), asked["range"].take(pa.array(found)), pa.array(np.bincount(query, part, n)[found], pa.float64())], names=["qid", "range", "bound"])


def _best(k: int, mean_length: float, digits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def score(table: pa.Table, asked: pa.Table) -> pa.Table:
        edges = lambda name: np.append(0, np.cumsum(np.asarray(pc.list_value_length(table[name])), dtype=np.int64))
        table = table.filter(pc.is_in(table["term"], _flat(asked, "terms")))
        ids = _flat(table, "ids").dictionary_encode()
        n_docs, doc, d = len(ids.dictionary), ids.indices.to_numpy(), edges("ids")
        tf, length = _flat(table, "tfs").to_numpy().astype(np.float64), _flat(table, "lengths").to_numpy()
        part = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean_length))
        row = pc.index_in(_flat(asked, "terms"), table["term"].combine_chunks()).fill_null(-1).to_numpy()  # of each query and term, the postings
        query = _owners(asked)
        weight, floor = _flat(asked, "weights").to_numpy(), asked["least"].to_numpy(zero_copy_only=False).astype(np.float64)
        floor = np.where(np.isnan(floor), -np.inf, floor) - _EPSILON
        query, weight, row = (x[row >= 0] for x in (query, weight, row))
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        at_once = max(1, BLOCK_TERMS * asked.num_rows // max(1, len(query)))
        for at in range(0, asked.num_rows if len(query) else 0, at_once):
            a, b = np.searchsorted(query, [at, at + at_once])
            order = a + np.argsort(row[a:b], kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(row[order]) != 0)) if b > a else np.zeros(0, np.int64)
            scores = np.zeros((min(at_once, asked.num_rows - at), n_docs))
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), b - a]):
                own, docs = order[i:j], slice(d[row[order[i]]], d[row[order[i]] + 1])
                scores[np.ix_(query[own] - at, doc[docs])] += np.outer(weight[own], part[docs])
            for i, (mine, least) in enumerate(zip(scores, floor[at : at + at_once])):
                place = np.flatnonzero(mine >= least) if least > 0 else np.flatnonzero(mine > 0)
                found = np.round(mine[place], digits)
                if len(place) > k:
                    keep = found >= np.partition(found, -k)[-k]  # ties stay
                    place, found = place[keep], found[keep]
                out.append((np.full(len(place), at + i), place, found))
        q, place, found = (np.concatenate(x) for x in zip(*out))
        return pa.table([asked["qid"].combine_chunks().take(pa.array(q)), ids.dictionary.take(pa.array(place)), pa.array(found)], names=["qid", "id", "score"])

    return score

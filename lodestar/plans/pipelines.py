"""PIPE-1..9: the composite queries as lazy plans over many questions at once.

``chunks`` has chunk_id, file_id, source_id, category, file_name, page, text, context and dense. Filters are applied below both
rankings. Every group that meets in a Python worker is one question's candidate list, bounded by its limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import nullcontext
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.formats import index_status
from ..operators import catalog as ct
from ..operators import chunking, encoders, evaluate, prompts
from ..operators import retrieval as rt
from ..operators.cells import CellIndex
from ..operators.inverted import InvertedIndex
from ..session import stage
from ..sources import extract, scan
from .progress import Event, Progress


@dataclass(frozen=True)
class Indexes:
    """Kept indexes of one set of chunks: their dense vectors, and their texts under their contexts."""

    dense: CellIndex
    sparse: InvertedIndex


def index_chunks(chunks: DataFrame, path: str | None = None) -> Indexes:
    """Indexes of all of ``chunks``, a table that is read several times, below ``path`` (by default the checkpoint folder), to be given to searches of the same chunks."""
    dense = CellIndex.build(chunks.select(F.col("chunk_id").alias("id"), F.col("dense").alias("vector")), path and f"{path}/dense")
    return Indexes(dense, InvertedIndex.build(_passages(chunks), "chunk_id", path=path and f"{path}/sparse"))


def _passages(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", tx.embed_text(F.col("context"), F.col("text")).alias("text"))


@dataclass(frozen=True)
class Options:
    """Settings of a search; ``merged`` applies only those that are given. ``indexes`` serve searches without filters; the
    others compare all chunks that pass. ``timeouts`` bound the reading of a file by category (None: unbounded, in the task itself);
    ``registry`` has the extractors by extension, if not the usual ones."""

    encoder: encoders.Encoder = encoders.hashed_encoder()
    scorer: encoders.Scorer | None = encoders.overlap_scorer
    margin: float | None = rt.MARGIN
    use_mmr: bool = True
    weight: float = rt.LAMBDA
    overfetch: int = rt.OVERFETCH
    multimedia: bool = False
    indexes: Indexes | None = None
    timeouts: dict[str, float] | None = field(default_factory=lambda: dict(extract.TIMEOUTS))
    registry: dict[str, extract.Extractor] | None = None

    def merged(self, **given) -> Options:
        return Options(**(self.__dict__ | {k: v for k, v in given.items() if v is not None}))


def check_question(question: str, top_k: int) -> None:
    if not 1 <= len(question) <= 1000 or not 1 <= top_k <= 10:
        raise ValueError("a question has 1 to 1000 characters, top_k is 1 to 10")


def _filtered(chunks: DataFrame, source_id: str | None, categories: list[str] | None) -> DataFrame:
    return ct.equality(chunks, source_id=source_id, category=categories)


def hybrid_hits(questions: DataFrame, chunks: DataFrame, k: int, options: Options, source_id: str | None = None, categories: list[str] | None = None) -> DataFrame:
    """TOP-3: (qid, id, score, rank) of the ``k`` best chunks of each question (qid, question)."""
    held = _filtered(chunks, source_id, categories)
    texts = questions.select(F.col("qid").alias("id"), F.col("question").alias("text"))
    vectors = options.encoder(texts).withColumnRenamed("id", "qid")
    asked = questions.select("qid", F.col("question").alias("text"))
    indexes = options.indexes if source_id is None and not categories else None
    if indexes is not None:
        return rt.hybrid(indexes.dense.top(vectors, rt.dense_limit(k)), indexes.sparse.top(asked, rt.sparse_limit(k)), k)
    dense = rt.knn(held.select(F.col("chunk_id").alias("id"), F.col("dense").alias("vector")), vectors, rt.dense_limit(k))
    sparse = rt.bm25(_passages(held), asked, rt.sparse_limit(k), "chunk_id")
    return rt.hybrid(dense, sparse, k)


def _refine(hits: DataFrame, questions: DataFrame, chunks: DataFrame, k: int, options: Options, use_mmr: bool) -> DataFrame:
    """2.11.4: rerank, cut, diversify, the ``k`` best: hits with the chunk's columns. Hits are found once and thin out the chunks where those are read."""
    hits = stage(hits.select("qid", "id", "score", "rank"), "hits")
    columns = chunks.join(hits.select(F.col("id").alias("chunk_id")).distinct(), "chunk_id", "left_semi").withColumnRenamed("chunk_id", "id")
    rows = hits.join(columns, "id").join(questions.select("qid", "question"), "qid")
    if options.scorer:
        rows = rt.rerank(rows, options.scorer(F.col("question"), tx.embed_text(F.col("context"), F.col("text"))), options.margin)
    if options.use_mmr and use_mmr:
        picked = rt.mmr(rows.withColumn("vector", F.col("dense")), k, options.weight)
        rows = rows.drop("rank").join(picked.select("qid", "id", F.col("pick").cast("long").alias("rank")), ["qid", "id"])
    return rows.filter(F.col("rank") <= k).withColumnRenamed("id", "chunk_id").drop("question")


def retrieve(questions: DataFrame, chunks: DataFrame, k: int, options: Options = Options(), source_id: str | None = None, categories: list[str] | None = None, use_mmr: bool = True) -> DataFrame:
    """TOP-7: over-fetches only if something follows that needs it."""
    more = options.overfetch if options.scorer or options.use_mmr and use_mmr else 1
    return _refine(hybrid_hits(questions, chunks, k * more, options, source_id, categories), questions, chunks, k, options, use_mmr)


def retrieve_multi(variants: DataFrame, chunks: DataFrame, k: int, options: Options = Options(), source_id: str | None = None, categories: list[str] | None = None, use_mmr: bool = True) -> DataFrame:
    """TOP-8: variants (qid, variant, question), 0 the question itself: one ranking each, fused, refined once by the question."""
    each = variants.select(F.concat_ws("|", "qid", "variant").alias("key"), "qid", "variant", "question")
    hits = hybrid_hits(each.select(F.col("key").alias("qid"), "question"), chunks, k * options.overfetch, options, source_id, categories)
    rankings = hits.withColumnRenamed("qid", "key").join(each.select("key", "qid", F.col("variant").alias("ranking")), "key").select("qid", "ranking", "id", "rank", "score")
    fused = rt.ranked(rt.rrf_or_single(rankings), k * options.overfetch, "score", "qid")
    return _refine(fused, variants.filter("variant = 0"), chunks, k, options, use_mmr)


def search(queries: DataFrame, chunks: DataFrame, files: DataFrame, page: int = 1, limit: int = 15, category: str | None = None, source_id: str | None = None, options: Options = Options()) -> DataFrame:
    """PIPE-6's retrieval: best chunk of each file among 20 chunks, a page of files (qid, question)."""
    hits = retrieve(queries, chunks, 20, options, source_id, [category] if category else None, use_mmr=False)
    return rt.group_hits(hits.select("qid", "file_id", "score", "rank", "text"), files, page, limit)


def search_files(question: str, chunks: DataFrame | None, files: DataFrame, page: int = 1, limit: int = 15, category: str | None = None, source_id: str | None = None, options: Options = Options()) -> DataFrame:
    """PIPE-6 for one query: a blank one lists the files; without chunks, or where retrieval can't be planned, names and paths are matched instead."""
    if question.strip() and chunks is not None:
        try:
            asked = files.sparkSession.createDataFrame([(0, question)], "qid long, question string")
            return search(asked, chunks, files, page, limit, category, source_id, options)
        except (AnalysisException, ValueError):  # an encoder or scorer that doesn't fit
            pass
    return list_files(files, page, limit, category, source_id, question)


def list_files(files: DataFrame, page: int = 1, limit: int = 15, category: str | None = None, source_id: str | None = None, query: str = "") -> DataFrame:
    """PIPE-6 without retrieval: a blank query lists, another matches names and paths; by name."""
    rows = ct.with_source(ct.equality(files, category=category), source_id)
    rows = ct.name_search(rows, query, "name", "path") if query.strip() else rows
    return ct.page(rows, page, limit, F.asc("name"), F.asc("file_id"))


def ask(questions: DataFrame, chunks: DataFrame, k: int = 5, options: Options = Options(), variants: DataFrame | None = None, source_id: str | None = None, categories: list[str] | None = None, answer: Column | None = None, full_context: bool = False, expander: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """PIPE-7: (citations, answers): answers have qid, question, prompt, has_hits, answer; without hits a fixed one.

    ``expander`` (text over question, a variant a line) makes the variants, unless they are given.
    """
    if variants is None and expander is not None:
        variants = encoders.expanded(questions, expander)
    hits = retrieve_multi(variants, chunks, k, options, source_id, categories) if variants is not None else retrieve(questions, chunks, k, options, source_id, categories)
    made = prompts.prompts(questions, hits)
    text = encoders.extractive_answer(F.regexp_extract("prompt", r"(?s)Passages:\n(.*)\n\nQuestion:", 1), F.col("question")) if answer is None else answer
    return prompts.citations(hits, full_context), made.withColumn("answer", F.when(F.col("has_hits"), tx.strip_think(text)).otherwise(prompts.NO_HITS))


def _phase(progress: Progress | None, kind: str, items: DataFrame):
    """The phase of one call an item; without progress, nothing to call."""
    return progress.phase(kind, items.count()) if progress else nullcontext()


def _counted(rows: DataFrame, seen: Callable[[], None]) -> DataFrame:
    """The same rows; ``seen`` is called on the workers for each."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for _ in range(batch.num_rows):
                seen()
            yield batch

    return rows.mapInArrow(batches, rows.schema)


def _extracted(wanted: DataFrame, root: str, options: Options, registry: dict | None, seen: Callable[[], None] | None) -> DataFrame:
    texts = extract.extract(wanted.select("path", "extension", "category", "content"), registry, timeouts=options.timeouts, seen=seen)
    rows = wanted.drop("content").join(texts, "path").withColumn("context", tx.path_context(F.col("path"), F.lit(root)))
    rows = rows.withColumn("error", F.when(F.col("error") == "unsupported", "skipped").otherwise(F.col("error")))
    return stage(rows, "extracted")  # every file is read and extracted once


def _encoded(cut: DataFrame, options: Options, seen: Callable[[], None] | None) -> DataFrame:
    passages = cut.select(F.col("chunk_id").alias("id"), tx.embed_text(F.col("context"), F.col("text")).alias("text"))
    vectors = options.encoder(passages)
    vectors = _counted(vectors, seen) if seen else vectors
    made = cut.join(vectors.select(F.col("id").alias("chunk_id"), F.col("vector").alias("dense")), "chunk_id", "left").withColumn("file_id", F.col("path"))
    return stage(made, "chunks")  # and encoded once


def prepare(files: DataFrame, root: str, options: Options = Options(), registry: dict | None = None, progress: Progress | None = None) -> tuple[DataFrame, DataFrame]:
    """PIPE-3, PIPE-4: (chunks with vectors, status of each file) of scanned files with their content (see ``scan.scan``).

    A blank text leaves one chunk with the file's name; its note says so, and the file counts as done.
    """
    wanted = ct.indexable(files, options.multimedia)
    with _phase(progress, "extracting_progress", wanted) as seen:
        rows = _extracted(wanted, root, options, registry or options.registry, seen)
    usable = chunking.rescue(rows.filter(F.col("error").isNull()))
    cut = chunking.chunks(usable, id_col="path", pages_col="page_map").withColumnRenamed("doc_id", "path")
    cut = cut.join(usable.select("path", "context", "category", "extension", F.col("name").alias("file_name")), "path")
    if progress:
        cut = stage(cut, "cut")  # counted before they are encoded
        progress.event("embedding_start", 0, cut.count())
    with _phase(progress, "embedding_progress", cut) as seen:
        made = _encoded(cut, options, seen)
    if progress:
        progress.event("indexing_progress", n := made.select("path").distinct().count(), n)
    counts = made.groupBy("path").agg(F.count("dense").alias("indexed_chunks"), F.count("*").alias("n_chunks"))
    status = rows.select("path", "extractor", "error").join(counts, "path", "left").na.fill(0, ["indexed_chunks", "n_chunks"])
    lost = (F.col("n_chunks") > 0) & (F.col("indexed_chunks") == 0)
    status = status.withColumn("index_status", F.when(lost, "failed").otherwise(index_status(F.col("error"), F.col("indexed_chunks")))).drop("n_chunks")
    return made.filter(F.col("dense").isNotNull()), status


def index_file(files: DataFrame, path: str, chunks: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """PIPE-5: (chunks with those of this file replaced, its status) of one scanned file, without path context."""
    made, status = prepare(files.filter(F.col("path") == path), "", options)
    made = made.withColumn("context", F.lit(""))
    return ct.delete_where(chunks, F.col("file_id") == path).unionByName(made, allowMissingColumns=True), status


def ingest(spark, root: str, source_id: str, catalog: DataFrame | None = None, chunks: DataFrame | None = None, options: Options = Options(), on_progress: Callable[[str, Event], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """PIPE-1, PIPE-2: (files, chunks) of a source after a scan; with a catalog only what the incremental diff finds is read again.

    ``on_progress(source_id, event)`` is called on the driver while the tasks run, with events that STR-4 folds (see ``progress``).
    """
    progress = Progress(spark, source_id, on_progress) if on_progress else None
    try:
        got = _ingested(spark, root, source_id, catalog, chunks, options, progress)
    except Exception as e:
        if progress:
            progress.event("error", message=f"{type(e).__name__}: {e}"[:300])
        raise
    if progress:
        progress.event("done")
    return got


def _ingested(spark, root: str, source_id: str, catalog: DataFrame | None, chunks: DataFrame | None, options: Options, progress: Progress | None) -> tuple[DataFrame, DataFrame]:
    listing = scan.scan(spark, root, content=True)
    if progress:
        progress.event("scanning")
        progress.event("progress", n := listing.select("path").count(), n)
    if catalog is None:
        made, status = prepare(listing, root, options, progress=progress)
        files = listing.drop("content").withColumn("source_id", F.lit(source_id)).join(status, "path", "left")
        return files, made.withColumn("source_id", F.lit(source_id))
    diff = ct.incremental_diff(catalog.select("path", "modified_at", "size", "index_status"), listing.select("path", "modified_at", "size"))
    todo = ct.to_index(diff)
    made, status = prepare(listing.join(todo, "path", "left_semi"), root, options, progress=progress)
    fresh = listing.drop("content").join(todo, "path", "left_semi").withColumn("source_id", F.lit(source_id)).join(status, "path", "left")
    gone = diff.filter("state = 'deleted'").select("path").unionByName(todo)
    kept = ct.delete_keys(catalog, gone, "path").unionByName(fresh, allowMissingColumns=True)
    return kept, ct.delete_keys(chunks, gone, "path").unionByName(made.withColumn("source_id", F.lit(source_id)), allowMissingColumns=True)


def score_pipeline(dataset: DataFrame, chunks: DataFrame, k: int, options: Options = Options()) -> DataFrame:
    """PIPE-9: a report over (qid, question, relevant_ids, latency): file-level recall and reciprocal rank of each question."""
    hits = retrieve(dataset.select("qid", "question"), chunks, k, options)
    got = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file_id"))), lambda x: x["file_id"]).alias("got"))  # k of each
    rows = dataset.join(got, "qid", "left").withColumn("got", F.array_distinct(F.coalesce("got", F.array().cast("array<string>"))))
    return evaluate.report(rows.select(evaluate.recall(F.col("got"), F.col("relevant_ids")).alias("recall"), evaluate.reciprocal_rank(F.col("got"), F.col("relevant_ids")).alias("rr"), "latency"))


def read_dataset(spark, path: str) -> DataFrame:
    """SRC-29: a JSON array of questions with their relevant ids."""
    return spark.read.option("multiLine", True).schema("question string, relevant_ids array<string>, metadata map<string,string>").json(path).withColumn("qid", F.xxhash64("question"))


def write_results(rows: DataFrame, path: str) -> None:
    """SNK-11: CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)

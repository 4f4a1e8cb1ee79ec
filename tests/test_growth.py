"""Steps that grow with the tables: what they hold and how often they pass it on."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.operators import cells, encoders, inverted, retrieval
from lodestar.plans import pipelines
from lodestar.streaming import events


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_few_queries_of_a_cell_are_one_pack(spark):
    """A ring meets every pack of its cell: 40 queries, of one cell, are one pack, not one for each remainder of a hash."""
    rng = np.random.default_rng(1)
    frame = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(200)], "id long, vector array<double>")
    index = cells.CellIndex.build(frame, cells=1)
    queries = frame.filter("id < 40").withColumnRenamed("id", "qid")
    asked = index._asked(queries, 1, 3).select("qid", "cell", "away", F.lit(-2.0).alias("least"))
    plan = index._compared(asked, queries, 3, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(xxhash64(qid" in plan and "), 1)" in plan and "), 64)" not in plan


def test_knn_by_few_queries_at_once_equals_all(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "AT_ONCE", 3)
    rng = np.random.default_rng(2)
    frame = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(50)], "id long, vector array<double>")
    queries = frame.filter("id < 10").withColumnRenamed("id", "qid")
    got = {tuple(r) for r in retrieval.knn(frame, queries, 4).collect()}
    assert got == {tuple(r) for r in cells.CellIndex.build(frame).top(queries, 4).collect()} and len(got) == 40


def test_only_texts_that_may_change_go_to_python(spark):
    rows = spark.createDataFrame([(1, "e\u0301\x00 a\ufffd"), (2, "plain\n  é"), (3, None), (4, ""), (5, "\u1e9b\u0323 \u212b")], "i int, t string")
    found = rows.select("i", tx.sanitise(F.col("t")).alias("t"))
    assert dict(map(tuple, found.collect())) == {1: "\u00e9 a", 2: "plain é", 3: None, 4: "", 5: "\u1e9b\u0323 \u00c5"}
    assert "CASE WHEN RLIKE(t" in found._jdf.queryExecution().optimizedPlan().toString()


def test_channels_over_many_batches_equal_those_of_each_answer(spark):
    """One pass over sorted tokens, no group an answer."""
    rng = random.Random(3)
    answers = {f"a{i}": ["".join(rng.choice(["<think>", "</think>", "<th", "ink>", "x", "</"]) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 12))] for i in range(60)} | {None: ["a<thi", None, "nk>b"]}
    rows = [(k, i, t) for k, v in answers.items() for i, t in enumerate(v)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        found = events.token_channels(spark.createDataFrame(rows, "answer_id string, seq int, token string"))
        got = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(k, i, kind, text) for k, v in answers.items() for i, (kind, text) in enumerate(events.split_channels([t or "" for t in v]))]
    assert sorted(got, key=str) == sorted(want, key=str) and "FlatMapGroups" not in plan_of(found)


def test_hits_thin_out_the_chunks_where_they_are_read(spark, tmp_path):
    chunks = spark.createDataFrame([(i, "f", "s", "c", "f.txt", None, f"word{i} common", "", None) for i in range(30)], "chunk_id long, file_id string, source_id string, category string, file_name string, page int, text string, context string, dense array<float>")
    dense = encoders.hashed_encoder()(chunks.select(F.col("chunk_id").alias("id"), "text"))
    dense.write.parquet(f"{tmp_path}/dense")
    chunks.drop("dense").write.parquet(f"{tmp_path}/chunks")
    kept = spark.read.parquet(f"{tmp_path}/chunks").join(spark.read.parquet(f"{tmp_path}/dense").select(F.col("id").alias("chunk_id"), F.col("vector").alias("dense")), "chunk_id")
    asked = spark.createDataFrame([(1, "word3"), (2, "word7 common")], "qid long, question string")
    found = pipelines.retrieve(asked, kept, 2, pipelines.Options(scorer=None, use_mmr=False))
    assert {(r.qid, r.chunk_id) for r in found.filter("rank = 1").collect()} == {(1, 3), (2, 7)}
    assert "LeftSemi" in plan_of(found)


def test_postings_are_brought_together_once_for_all_queries(spark, monkeypatch):
    """A range's postings meet every query in one group: no group, and so no copy of them, for each block of queries."""
    monkeypatch.setattr(inverted, "BLOCK_TERMS", 2)
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} all " * (1 + i % 3)) for i in range(120)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"w{i % 7} all x{i}") for i in range(30)], "qid long, text string")
    index = inverted.InvertedIndex.build(docs, range_docs=20)
    assert index.ranges == 6
    found = index.top(queries, 4)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in retrieval.bm25(docs, queries, 4).collect()}
    plan = plan_of(found)
    assert "FlatMapCoGroupsInArrow" in plan and "FlatMapGroupsInArrow" not in plan


def test_a_query_goes_once_to_a_part_of_the_cells(spark, monkeypatch):
    """Vectors are shuffled for each part, not for each cell: 12 cells in at most 5 parts."""
    monkeypatch.setattr(cells, "PART_VECTORS", 40)
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(200)], "id long, vector array<double>")
    index = cells.CellIndex.build(frame, cells=12, block=9)
    queries = frame.filter("id < 30").withColumnRenamed("id", "qid")
    asked = index._asked(queries, 1, 3).select("qid", "cell", "away", F.lit(-2.0).alias("least"))
    assert asked.count() == 30 * 12
    plan = index._compared(asked, queries, 3, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(xxhash64(cell" in plan and "), 5)" in plan
    assert {tuple(r)[:2] for r in index.top(queries, 3).collect()} == {tuple(r)[:2] for r in retrieval.knn(frame, queries, 3).collect()}


def test_postings_of_many_terms_are_not_shuffled(spark, monkeypatch, tmp_path):
    """Ranges are scored where their postings are read, whether the queries' terms are pushed into the scan or too many for it."""
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} all v{i} " * (1 + i % 3)) for i in range(120)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"w{i % 7} all v{i} x{i}") for i in range(40)], "qid long, text string")
    want = {tuple(r) for r in retrieval.bm25(docs, queries, 4).collect()}
    inverted.InvertedIndex.build(docs, range_docs=20, path=f"{tmp_path}/it's an index")
    index = inverted.InvertedIndex(spark, f"{tmp_path}/it's an index")  # a folder that was written before
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for pushed in (1000, 1):
            monkeypatch.setattr(inverted, "PUSHED_TERMS", pushed)
            for first in (inverted.FIRST_RANGES, index.ranges):
                found = index.top(queries, 4, first=first)
                plan = found._jdf.queryExecution().executedPlan().toString()
                scan = next(i for i, line in enumerate(plan.splitlines()) if "FileScan parquet" in line and "tfs" in line)
                above = plan.splitlines()[:scan]
                cogroup = max(i for i, line in enumerate(above) if "FlatMapCoGroupsInArrow" in line)
                assert not any("Exchange" in line or "Join" in line for line in above[cogroup:]) and "Bucketed: true" in plan
                assert {tuple(r) for r in found.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

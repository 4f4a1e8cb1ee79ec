"""The persisted indexes against plain computation over all documents and all vectors."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestar.operators import cells, inverted
from lodestar.operators import retrieval as rt


def plain_bm25(docs, queries, k, saturated=False):
    toks = {d: re.findall("[a-z0-9à-öø-ÿ]+", (t or "").lower()) for d, t in docs if d is not None}
    n = len(docs)
    mean = sum(map(len, toks.values())) / n
    df = Counter(w for ts in toks.values() for w in set(ts))
    out = set()
    for q, text in queries:
        wanted = Counter(re.findall("[a-z0-9à-öø-ÿ]+", (text or "").lower()))
        scores = {}
        for d, ts in toks.items():
            tf = Counter(ts)
            s = sum(
                (qtf * 2.2 / (qtf + 1.2) if saturated else 1) * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ts) / mean))
                for w, qtf in wanted.items() if w in tf
            )
            if any(w in tf for w in wanted):
                scores[d] = round(s, 6)
        for rank, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((q, d, s, rank))
    return out


def some_docs(rng, n):
    words = [f"w{i}" for i in range(60)] + ["é", "A1", "the"]
    return [(i, " ".join(rng.choice(words[: rng.randint(2, 63)]) for _ in range(rng.randint(0, 40)))) for i in range(n)] + [(n, None), (n + 1, ""), (None, "w1 w2"), (n + 2, "w3 " * 500)]


@pytest.mark.parametrize("range_docs, saturated, pushed", [(1000, False, 1000), (8, True, 1000), (3, False, 0)])
def test_bm25_equals_scoring_all(spark, range_docs, saturated, pushed, monkeypatch):
    monkeypatch.setattr(inverted, "PUSHED_TERMS", pushed)
    monkeypatch.setattr(inverted, "BLOCK_TERMS", 5)
    rng = random.Random(range_docs)
    docs, queries = some_docs(rng, 150), [("a", "w1 W2 w2 nothing"), ("b", "the é"), ("c", ""), ("d", None), ("e", "zzz"), *[(f"q{i}", f"w{rng.randrange(60)} w{rng.randrange(60)} a1") for i in range(8)]]
    index = inverted.InvertedIndex.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), range_docs=range_docs)
    assert index.n == len(docs) and index.ranges == math.ceil(len(docs) / range_docs)
    got = index.top(spark.createDataFrame(queries, "qid string, text string"), 5, saturated).collect()
    assert {(r.qid, r.id, r.score, r.rank) for r in got} == plain_bm25(docs, queries, 5, saturated)


def test_counts_of_terms(spark):
    docs = some_docs(random.Random(2), 40)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    toks = [re.findall("[a-z0-9à-öø-ÿ]+", (t or "").lower()) for d, t in docs if d is not None]
    got = {r.term: (r.df, r.tf) for r in inverted.InvertedIndex.build(frame).terms().collect()}
    assert got == {w: (sum(w in t for t in toks), sum(t.count(w) for t in toks)) for w in {w for t in toks for w in t}}
    rows = rt.postings(frame.filter("doc_id IS NOT NULL")).collect()
    assert {(r.term, r.id): (r.tf, r.dl) for r in rows} == {(w, d): (n, len(t)) for d, t in zip([d for d, _ in docs if d is not None], toks) for w, n in Counter(t).items()}


def test_ranges_that_cannot_hold_a_hit_are_not_read(spark):
    """One range has the rare term; only ranges whose bound reaches the threshold are scored."""
    docs = [(i, "common " * 5 + ("rare " * 3 if i % 64 == 0 else "")) for i in range(640)]
    index = inverted.InvertedIndex.build(spark.createDataFrame(docs, "doc_id long, text string"), range_docs=16)
    queries = spark.createDataFrame([(1, "rare common")], "qid long, text string")
    seen, scored = [], inverted.InvertedIndex._scored
    index._scored = lambda pairs, *a: seen.append(pairs.count()) or scored(index, pairs, *a)
    assert {(r.qid, r.id, r.score, r.rank) for r in index.top(queries, 3, first=4).collect()} == plain_bm25(docs, [(1, "rare common")], 3)
    assert index.ranges == 40 and seen[0] == 4 and sum(seen) < 20


def test_searching_reads_no_document_and_an_index_can_be_opened_again(spark, tmp_path):
    spark.createDataFrame([(i, f"word{i % 7} text") for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    inverted.InvertedIndex.build(spark.read.parquet(f"{tmp_path}/documents"), path=f"{tmp_path}/index")
    index = inverted.InvertedIndex(spark, f"{tmp_path}/index")
    found = index.top(spark.createDataFrame([(1, "word3")], "qid long, text string"), 3)
    assert [r.id for r in found.orderBy("rank").collect()] == [3, 10, 17]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "documents" not in plan and "CartesianProduct" not in plan
    held = index._held(spark.createDataFrame([(1, "word3", 1.0)], "qid long, term string, weight double"), 1)
    assert "term,word3" in held._jdf.queryExecution().executedPlan().toString()  # pushed into the scan


def test_bm25_of_no_documents_and_of_text_ids(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    queries = spark.createDataFrame([(1, "a")], "qid long, text string")
    assert rt.bm25(none, queries, 3).collect() == inverted.InvertedIndex.build(none).top(queries, 3).collect() == []
    docs = spark.createDataFrame([("y", "a b"), ("x", "a b"), ("z", "c")], "doc_id string, text string")
    assert rt.bm25(docs, queries, 3).collect() == inverted.InvertedIndex.build(docs).top(queries, 3).collect()
    assert [(r.id, r["rank"]) for r in rt.bm25(docs, queries, 3).orderBy("rank").collect()] == [("x", 1), ("y", 2)]


def plain_knn(vectors, queries, k):
    unit = lambda v: np.asarray(v, float) / (np.linalg.norm(v) or 1)
    out = set()
    for q, v in queries:
        if v is not None:
            scores = sorted(((round(float(unit(x) @ unit(v)), 6) + 0.0, i) for i, x in vectors if x is not None), key=lambda s: (-s[0], s[1]))[:k]
            out |= {(q, i, s, rank) for rank, (s, i) in enumerate(scores, 1)}
    return out


def clustered(rng, n, centres, spread, size=16):
    middle = rng.normal(size=(centres, size))
    return [(i, (middle[i % centres] + spread * rng.normal(size=size)).tolist()) for i in range(n)]


def near(got, want):
    """Alike but for the last digit of a score."""
    got, want = sorted(got), sorted(want)
    return len(got) == len(want) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-6 and a[3] == b[3] for a, b in zip(got, want))


@pytest.mark.parametrize("n, centres, spread, count, block", [(400, 12, 0.05, None, 4096), (300, 300, 1.0, 10, 7), (50, 1, 0.0, 5, 8), (3, 3, 1.0, None, 2)])
def test_knn_equals_comparing_all(spark, n, centres, spread, count, block):
    rng = np.random.default_rng(n)
    vectors = clustered(rng, n, centres, spread) + [(n + 1, None), (n + 2, [0.0] * 16)]
    queries = [(f"q{i}", vectors[i % n][1]) for i in range(9)] + [("null", None), ("zero", [0.0] * 16)]
    index = cells.CellIndex.build(spark.createDataFrame(vectors, "id long, vector array<double>"), cells=count, block=block)
    got = {(r.qid, r.id, r.score, r.rank) for r in index.top(spark.createDataFrame(queries, "qid string, vector array<double>"), 6).collect()}
    assert near(got, plain_knn(vectors, queries, 6))


def test_most_cells_are_skipped_on_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = clustered(rng, 1200, 30, 0.03)
    index = cells.CellIndex.build(spark.createDataFrame(vectors, "id long, vector array<double>"), cells=40)
    queries = [(i, v) for i, v in vectors[:20]]
    seen, compared = [], cells.CellIndex._compared
    index._compared = lambda asked, *a: seen.append(asked.count()) or compared(index, asked, *a)
    found = index.top(spark.createDataFrame(queries, "qid long, vector array<double>"), 5)
    assert near({(r.qid, r.id, r.score, r.rank) for r in found.collect()}, plain_knn(vectors, queries, 5))
    assert sum(seen) < 0.2 * len(queries) * len(index.count)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_cell_that_holds_most_vectors_is_several_rings(spark):
    vectors = [(i, [1.0, 0.001 * i]) for i in range(100)] + [(100 + i, [-1.0, float(i)]) for i in range(5)]
    index = cells.CellIndex.build(spark.createDataFrame(vectors, "id long, vector array<double>"), cells=2, block=10)
    rings = index.rings().collect()
    assert sum(len(r.ids) for r in rings) == 105 and all(len(r.ids) <= 10 and r.near <= r.far for r in rings)
    queries = [(1, [1.0, 0.05])]
    got = {(r.qid, r.id, r.score, r.rank) for r in index.top(spark.createDataFrame(queries, "qid long, vector array<double>"), 4).collect()}
    assert near(got, plain_knn(vectors, queries, 4))


def test_knn_of_no_vectors(spark):
    none = spark.createDataFrame([], "id string, vector array<float>")
    queries = spark.createDataFrame([(1, [1.0])], "qid long, vector array<float>")
    assert rt.knn(none, queries, 3).collect() == cells.CellIndex.build(none).top(queries, 3).collect() == []


def test_indexes_are_built_anew_when_files_change(spark, tmp_path):
    from lodestar.session import signature

    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(path)
    before = signature(spark.read.parquet(path))
    assert before == signature(spark.read.parquet(path))
    spark.range(3).write.mode("append").parquet(path)
    assert before != signature(spark.read.parquet(path))

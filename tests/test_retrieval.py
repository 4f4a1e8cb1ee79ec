import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.operators import chunking, evaluate, prompts
from lodestar.operators import retrieval as rt


def test_two_rankings_with_a_shared_top(spark):
    rows = [("q", "a", 1, 1), ("q", "b", 1, 1), ("q", "a", 2, 2)]
    got = {r.id: r.score for r in rt.rrf(spark.createDataFrame(rows, "qid string, ranking string, id long, rank int")).collect()}
    assert got[1] == pytest.approx(2 / 61) and got[2] == pytest.approx(1 / 62)


def test_single_ranking_keeps_scores(spark):
    rows = [("q", "a", 1, 1, 0.9), ("q", "a", 2, 2, 0.4)]
    got = {r.id: r.score for r in rt.rrf_or_single(spark.createDataFrame(rows, "qid string, ranking string, id long, rank int, score double")).collect()}
    assert got == {1: 0.9, 2: 0.4}


@pytest.mark.parametrize(("scores", "kept"), [([1.2, 0.1, -1.2, -1.8], 2), ([-1.06, -1.31, -1.60], 3), ([0.5], 1)])
def test_margin(spark, scores, kept):
    hits = spark.createDataFrame([("q", i, s) for i, s in enumerate(scores)], "qid string, id long, score double")
    assert rt.margin_cut(hits).count() == kept
    assert rt.margin_cut(hits, None).count() == len(scores)


def naive_mmr(scores, vectors, k, weight):
    cos = lambda a, b: 0.0 if a is None or b is None or not (np.linalg.norm(a) and np.linalg.norm(b)) else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    if len(scores) <= k:
        return list(range(len(scores)))
    low, high = min(scores), max(scores)
    rel = [(s - low) / (high - low) if high > low else 1.0 for s in scores]
    picked = []
    while len(picked) < k:
        best, value = None, -math.inf
        for i in range(len(scores)):
            if i in picked:
                continue
            near = [cos(vectors[i], vectors[j]) for j in picked if vectors[j] is not None]
            v = round(weight * rel[i] - (1 - weight) * (max(near) if near and vectors[i] is not None else 0.0) if picked else rel[i], 12)
            if v > value:
                best, value = i, v
        picked.append(best)
    return picked


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9), st.integers(1, 6))
def test_mmr_equals_the_plain_loop(seed, n, k):
    rng = random.Random(seed)
    scores = [round(rng.random(), 1) for _ in range(n)]
    vectors = [None if rng.random() < 0.2 else [rng.choice([0.0, 1.0, -1.0, 0.5]) for _ in range(4)] for _ in range(n)]
    assert rt.select_diverse(scores, vectors, k) == naive_mmr(scores, vectors, k, 0.7)


def test_mmr_operator(spark):
    same, other = [1.0, 0.0], [0.0, 1.0]
    rows = [("q", i, s, v) for i, (s, v) in enumerate([(0.95, same), (0.91, same), (0.85, other), (0.80, same), (0.75, other)])]
    got = rt.mmr(spark.createDataFrame(rows, "qid string, id long, score double, vector array<double>"), 3).orderBy("pick").collect()
    assert [r.id for r in got][:2] == [0, 2]


def test_knn_equals_numpy(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(200, 8))
    data[7] = 0
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(900, None)], "id long, vector array<double>").repartition(5)
    got = rt.knn(vectors, vectors.filter("id < 8").withColumnRenamed("id", "qid"), 5).collect()
    unit = data / np.where(np.linalg.norm(data, axis=1) > 0, np.linalg.norm(data, axis=1), 1)[:, None]
    for q in range(8):
        score = np.round(unit @ unit[q], 6)
        want = sorted(range(200), key=lambda i: (-score[i], i))[:5]
        assert [r.id for r in sorted(got, key=lambda r: r.rank) if r.qid == q] == want


def test_bm25_formula(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a"), (3, None), (4, "c")], "doc_id long, text string")
    got = {r.id: r.score for r in rt.bm25(docs, spark.createDataFrame([("q", "B b a")], "qid string, text string"), 5).collect()}
    avg, idf = 5 / 4, lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    part = lambda tf, dl: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert got[1] == pytest.approx(idf(1) * part(2, 3) + idf(2) * part(1, 3), abs=1e-6)
    assert got[2] == pytest.approx(idf(2) * part(1, 1), abs=1e-6) and 4 not in got


def test_group_hits_pages(spark):
    rows = [("q", f"f{i % 5}", 1.0 - i / 100, i + 1, f"text {i}") for i in range(20)]
    hits = spark.createDataFrame(rows, "qid string, file_id string, score double, rank int, text string")
    files = spark.createDataFrame([(f"f{i}", i) for i in range(4)], "file_id string, n int")
    page = lambda p: [r.file_id for r in rt.group_hits(hits, files, p, 2).orderBy("place").collect()]
    assert page(1) == ["f0", "f1"] and page(3) == [] and page(4) == []
    assert rt.group_hits(hits, files, 1, 2).first().total == 5  # the missing file counts


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=300), st.integers(1, 6), st.integers(0, 2))
def test_chunks_are_slices_within_bounds(text, size, overlap):
    got = chunking.chunk_text(text, [(1, 0), (2, 50)], size, overlap)
    covered = set()
    for number, start, end, page in got:
        assert 0 <= start < end <= len(text) and end - start <= 4 * size + 4 * overlap
        assert page == (2 if start >= 50 else 1)
        covered.update(range(start, end))
    assert {i for i, c in enumerate(text) if c in "ab"} <= covered
    assert [g[0] for g in got] == sorted({g[0] for g in got})


def test_chunk_edges(spark):
    assert chunking.chunk_text("") == [] and chunking.chunk_text("  \n ") == []
    assert [(s, e) for _, s, e, _ in chunking.chunk_text("x" * 5000)] == [(0, 2048), (1792, 4096), (3840, 5000)]
    docs = spark.createDataFrame([(1, "a😀" * 3000), (2, None)], "doc_id long, text string")
    rows = chunking.chunks(docs).join(docs.withColumnRenamed("text", "whole"), "doc_id").collect()
    assert rows and all(r.text == r.whole[r.offset_start : r.offset_end] for r in rows)


def test_page_column(spark):
    rows = spark.createDataFrame([([(3, 10), (4, 20)], o) for o in (5, 10, 19, 20)] + [([], 3)], "m array<struct<page: int, start: int>>, o int")
    assert [r[0] for r in rows.select(chunking.page_at(F.col("m"), F.col("o"))).collect()] == [3, 3, 3, 4, None]


def test_metrics(spark):
    rows = spark.createDataFrame([([1, 2, 3], [2, 9]), ([1], []), ([5], [6])], "got array<long>, want array<long>")
    got = rows.select(evaluate.recall(F.col("got"), F.col("want")), evaluate.reciprocal_rank(F.col("got"), F.col("want")), evaluate.hit(F.col("want"), F.col("got"))).collect()
    assert [tuple(r) for r in got] == [(0.5, 0.5, True), (1.0, 0.0, None), (0.0, 0.0, False)]
    times = spark.createDataFrame([(float(x),) for x in range(1, 101)], "latency double")
    assert times.select(evaluate.percentile("latency", 95), evaluate.p95_by_rank("latency")).first() == (pytest.approx(95.05), 95.0)
    assert evaluate.report(spark.createDataFrame([], "recall double, rr double, latency double")).first() == (0, 0, 0, 0, 0, 0)


def test_device_plan(spark):
    plan = lambda p, o, v: prompts.device_plan(spark.createDataFrame([(p, o, v)], "priority string, overrides map<string,string>, vram_mib int")).first()
    r = plan("search", {}, 4096)
    assert r.budget_mib == 3584 and {k for k, d in r.devices.items() if d == "cuda"} == {"llm", "whisper"}
    r = plan("ingest", {"vision": "gpu", "llm": "gpu"}, 4096)
    assert r.overflow == ["vision"] and not r.feasible
    assert set(plan("search", {"ocr": "gpu"}, 0).devices.values()) == {"cpu"}


def test_prompts_and_citations(spark):
    q = spark.createDataFrame([("q", "why?"), ("none", "what?")], "qid string, question string")
    hits = spark.createDataFrame([("q", 2, "c2", "b.txt", "two"), ("q", 1, "c1", "a.txt", "one")], "qid string, rank int, chunk_id string, file_name string, text string")
    got = {r.qid: r for r in prompts.prompts(q, hits).collect()}
    assert "[1] (chunk_id=c1, archivo=a.txt) one\n[2] (chunk_id=c2, archivo=b.txt) two" in got["q"].prompt and not got["none"].has_hits
    answers = spark.createDataFrame([("q", "see [c2] and [zz]")], "qid string, answer string")
    assert [tuple(r) for r in prompts.cited(answers, hits).collect()] == [("q", "c2", 2)]

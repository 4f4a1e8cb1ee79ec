import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import quality


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 300))]
        kind = rng.random()
        if kind < 0.15:
            text = [w.upper() + "!!" for w in text]
        elif kind < 0.25:
            text[rng.randrange(len(text))] = rng.choice(["vilest", "vilely", "scoundrel"])
        rows.append((i, " ".join(text), rng.choice(["en", "fr"]), "src0" if i % 3 == 0 else f"src{i % 40}", "x"))
        labels.append((i, int(kind >= 0.15), int(0.15 <= kind < 0.25)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, host string").repartition(4)
    known = spark.createDataFrame([x for x in labels if x[0] < 600] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.classify(docs, known).collect()}
    truth = {i: bool(q and not t) for i, q, t in labels}
    assert got.keys() == truth.keys()
    held = [i for i in truth if i >= 600]
    assert not [i for i in held if truth[i] and not got[i]]  # clean documents stay
    assert np.mean([got[i] == truth[i] for i in held]) > 0.97


def test_site_posteriors_shrink(spark):
    rows = [("a", "p", 0.0)] * 400 + [("b", "p", 1.0)] * 300 + [("b", "q", 1.0)] * 2 + [("c", "p", 1.0)] + [(None, None, 0.0)] * 50 + [(f"h{i}", "p", float(i % 5 == 0)) for i in range(60)]
    sites = {(r.host, r.path): r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p_text double")).collect()}
    g = sites["a", "p"].global_rate
    assert g == pytest.approx((sum(x[2] for x in rows) + 0.5) / (len(rows) + 1))
    assert sites["a", "p"].path_rate < 0.02 and sites["b", "p"].path_rate > 0.98
    assert g < sites["c", "p"].host_rate < 0.98  # one document moves its site a little only
    assert (None, None) in sites


def test_sites_alike_have_no_say(spark):
    rows = [(f"h{i % 10}", "p", float(i % 4 == 0)) for i in range(4000)]
    rows = [(h, p, float((i // 10) % 4 == 0)) for i, (h, p, _) in enumerate(rows)]
    for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p_text double")).collect():
        assert r.path_rate == pytest.approx(r.global_rate)


def test_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, None, None, None), (1, "", "en", "a"), (2, "x " * 50_000, "en", "a"), (None, "é", "en", "a")], "doc_id long, text string, lang string, source string")
    got = quality.classify(docs, labels)
    assert got.count() == 4 and got.filter("keep").count() == 4
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    one = spark.createDataFrame([(2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs, one).filter(F.col("doc_id") == 2).count() == 0


def test_the_query_returns_every_document(spark, tmp_path):
    from lodestar.llm import queries

    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, host string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op10_quality_classifier(spark, str(tmp_path)).collect()}
    assert got.keys() == {r[0] for r in rows}
    toxic = [got[i] for i, _, t in labels if t]
    assert sum(not r.keep for r in toxic) > 0.9 * len(toxic) and all(r.p_toxic is not None and r.p_bad is not None for r in toxic)


def test_sites_and_documents_against_plain_computation(spark):
    """host and path rates and p_bad of every document, recomputed from the texts' evidence alone."""
    rows, labels = corpus(700, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, host string").repartition(3)
    known = spark.createDataFrame([x for x in labels if x[0] < 400], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, known).collect()}
    members = {}
    for r in got.values():
        members.setdefault(r.host, {}).setdefault(r.path, []).append(r.p_text)
        assert r.p_text == pytest.approx(1 - (1 - r.p_poor) * (1 - r.p_toxic))
    hosts = {h: [p for ps in paths.values() for p in ps] for h, paths in members.items()}
    every = [p for ps in hosts.values() for p in ps]
    n, s = len(every), sum(every)
    m = (s + 0.5) / (n + 1)

    def strength(between):
        return max(m * (1 - m) / between - 1, 1.0) if between > 1e-9 else None

    squares = lambda groups: sum(sum(g) ** 2 / len(g) for g in groups)
    paths = [ps for by in members.values() for ps in by.values()]
    host_k = strength((squares(hosts.values()) - s * s / n - (len(hosts) - 1) * m * (1 - m)) / max(1, n - sum(len(g) ** 2 for g in hosts.values()) / n))
    inner = sum(sum(len(g) ** 2 for g in by.values()) / len(hosts[h]) for h, by in members.items())
    path_k = strength((squares(paths) - squares(hosts.values()) - (len(paths) - len(hosts)) * m * (1 - m)) / max(1, n - inner))
    shrink = lambda g, k, parent: parent if k is None else (sum(g) + k * parent) / (len(g) + k)
    odds = lambda p: np.log(max(p, 1e-9) / max(1 - p, 1e-9))
    for r in got.values():
        rate = shrink(members[r.host][r.path], path_k, shrink(hosts[r.host], host_k, m))
        bad = 1 / (1 + np.exp(-(odds(r.p_text) + odds(rate) - odds(m))))
        assert r.path_rate == pytest.approx(rate) and r.p_bad == pytest.approx(bad, abs=1e-9) and r.keep == (r.p_bad < 0.5)


def test_the_fit_is_a_maximum():
    """The weights' posterior has no slope left, and presence of the words is what raises the odds."""
    rng = np.random.default_rng(2)
    shape = rng.normal(size=(400, len(quality.SHAPE)))
    bad = rng.random(400) < 1 / (1 + np.exp(-(shape[:, 0] * 2 - 1)))
    words = [np.unique(np.append(rng.integers(0, 50, 20), 999 if b and rng.random() < 0.6 else 998)).astype(np.uint64) for b in bad]
    model = quality.fit(shape, words, bad)
    assert 999 in model.words.tolist() and 998 not in model.words.tolist()
    owner = np.repeat(np.arange(400), [len(w) for w in words])
    odds = model.log_odds(shape, np.concatenate(words), owner)
    x = np.column_stack([np.ones(400), np.clip((shape - model.mean) / model.scale, -8, 8)] + [[w in set(ws.tolist()) for ws in words] for w in model.words.tolist()])
    assert odds == pytest.approx(x @ model.weights)
    prior = np.concatenate([[1e-4], np.full(shape.shape[1], 0.3), np.full(len(model.words), 0.01)])
    assert np.abs(x.T @ (bad - 1 / (1 + np.exp(-odds))) - prior * model.weights).max() < 1e-2


def test_columns_named_like_helpers(spark):
    docs = spark.createDataFrame([(1, "fine words here", "en", "a", "x", 2), (2, "", "en", "a", "y", 3)], "doc_id long, text string, lang string, source string, _gone string, keep int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.collect()))

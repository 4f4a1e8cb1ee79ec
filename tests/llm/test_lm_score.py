import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import lm_score

TEXTS = ["the cat sat on the mat", "The cat sat on the dog", "a dog sat", "", None, "zebra the cat\tsat\x0bon  the mat", "the cat sat on the mat", "é È the cat é", "x" * 5000 + " the cat", "the the the the"] * 3


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), 0]


def brute(rows, order):
    train = [tokens(t) for _, t, held in rows if not held]
    grams = [Counter() for _ in range(order + 1)]
    pad = ["<s>"] * (order - 1)
    for t in train:
        full = pad + t
        for i in range(len(pad), len(full)):
            for k in range(1, order + 1):
                grams[k][tuple(full[i - k + 1 : i + 1])] += 1
    N, V = sum(map(len, train)), len(grams[1])
    context = lambda g: grams[len(g)][g] if set(g) != {"<s>"} else len(train)
    one, every = Counter(), Counter()
    for t in train:
        full = pad + t
        for i in range(len(pad), len(full)):
            for k in range(2, order + 1):
                g = tuple(full[i - k + 1 : i + 1])
                b = (k, math.frexp(context(g[:-1]))[1])
                every[b] += 1
                one[b] += grams[k][g] == 1
    out = {}
    for d, t, held in rows:
        full, score, base, known = pad + tokens(t), 0.0, 0.0, 0
        for i in range(len(pad), len(full)):
            p = (grams[1][(full[i],)] + 1) / (N + V + 1)
            base += math.log10(p)
            known += grams[1][(full[i],)] > 0
            for k in range(2, order + 1):
                g = tuple(full[i - k + 1 : i + 1])
                c = context(g[:-1])
                b = (k, math.frexp(c)[1])
                left = (one[b] + 1) / (every[b] + 2) if c else 1.0
                p = left * p + ((1 - left) * grams[k][g] / c if c else 0)
            score += math.log10(p)
        out[d] = (held, len(full) - len(pad), known, N, base, score)
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_brute_force(spark, order, monkeypatch):
    rows = [(i, t, zlib.crc32(str(i).encode()) % 7 == 2) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(d, t, h, "x") for d, t, h in rows], "doc_id long, text string, held boolean, block string")
    got = {r.doc_id: tuple(r)[1:] for r in lm_score.score(docs.repartition(3), held=F.col("held"), order=order).collect()}
    want = brute(rows, order)
    assert got.keys() == want.keys()
    for d, w in want.items():
        assert got[d][:4] == w[:4]
        assert got[d][4:] == pytest.approx(w[4:])


def test_model_is_a_distribution_that_beats_the_base(spark):
    docs = spark.createDataFrame([(i, t, i % 3 == 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, held boolean")
    total = lm_score.score(docs, held=F.col("held")).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert total.s > total.b


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.score(docs).count() == 0


def test_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "RANGE_TOKENS", 3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.score(docs).collect()}
    want = brute([(i, t, False) for i, t in enumerate(TEXTS)], lm_score.ORDER)
    assert got == pytest.approx({d: w[5] for d, w in want.items()})


def test_the_query_looks_back_two_words(spark, tmp_path):
    """Which word follows depends on the word before the last one, and a model of pairs can't tell."""
    from lodestar.llm import queries

    rows = [(i, "alpha mid one" if i % 2 else "beta mid two") for i in range(100)] + [(1000 + i, "alpha mid one") for i in range(20)] + [(2000 + i, "alpha mid two") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r for r in queries.op1_lm_score(spark, str(tmp_path)).collect() if r.held_out]
    right, wrong = ([r.score for r in got if 1000 * n <= r.doc_id < 1000 * (n + 1)] for n in (1, 2))
    assert right and wrong and min(right) > max(wrong) + 0.15


def test_the_traversal_walks_states_arcs_and_failures():
    """Two contexts of two words, one of one: a b -> c (weight -1), b -> d (-2), and the root's own arcs; failures -0.5 and -0.25."""
    a, b, c, d = range(4)
    words = [a, b, c, b, d, c]
    states = {(): 0, (a,): 1, (b,): 2, (c,): 3, (d,): 4, (a, b): 5, (b, c): 6, (c, b): 7, (b, d): 8, "start": 9}
    arcs = [(0, x, -10.0 - x, (x,)) for x in range(4)] + [(1, b, -3.0, (a, b)), (5, c, -1.0, (b, c)), (2, d, -2.0, (b, d))]
    lookup = np.full((3, len(words)), -1, np.int32)
    for number, (source, word, _, _) in enumerate(arcs):
        for i, w in enumerate(words):
            before = tuple(words[max(0, i - 2) : i])
            for k in range(3):
                if w == word and len(before) >= k and states.get(before[len(before) - k :]) == source:
                    lookup[k, i] = number
    fail = np.array([0, 0, 0, 0, 0, 2, 3, 2, 4, 0])
    level = np.array([0, 1, 1, 1, 1, 2, 2, 2, 2, 1], np.int8)
    weight = np.array([0, -0.25, -0.25, -0.25, -0.25, -0.5, -0.5, -0.5, -0.5, -0.125])
    made = lm_score.Automaton(np.array([x[0] for x in arcs]), np.array([states[x[3]] for x in arcs]), np.array([x[2] for x in arcs]), fail, weight, level, lookup, states["start"])
    # a: start fails to the root; b: arc of a; c: arc of (a, b); b: (b, c) and c fail; d: the arc of b; c: (b, d) and d fail
    want = (-0.125 - 10) + -3 + -1 + (-0.5 - 0.25 - 11) + -2 + (-0.5 - 0.25 - 12)
    assert lm_score._traverse(np.array([6]), made) == pytest.approx([want])


def test_states_differ_as_texts_go_on(spark):
    """The automaton of a block has states of every level below the order, and a score changes with any failure's weight."""
    docs = [("x a b c", True), ("a b c", True), ("b c d", True), ("d a b d c", False)]
    lengths = np.array([len(t.split()) + 1 for t, _ in docs])
    tokens = np.concatenate([np.array([ord(w) for w in t.split()] + [1], np.uint64) for t, _ in docs])
    train = np.repeat([h for _, h in docs], lengths)
    grams = lm_score._grams(lengths, tokens, 3)
    found = lm_score.Counted(lengths, train, [], [], 3)
    for keys in grams:
        distinct, place = np.unique(keys, return_inverse=True)
        found.places.append(place)
        found.counts.append(np.bincount(place, weights=train, minlength=len(distinct)).astype(np.int64))
    share = np.full((3, lm_score.BINS), 0.5)
    a = lm_score._automaton(found, 3, 30.0, share)
    assert set(a.level.tolist()) == {0, 1, 2} and len(set(a.target.tolist())) > 8
    assert all(a.level[f] == max(0, lv - 1) for f, lv in zip(a.fail.tolist(), a.level.tolist()))
    whole = lm_score._traverse(lengths, a)
    for lv in (1, 2):
        changed = lm_score.Automaton(**(a.__dict__ | {"fail_weight": np.where(a.level == lv, -9.0, a.fail_weight)}))
        assert lm_score._traverse(lengths, changed)[3] < whole[3] - 1


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c", True), (1, "a b c", False), (1, "a b d", False), (1, "a b c", False), (None, None, True)]
    got = [(r.doc_id, r.held_out, r.n_tokens, round(r.score, 9)) for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string, held boolean"), held=F.when(F.col("doc_id").isNotNull(), F.col("held"))).collect()]
    assert sorted(x[:3] for x in got if x[0]) == [(1, False, 4)] * 3 and sorted(x[1:3] for x in got if x[0] is None) == [(False, 1), (False, 4)]
    assert len({x[3] for x in got if x[0] == 1}) == 2

import random
import re

import pytest

from lodestar.llm import chosen_path


def shingles(text, n=5):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, similarity=0.8):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = {d: set() for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) and sets[a]:
                root[max(find(a), find(b))] = min(find(a), find(b))
                if sets[a] != sets[b]:
                    links[a].add(sets[b])
                    links[b].add(sets[a])
    return {d: (find(d), len(links[d]), min(e for e in ids if sets[e] == sets[d]), sum(sets[e] == sets[d] for e in ids)) for d in ids}


def corpus(seed=1, groups=25, common=True):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 5, 9, 60, 200]))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own) + (" " + passage if common and rng.random() < 0.4 else ""))
    rows += ["", None, "  \n", "One two", "one TWO", rows[3].upper(), rows[3]]
    return list(enumerate(rows))


@pytest.mark.parametrize("limit", [256, 4])
def test_equals_brute_force(spark, limit):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, node int").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links, r.copy_id, r.n_copies) for r in chosen_path.similar_texts(docs, limit=limit, block=2 * limit, recall=0.99999999).collect()}
    assert got == brute(rows)


def test_large_near_group_in_blocks(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        own = list(base)
        own[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: (r.class_id, r.n_links, r.copy_id, r.n_copies) for r in chosen_path.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), limit=16, block=20, recall=0.99999999).collect()}
    assert got == brute(rows)


def test_common_passage_splits(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(str(rng.random()) for _ in range(70)) + " " + passage) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " end") for i in range(10)]
    got = {r.doc_id: (r.class_id, r.n_links, r.copy_id, r.n_copies) for r in chosen_path.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), limit=8, block=8, recall=0.99999999).collect()}
    assert got == brute(rows)


def test_recall_of_a_pair_at_the_threshold():
    assert chosen_path.runs_for(0.8, 0.9999) == 6
    missed, pairs = 0, 300
    rng = random.Random(9)
    for _ in range(pairs):
        words = [str(rng.random()) for _ in range(100)]
        import numpy as np

        a = np.array([hash((w, 1)) & (2**64 - 1) for w in words[:90]], np.uint64)
        b = np.array([hash((w, 1)) & (2**64 - 1) for w in words[10:]], np.uint64)  # 80 of 100 in common
        levels = [set(x[1].tolist()) & set(y[1].tolist()) for x, y in zip(chosen_path.path_tree(a, 2), chosen_path.path_tree(b, 2))]
        missed += not levels[-1]
    assert missed / pairs < 0.193**2 + 0.04


def test_empty_table(spark):
    assert chosen_path.similar_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_and_repeated_ids(spark):
    rng = random.Random(12)
    base = [[f"{i}w{rng.randrange(10**6)}" for _ in range(100)] for i in range(5)]
    text = lambda i, n=0: " ".join([*base[i][: 100 - n], *[f"x{i}y{n}z{k}" for k in range(n)]])  # noqa: E731  ``n`` words changed
    rows = [(1, text(0)), (None, text(0, 2)), (None, text(1)), (None, text(1, 2)), (None, text(2)), (2, text(3)), (2, text(0, 3)), (2, text(4)), (3, text(4, 2)), (4, text(4, 3)), (5, "a b c"), (5, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.copy_id, r.n_copies) for r in chosen_path.similar_texts(docs, recall=0.99999999).collect()), key=str)
    assert got == sorted([(1, 1, 2, 1, 1), (None, 1, 2, None, 1), (2, 1, 2, 2, 1), (None, None, 1, None, 1), (None, None, 1, None, 1), (None, None, 0, None, 1), (2, 2, 0, 2, 1), (2, 2, 2, 2, 1), (3, 2, 2, 3, 1), (4, 2, 2, 4, 1), (5, 5, 0, 5, 2), (5, 5, 0, 5, 2)], key=str)
    kept = [(r.doc_id, r.text) for r in chosen_path.keep_one(docs, recall=0.99999999).collect()]
    one = [x for x in kept if x[1] in (text(1), text(1, 2))]
    assert len(one) == 1 and sorted(set(kept) - set(one), key=str) == sorted([(1, text(0)), (None, text(2)), (2, text(3)), (2, text(4)), (5, "a b c")], key=str) and len(kept) == 7


def test_recall_of_the_registered_settings(spark):
    """Thousands of true links near the threshold, at the parameters of the query."""
    rng = random.Random(21)
    rows = []
    for g in range(160):
        base = [f"{g}w{rng.randrange(10**6)}" for _ in range(110)]
        for c in range(8):
            own = list(base)
            own[rng.randrange(len(own))] = f"x{c}"
            rows.append((len(rows), " ".join(own)))
    want = 0
    for g in range(160):
        sets = [shingles(t) for _, t in rows[8 * g : 8 * g + 8]]
        want += sum(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[i + 1 :])
    got = chosen_path.similar_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    found = sum(r.n_links for r in got) / 2
    assert want > 3000 and 0.99 * want <= found <= want
    assert all(r.class_id // 8 == r.doc_id // 8 for r in got) and sum(r.class_id % 8 == 0 for r in got) > 0.99 * len(got)


def test_very_long_texts(spark):
    rng = random.Random(2)
    long = [f"w{rng.randrange(10**6)}" for _ in range(40_000)]
    near = list(long)
    near[7] = "other"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, "word " * 50_000), (4, "word " * 50_001), (5, "x" * 300_000)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (3, 0), 5: (5, 0)}


def test_columns_named_like_helpers(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2), (3, "z", "z", 3)], "doc_id long, text string, _kept string, _key int")
    kept = chosen_path.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, "a b c d e f", "x", 1), (3, "z", "z", 3)]


def test_a_node_meets_its_sketch_once_however_many_large_buckets_it_is_in(spark):
    posts = spark.createDataFrame([(node, key, 3) for key in range(5) for node in (1, 2, 3)], "node long, key long, n long")
    nodes = spark.createDataFrame([(1, [7, 8]), (2, [7, 8]), (3, [9]), (4, [7])], "node long, sketch array<long>")
    found = chosen_path._alike(posts, nodes)
    assert sorted((r.key, round(r.alike, 6), r.n) for r in found.collect()) == [(key, round(5 / 9, 6), 3) for key in range(5)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join Inner") < plan.index("collect_list")  # a row a node is joined

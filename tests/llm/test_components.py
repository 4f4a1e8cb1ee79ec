import random

from lodestar.llm.components import components


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in root if find(x) != x}


def test_equals_union_find(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(110)] + [(-5, -5), (-9, 7)]
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "u long, v long").repartition(7))
    rows = [tuple(r) for r in got.collect()]
    assert dict(rows) == plain(edges) and len(rows) == len(set(rows))


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def path(rows, place, fanout):
    out = []
    for row in rows[:-1]:
        first = place - place % fanout
        out.append(("".join(row[first:place]), "".join(row[place + 1 : first + fanout])))
        place //= fanout
    return out


def plain(rows, fanout=2):
    by = defaultdict(list)
    for row in rows:
        tampered = list(row)
        if row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
            tampered[3] += 1
        by[row[2]].append((-1 if row[0] is None else row[0], leaf(row), leaf(tampered), row[0]))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = [levels([x[1] for x in sorted(by[g])], fanout) for g in langs]
    top = levels([t[-1][0] for t in trees], fanout)
    out = []
    for i, g in enumerate(langs):
        for place, (_, own, shown, doc_id) in enumerate(sorted(by[g])):
            proof = path(trees[i], place, fanout) + path(top, i, fanout)
            folded = shown
            for left, right in proof:
                folded = h(left, folded, right)
            out.append((doc_id, own, trees[i][-1][0], top[-1][0], h(*[a + b for a, b in proof]), folded, folded == top[-1][0]))
    return sorted(map(str, out))


def some(n, langs, rng):
    return [(rng.randrange(2 * n), rng.choice(["s1", "ü", None]), rng.choice(langs), rng.choice([None, 5, 70]), rng.choice(["", None, "é text", "a:b", f"t{i}"])) for i in range(n)]


@pytest.mark.parametrize("fanout, stride, n", [(2, 8, 700), (2, 1, 23), (2, 2, 90), (3, 2, 75), (2, 3, 1), (2, 3, 2)])
def test_equals_plain_trees(spark, fanout, stride, n):
    rows = some(n, ["en", None, "", "é", "z", "zz"], random.Random(n)) + [(None, None, "en", None, None)] * 3 + [(4, "s", "one", 3, "t")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle.verified(merkle.manifest(merkle.leaves(docs, {"n_chars": tampered}), fanout, stride)).collect()
    assert sorted(map(str, map(tuple, got))) == plain(rows, fanout)


def test_one_hot_group_and_a_group_for_every_row(spark):
    rows = [(i, "s", "hot" if i % 3 == 0 else f"g{i}", i, "t") for i in range(400)]
    got = merkle.verified(merkle.manifest(merkle.leaves(spark.createDataFrame(rows, SCHEMA)), stride=2)).collect()
    assert len(got) == 400 and all(r.verified for r in got)
    assert {r.root for r in got} == {eval(x)[3] for x in plain(rows)}


def test_query_over_the_test_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = queries.op12_merkle_manifest(spark, sf_dir)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = list(map(tuple, got.collect()))
    assert sorted(map(str, got)) == plain(rows) and {r[-1] for r in got} == {True, False}


def test_clashing_columns_are_not_read_and_no_rows(spark):
    rows = some(30, ["a", "b"], random.Random(1))
    docs = spark.createDataFrame(rows, SCHEMA)
    more = docs.withColumns({c: F.lit("x") for c in ("key", "group", "leaf", "presented", "salt", "place", "part", "tree", "index", "n")})
    one, two = (sorted(map(str, merkle.verified(merkle.manifest(merkle.leaves(d))).collect())) for d in (docs, more))
    assert one == two
    assert merkle.verified(merkle.manifest(merkle.leaves(docs.limit(0)))).collect() == []


def test_leaves_of_a_tree_are_spread(spark):
    """No task numbers a whole group: rows that are all alike are dealt over the partitions too."""
    docs = spark.createDataFrame([(1, "s", "en", 1, "t")] * 4000, SCHEMA)
    numbered, trees, most = merkle._numbered(merkle.leaves(docs))
    assert (trees, most) == (1, 4000) and sorted(r["index"] for r in numbered.collect()) == list(range(4000))


def test_borders_of_partitions():
    head = lambda part, groups, first, n, last, m: {"part": part, "groups": groups, "first": {"group": first, "n": n}, "last": {"group": last, "n": m}}
    heads = [head(0, 1, None, 5, None, 5), head(2, 2, None, 1, "a", 3), head(3, 1, "a", 4, "a", 4), head(4, 3, "a", 2, "d", 1), head(5, 1, "e", 9, "e", 9)]
    assert merkle._borders(heads) == ([(0, 0, 0, 6, 6), (2, 0, 5, 6, 9), (3, 1, 3, 9, 9), (4, 1, 7, 9, 1), (5, 4, 0, 9, 9)], 5, 9)
    assert merkle._borders([]) == ([], 0, 0)

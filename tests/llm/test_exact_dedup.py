import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import exact_dedup

ROWS = [(i, t) for i, t in enumerate(["a", "b", "a", None, "", "a ", "é", "e", "A", "a", "long " * 30_000, "long " * 30_000] + ["hot"] * 60 + [f"t{i}" for i in range(50)])]


def expected(rows):
    same = defaultdict(list)
    for d, t in rows:
        same[t or ""].append(d)
    return {(d, max(same[t or ""]), len(same[t or ""]), d == max(same[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows}


@pytest.mark.parametrize("options", [{}, {"hash_bits": 3}, {"hash_bits": 1, "bucket_rows": 4, "max_depth": 5}, {"bucket_rows": 9, "start_depth": 0}])
def test_equals_plain_grouping(spark, options):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in ROWS], "doc_id long, text string, key int, n string").repartition(5)
    rows = exact_dedup.exact_dedup(docs, **options).collect()
    assert len(rows) == len(ROWS) and set(map(tuple, rows)) == expected(ROWS)
    if "bucket_rows" in options:
        return
    kept = exact_dedup.drop_copies(docs, **options)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, _, k, _ in expected(ROWS) if k)


def test_overfull_buckets_split_and_the_directory_doubles(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    found, total = exact_dedup.index(docs, F.col("text"), F.col("doc_id"), bucket_rows=20, max_depth=7, start_depth=1)
    assert total == 400 and 4 < found.depth <= 7 and len(found.slots) == 1 << found.depth
    live = set(found.slots)
    chains = [r for r in found.chains().collect() if r.bucket in live]
    assert len(chains) == 400  # every text is in one live bucket, whatever was split
    held = defaultdict(int)
    for r in chains:
        depth = r.bucket.bit_length() - 1
        slot = (r.key & (1 << 64) - 1) >> (64 - found.depth)
        assert found.slots[slot] == r.bucket and slot >> (found.depth - depth) == r.bucket - (1 << depth)
        held[r.bucket] += len(r.chain)
    assert all(n <= 20 or b.bit_length() - 1 == 7 for b, n in held.items())
    assert len({b.bit_length() for b in live}) > 1  # local depths differ


def test_colliding_keys_are_chained_and_told_apart(spark):
    docs = spark.createDataFrame([(i, f"text {i % 90}") for i in range(100)], "doc_id long, text string")
    found, _ = exact_dedup.index(docs, F.col("text"), F.col("doc_id"), bucket_rows=4, max_depth=3, hash_bits=2)
    live = set(found.slots)
    lengths = [len(r.chain) for r in found.chains().collect() if r.bucket in live]
    assert sum(lengths) == 90 and len(lengths) <= 4  # 2^2 keys
    got = exact_dedup.exact_dedup(docs, hash_bits=2, bucket_rows=4, max_depth=3).collect()
    assert {r.doc_id: r.keep_id for r in got} == {i: i + 90 if i < 10 else i for i in range(100)}


def test_the_rows_come_from_the_index(spark, monkeypatch):
    """Without the bucket files no copy is found."""
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    chains = exact_dedup.Index.chains
    monkeypatch.setattr(exact_dedup.Index, "chains", lambda self: chains(self).limit(0))
    assert [r.group_size for r in exact_dedup.exact_dedup(docs).collect()] == [1, 1]


def test_null_ids_are_below_all_others(spark):
    docs = spark.createDataFrame([(None, "a"), (5, "a"), (7, "a"), (None, "b"), (None, None), (3, "")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {(None, 7, 3, False), (5, 7, 3, False), (7, 7, 3, True), (None, None, 1, True), (None, 3, 2, False), (3, 3, 2, True)}
    assert sorted((r.doc_id or -1, r.text) for r in exact_dedup.drop_copies(docs).collect()) == [(-1, "b"), (3, ""), (7, "a")]


def test_columns_named_like_helpers(spark):
    names = ["_sha", "_dedup", "row", "key", "sha", "bucket", "slot", "hot", "e", "id", "keep_id", "kept", "group_size", "text_sha256", "t", "n.m"]
    docs = spark.createDataFrame([(i, "same" if i < 3 else f"t{i}", *[f"{c}{i}" for c in names]) for i in range(6)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in docs.collect() if r.doc_id >= 2)


def test_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert sorted(r.kept for r in exact_dedup.exact_dedup(docs).collect()) == [True] * 3
    assert exact_dedup.drop_copies(docs).count() == 2
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0 and exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

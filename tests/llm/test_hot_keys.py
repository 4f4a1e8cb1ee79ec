import pytest
from pyspark.sql import functions as F

from lodestar.llm import hot_keys


@pytest.mark.parametrize("share", [1000, 3])
def test_equals_a_plain_join(spark, share, monkeypatch):
    monkeypatch.setattr(hot_keys, "HOT_SHARE", share)
    rows = spark.createDataFrame([(i, i % 7 if i % 2 else 100) for i in range(200)] + [(500, None), (501, 55)], "id long, k long").repartition(5)
    facts = spark.createDataFrame([(k, n, f"f{k}") for k, n in [(0, 14), (1, 15), (3, 14), (5, 14), (100, 100), (900, 1)]], "k long, n long, what string")
    got = hot_keys.join_spread(rows, facts, "k", "n", 202, F.xxhash64("id"))
    assert got.columns == ["id", "k", "n", "what"]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in rows.join(facts, "k").select("id", "k", "n", "what").collect())

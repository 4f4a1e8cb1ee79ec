from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestar.operators import catalog as ct
from lodestar.queries import QUERIES, SQL


def files(spark):
    rows = [("1", "s1", "b.txt", "/r/b.txt", "text", 10), ("2", "s1", "a.pdf", "/r/x/a.pdf", "document", 30), ("3", "s2", "C.txt", "/q/C.txt", "text", 20), ("4", "gone", "d.png", "/z/d.png", "image", 20)]
    return spark.createDataFrame(rows, "file_id string, source_id string, name string, path string, category string, size long")


def test_pages(spark):
    f = files(spark)
    ids = lambda df: [r.file_id for r in df.collect()]
    assert ids(ct.sorted_page(f)) == ["2", "3", "4", "1"]
    assert ids(ct.sorted_page(f, "name", "asc", 2, 2)) == ["1", "4"]
    assert ids(ct.sorted_page(f, "nonsense", "down", 1, 1)) == ["2"]
    assert ids(ct.sorted_page(f, number=9)) == []
    with pytest.raises(ValueError):
        ct.page(f, 0, 10, F.asc("name"))
    assert [ct.pages_of(n, 2) for n in (0, 1, 5)] == [1, 1, 3]


def test_filters_and_search(spark):
    f = files(spark)
    assert ct.equality(f, source_id="s1", category=["text", "image"]).count() == 1
    assert ct.equality(f, source_id=None, category=[]).count() == 4
    assert ct.with_source(f, "not an id").count() == 4
    assert {r.name for r in ct.name_search(f, "C. pdf").collect()} == {"C.txt", "a.pdf"}
    assert ct.indexable(f).count() == 3 and ct.indexable(f, True).count() == 4


def test_totals_of_nothing(spark):
    assert ct.totals(files(spark).limit(0)).first() == (0, 0)


def test_diff_states(spark):
    at = datetime(2024, 1, 1)
    old = [("del", at, 1, "done"), ("same", at, 1, "done"), ("late", at, 1, "done"), ("edge", at, 1, "skipped"), ("size", at, 1, "done"), ("fail", at, 1, "failed"), ("none", at, 1, None)]
    new = [("new", at, 1), ("same", at, 1), ("late", at + timedelta(seconds=3), 1), ("edge", at + timedelta(seconds=2), 1), ("size", at, 2), ("fail", at, 1), ("none", at, 1)]
    diff = ct.incremental_diff(spark.createDataFrame(old, "path string, modified_at timestamp, size long, index_status string"), spark.createDataFrame(new, "path string, modified_at timestamp, size long"))
    assert {r.path: r.state for r in diff.collect()} == {"del": "deleted", "same": "unchanged", "late": "modified", "edge": "unchanged", "size": "modified", "fail": "retry", "none": "retry", "new": "new"}
    assert {r.path for r in ct.to_index(diff).collect()} == {"late", "size", "fail", "none", "new"}


def test_mutations(spark, tmp_path):
    f = files(spark)
    sources = spark.createDataFrame([("s1", "/r", True), ("s2", "/q", False)], "source_id string, path string, auto_index boolean")
    assert [r.file_id for r in ct.orphans(f, sources).collect()] == ["4"]
    left = ct.remove_source("s1", sources, f, f)
    assert [df.count() for df in left] == [1, 2, 2]
    assert {r.source_id: r.auto_index for r in ct.toggle_auto_index(sources, "s1").collect()} == {"s1": False, "s2": False}
    with pytest.raises(ValueError):
        ct.add_source(sources, sources.limit(1))
    ct.write_partition(f, f"{tmp_path}/t")
    ct.write_partition(f.filter("source_id = 's1'").limit(1), f"{tmp_path}/t")
    assert sorted(spark.read.parquet(f"{tmp_path}/t").groupBy("source_id").count().collect()) == [("gone", 1), ("s1", 1), ("s2", 1)]
    assert '"name":"b.txt"' in ct.serialise(f).first().json


def test_registry():
    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

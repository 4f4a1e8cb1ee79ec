import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa

import lodestar.queries_small  # noqa: F401  registers its queries
from lodestar.operators import inverted
from lodestar.queries import QUERIES


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_counting_tokens_of_slices_is_counting_each_text(monkeypatch):
    monkeypatch.setattr(inverted, "SLICE_TEXTS", 2)
    texts = ["b a b", None, "", "é1 ÿ ÷ × a", "b", "zz-zz zz"]
    terms, term, doc, tf, lengths = inverted._counted(pa.chunked_array([pa.array(texts[:3]), pa.array(texts[3:])]))
    assert terms.to_pylist() == sorted(terms.to_pylist())
    assert {(terms[int(t)].as_py(), int(d)): int(n) for t, d, n in zip(term, doc, tf)} == {(w, d): n for d, x in enumerate(texts) for w, n in Counter(re.findall("[a-z0-9à-öø-ÿ]+", x or "")).items()}
    assert lengths.tolist() == [3, 0, 0, 3, 1, 3]
    none = inverted._counted(pa.chunked_array([pa.array([None], pa.string())]))
    assert len(none[0]) == len(none[1]) == 0 and none[4].tolist() == [0]


def test_document_frequency_sums_before_the_shuffle_and_builds_no_index(spark, tmp_path):
    spark.createDataFrame([(1, "a b A"), (2, "a"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["document_frequency"](spark, str(tmp_path))
    assert "inverted-index" not in plan_of(found) and "partial_sum" in plan_of(found) and plan_of(found).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, found.collect())) == [("a", 2, 3), ("b", 1, 1)]


def test_postings_are_made_where_the_texts_of_a_range_are(spark, tmp_path):
    """Blocks carry their own counts, in the order of their terms."""
    docs = spark.createDataFrame([(i, f"w{i % 3} all W{i % 3}") for i in range(40)], "doc_id long, text string")
    index = inverted.InvertedIndex.build(docs, range_docs=8, path=f"{tmp_path}/index")
    rows = index.postings().collect()
    assert index.ranges == 5 and all(r.n == len(r.ids) == len(r.tfs) == len(r.lengths) and r.total == sum(r.tfs) and r.most_tf == max(r.tfs) and r.least_length == 3 for r in rows)
    assert sorted(i for r in rows if r.term == "all" for i in r.ids) == list(range(40))
    assert np.all([sorted(r.ids) == sorted(set(r.ids)) for r in rows]) and json.dumps(sorted({r.term for r in rows})) == '["all", "w0", "w1", "w2"]'

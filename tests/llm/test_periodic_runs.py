import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import periodic_runs as pr
from lodestar.llm import queries


def plain_runs(words):
    """Every maximal stretch of every lag, and of those alike the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                part = words[i : j + q]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    found[(i, j - i + q)] = q
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in found.items())


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for a, b, q in runs for i in range(a + q, a + b)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256("".join(f"{a},{b},{q}\n" for a, b, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 20), st.integers(0, 5))
def test_runs_equal_plain_search(part, times, tail):
    ids = part * times + part[:tail]
    assert pr.find_runs(np.array(ids, np.int64), 16) == plain_runs(ids)


def test_long_lags_are_found_whatever_octave():
    rng = random.Random(3)
    for period in (16, 17, 31, 32, 33, 63, 64, 100, 255, 256, 300):
        for extra in (0, 1, period - 1):
            part = [rng.randrange(500) for _ in range(period)]
            ids = [rng.randrange(500) for _ in range(rng.randrange(200))] + part * 2 + part[:extra] + [rng.randrange(500) for _ in range(70)]
            got = pr.find_runs(np.array(ids, np.int64), 16)
            assert got == plain_runs(ids) and any(q == period for _, _, q in got)


def test_runs_inside_of_runs_and_side_by_side():
    a, b = [1] * 40 + [2], [3, 4] * 30
    for ids in (a * 5, (a * 3 + b) * 3, b + a * 2 + b * 2, [7] * 400, ([1] * 13 + [2] * 15) * 9):
        assert pr.find_runs(np.array(ids, np.int64), 16) == plain_runs(ids)
        assert pr.find_runs(np.array(ids, np.int64)) == plain_runs(ids)


def test_stretches_of_zeros():
    assert pr.stretches(0b0001100010, 10, 3) == [(2, 3), (7, 3)]
    assert pr.stretches(0b0001100010, 9, 3) == [(2, 3)]
    assert pr.stretches(0, 5, 6) == []


def test_a_long_repeated_line_tries_few_lags(monkeypatch):
    """Lags that a found run explains are not tried again."""
    seen, stretches = [], pr.stretches
    monkeypatch.setattr(pr, "stretches", lambda *a: seen.append(a) or stretches(*a))
    line = list(range(10))
    assert pr.find_runs(np.array(line * 3000, np.int64)) == [(0, 30_000, 10)]
    assert len(seen) < 100


ODD = [
    (1, "a b " * 10), (2, None), (3, ""), (4, " \t\r\n\x0b\x0c"), (5, "x " * 5000), (None, "y " * 20), (None, None), (6, "one two three"), (6, "one two three"), (7, "é è " * 12),
    (8, " ".join(f"w{i}" for i in range(4000)) + " " + " ".join(f"v{i % 1500}" for i in range(3200))), (9, "p q r\u0085s " * 13), (10, "a b c d e f a b c d e f"), (11, "a b c d e f a b c d e"),
]


def test_query_equals_plain_search(spark, tmp_path):
    rng = random.Random(5)
    rows = ODD + [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 90)))) for i in range(20, 140)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("runs", "n_words", "collapsed", "start")}).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [plain_digest(*r) for r in rows]
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 5
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_test_table_equals_plain_search(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    rows = [r for r in rows if len(r.text or "") < 12_000]
    assert len(rows) > 150 and all(got[r.doc_id] == plain_digest(*r) for r in rows)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert pr.digest(pr.periodic_runs(docs)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 11, 12])
def test_the_operator_gives_words_and_texts(spark, n):
    row = pr.periodic_runs(spark.createDataFrame([("k", "z " * n)], "name string, body string"), "body", "name").first()
    assert (row.doc_id, row.n_words, row.collapsed) == ("k", n, "z" if n == 12 else " ".join("z" * n)) and len(row.runs) == (n == 12)

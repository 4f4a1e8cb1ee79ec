import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import queries
from lodestar.llm import suffix_dedup as sd


def plain(rows, length=200):
    """Every window of every text in a dictionary."""
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(r[i : i + length] for _, r in raw for i in range(len(r) - length + 1))
    out = []
    for d, r in raw:
        gone = np.zeros(len(r) + 1, np.int64)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
        out.append((d, len(r), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return sorted(map(str, out))


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéf") for _ in range(rng.randint(2, 8))) for _ in range(n))


def some(rng, n):
    rows = [prose(rng, rng.randint(0, 160)) for _ in range(n)]
    passages = [prose(rng, k) for k in (20, 30, 32, 33, 34, 35, 36, 38, 45, 60, 90)]
    for i in range(0, n, 2):
        p = rng.choice(passages)
        at = rng.randrange(len(rows[i]) + 1)
        cut = rng.randrange(len(p) // 4 + 1)
        rows[i] = rows[i][:at] + p[cut : len(p) - rng.randrange(4)] + rows[i][at:]
    for i in range(0, n, 7):  # near copies and copies
        t = list(rows[i])
        for _ in range(rng.randrange(3)):
            if t:
                t[rng.randrange(len(t))] = "#"
        rows.append("".join(t))
    rows += ["a" * 199, "a" * 200, "ab" * 150, "x" * 1500, "abc" * 400, prose(rng, 25) * 6, "", None, "é" * 130, "z" + "a" * 150]
    return list(enumerate(rows))


def result(docs, **options):
    return sorted(map(str, map(tuple, sd.digest(sd.repeated_bytes(docs, **options)).collect())))


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"most_contexts": 3}), (3, {"block": 3000}), (4, {"most_contexts": 0}), (5, {"length": 96})])
def test_equals_a_dictionary_of_windows(spark, seed, options):
    rows = some(random.Random(seed), 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(docs, **options) == plain(rows, options.get("length", 200))


def test_repeated_rows_null_ids_ties_and_clashing_columns(spark):
    rng = random.Random(9)
    t = prose(rng, 100)
    rows = [(1, t), (1, t), (None, t + "!"), (None, prose(rng, 90)), (2, prose(rng, 80)), (2, prose(rng, 80)), (3, None), (None, None), (4, t[:250])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "start", "bucket", "digest", "n", "found", "asked", "kept")})
    assert result(docs) == plain(rows)
    assert result(docs.limit(0)) == []


def test_long_texts_in_pieces(spark):
    """Texts of several pieces, which repeat at other places of their pieces."""
    rng = random.Random(4)
    long = prose(rng, 120_000)
    passage = long[300_000:301_000]
    rows = [(1, long), (2, prose(rng, 100) + passage + prose(rng, 60)), (3, "-" + long[: sd.PIECE + 500]), (4, prose(rng, 90))]
    assert len(long) > 2 * sd.PIECE
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_cover_and_distances():
    for period in (8, 16, 32, 64):
        cover = sd.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period)) and len(cover) < period // 2 + 2
    assert len(sd.COVER) <= 10
    places = np.arange(sd.PERIOD)
    for k in (sd.SHIFT + places[:, None], sd.SHIFT + places[None, :]):
        assert np.isin(k % sd.PERIOD, sd.COVER).all()


@pytest.mark.parametrize("seed", range(6))
def test_sorted_suffixes_find_repeated_windows_wherever_texts_are_laid(seed, monkeypatch):
    """Anchors at random places mix the residues, so pivots and the cover's distances decide ties; small buckets are sorted one at a time."""
    rng = random.Random(seed)
    monkeypatch.setattr(sd, "BUCKET", rng.choice([40, 1 << 16]))
    base = [prose(rng, 70).encode() for _ in range(3)] + [b"ab" * 200, b"q" * 330, prose(rng, 11).encode() * 5]
    texts = []
    for _ in range(60):
        t = rng.choice(base)
        a = rng.randrange(max(1, len(t) - 200))
        part = bytearray(t[a : a + rng.randint(200, 400)])
        if part and rng.random() < 0.5:
            part[rng.randrange(len(part))] = 0
        texts.append(bytes(part))
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    got = sd.repeated_windows(texts, np.array([rng.randrange(100) for _ in texts]))
    assert [list(map(bool, x)) for x in got] == [[seen[t[i : i + 200]] > 1 for i in range(len(t) - 199)] for t in texts]


def test_contexts_hold_every_window_once():
    rng = random.Random(6)
    texts = [t.encode() for _, t in some(rng, 40) if t]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    text, begin, windows, bucket, digest, _ = sd.contexts(data, offsets)
    held = Counter((t, b + i) for t, b, n in zip(text.tolist(), begin.tolist(), windows.tolist()) for i in range(n))
    assert held == Counter((t, o + i) for t, (o, x) in enumerate(zip(offsets.tolist(), texts)) for i in range(len(x) - 199))
    where = {}
    for b, n, key in zip(begin.tolist(), windows.tolist(), bucket.tolist()):
        for i in range(b, b + n):
            assert where.setdefault(data[i : i + 200].tobytes(), key) == key  # equal windows share the bucket


def test_query_over_the_test_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_suffix_dedup(spark, sf_dir)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = sorted(map(str, map(tuple, got.collect())))
    assert got == plain(rows) and sum(eval(r)[2] > 0 for r in got) > 5

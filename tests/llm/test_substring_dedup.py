import random

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import substring_dedup as cdc
from lodestar.llm.arrays import text_bytes


def word(rng):
    return "".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 8)))


def texts(rng, n):
    return [" ".join(word(rng) for _ in range(rng.randint(60, 200))) for _ in range(n)]


def plain(rows, least, mean):
    """Runs of chunks that other documents have, by a dictionary of chunk texts."""
    own, where = {}, {}
    for d, t in rows:
        data, offsets = text_bytes(pa.array([t], pa.string()))
        a, b, n, _, _ = cdc.chunks(data, offsets, mean)
        raw = data.tobytes()
        own.setdefault(d, []).append([(" ".join(raw[i:j].decode().split()), len(raw[:i].decode()), len(raw[:j].decode()), int(k)) for i, j, k in zip(a, b, n)])
        for c in own[d][-1]:
            where.setdefault(c[0], set()).add(d)
    out = set()
    for d, many in own.items():
        for got in many:
            run = []
            for c in [*got, None]:
                if c and len(where[c[0]]) > 1:
                    run.append(c)
                    continue
                if sum(x[3] for x in run) >= least:
                    firsts = [min(where[x[0]]) for x in run]
                    out.add((d, run[0][1], run[-1][2], sum(x[3] for x in run), len(run), max(len(where[x[0]]) for x in run), min(firsts), set(firsts) == {d}))
                run = []
    return out


@pytest.mark.parametrize("block", [8 << 20, 2000])
def test_equals_a_dictionary_of_chunks(spark, block, monkeypatch):
    monkeypatch.setattr(cdc, "BLOCK_BYTES", block)
    monkeypatch.setattr(cdc, "RANGE_CHUNKS", 300)
    rng = random.Random(block)
    rows = texts(rng, 60)
    passage = " ".join(word(rng) for _ in range(55))
    for i in range(0, 40, 3):
        w = rows[i].split()
        at = rng.randrange(len(w))
        rows[i] = " ".join([*w[:at], passage, *w[at:]])
    rows = [(i, t) for i, t in enumerate([*rows, rows[5], rows[6] + " more", "", None, "one word"])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, block int").repartition(4)
    got = {tuple(r) for r in cdc.repeated_passages(docs).collect()}
    assert got == plain(rows, cdc.LEAST_WORDS, cdc.MEAN_WORDS)
    assert set(range(0, 40, 3)) <= {g[0] for g in got}


def test_passages_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(8)
    rows, holders = [], set()
    for i, t in enumerate(texts(rng, 400)):
        rows.append([i, t])
    free = rng.sample(range(300), 160)
    for n in range(80):
        passage = " ".join(word(rng) for _ in range(51))
        for i in free[2 * n : 2 * n + 2]:
            w = rows[i][1].split(" ")
            at = rng.randrange(len(w))
            rows[i][1] = " ".join([*w[:at], passage, *w[at:]])
            holders.add(i)
    found = {r.doc_id for r in cdc.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == holders


def test_white_space_is_no_difference():
    rng = random.Random(2)
    t = " ".join(word(rng) for _ in range(200))
    wrapped = t.replace(" ", "\n", 60).replace(" ", "  ", 60)
    one, two = (cdc.chunks(*text_bytes(pa.array([x])))[4].tolist() for x in (t, wrapped))
    assert one == two and len(set(one)) > 40


def test_shifts_move_no_boundaries():
    rng = random.Random(3)
    base = " ".join(word(rng) for _ in range(300))
    cut = lambda t: [t.encode()[a:b] for a, b in zip(*cdc.chunks(*text_bytes(pa.array([t])))[:2])]
    a, b = cut(base), cut("inserted words " + base)
    assert len(set(a) & set(b)) >= len(a) - 3


def test_cut_texts(spark):
    rng = random.Random(5)
    shared = " ".join(word(rng) for _ in range(80))
    own = [" ".join(word(rng) for _ in range(70)) for _ in range(4)]
    rows = [(1, f"{own[0]} {shared}"), (2, f"{shared} {own[1]}"), (3, own[2]), (4, None)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n string")
    got = {r.doc_id: r.text for r in cdc.without_repeats(docs).collect()}
    assert got[1] == rows[0][1] and got[3] == own[2] and got[4] is None
    assert got[2].endswith(own[1][60:]) and len(got[2]) < len(rows[1][1]) - 300


def test_edges(spark):
    rng = random.Random(1)
    t = " ".join(word(rng) for _ in range(100))
    docs = spark.createDataFrame([(1, t), (1, t), (None, "a b")], "doc_id long, text string")
    assert cdc.repeated_passages(docs).count() == 0
    assert cdc.repeated_passages(docs.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, t), (None, t)], "doc_id long, text string")
    assert {(r.doc_id, r.first_doc_id) for r in cdc.repeated_passages(docs).collect()} == {(1, 1), (None, 1)}
    assert np.uint16(cdc.GEAR[0]) == cdc.GEAR[0]


def common_words(rng):
    """Documents of few, often repeated words, which hold every one-word chunk that the later ones have."""
    few = ["de", "la", "of", "the", "a", "en", "und", "is", "to", "que", "in", "der"]
    return few, [(i, " ".join(rng.choice(few) for _ in range(300))) for i in range(20)]


def mixed(rng, few, n):
    return " ".join(rng.choice(few) if rng.random() < 0.6 else word(rng) for _ in range(n))


def held(spark, rows, tmp_path):
    """op7's rows over ``rows``."""
    from lodestar.llm import queries

    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return queries.op7_substring_dedup(spark, str(tmp_path)).collect()


def test_one_holder_keeps_a_passage_of_common_words(spark, tmp_path):
    rng = random.Random(11)
    few, rows = common_words(rng)
    passages = [mixed(rng, few, 60) for _ in range(6)]
    for n, p in enumerate(passages):
        rows += [(100 + 10 * n + i, f"{mixed(rng, few, 40)} {p} {mixed(rng, few, 40)}") for i in range(3)]
    found = held(spark, rows, tmp_path)
    assert {r.doc_id: (r.first_doc_id, r.first) for r in found} == {100 + 10 * n + i: (100 + 10 * n, i == 0) for n in range(6) for i in range(3)}
    left = {r.doc_id: r.text for r in cdc.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n in range(6):
        assert left[100 + 10 * n] == dict(rows)[100 + 10 * n]
        assert all(len(left[100 + 10 * n + i].split()) <= 140 - 25 for i in (1, 2))


def test_windows_cover_what_is_shared(spark, tmp_path):
    """Two earlier documents have halves that overlap in 30 words: each half is cut, what the document is first to have stays."""
    rng = random.Random(12)
    w = [word(rng) for _ in range(150)]
    own = [" ".join(word(rng) for _ in range(60)) for _ in range(4)]
    rows = [(1, " ".join(w[:90]) + " " + own[0]), (2, own[1] + " " + " ".join(w[60:])), (3, own[2] + " " + " ".join(w)), (4, own[3])]
    left = {r.doc_id: r.text.split() for r in cdc.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left[1] == rows[0][1].split() and left[4] == own[3].split()
    assert len(left[3]) < 60 + 40 and left[3][:60] == own[2].split()
    assert set(w) <= {x for t in left.values() for x in t}
    for n in range(2, 30):
        counts = np.array([n, 0, 3])
        size = np.array([rng.randint(1, 16) for _ in range(n + 3)])
        a, b = cdc.windows(size, counts, 25)
        plain = {(i, j) for lo, hi in ((0, n), (n, n + 3)) for i in range(lo, hi) for j in range(i + 1, hi + 1) if size[i:j].sum() >= 25 and (size[i : j - 1].sum() < 25 or size[i + 1 : j].sum() < 25)}
        near = {(i, j) for i, j in plain if (i, j) == min(x for x in plain if x[0] == i) or (i, j) == max(x for x in plain if x[1] == j)}
        assert list(zip(a.tolist(), b.tolist())) == sorted(near)


def test_chance_repeats_are_no_passages(spark, tmp_path):
    """Few words, so nearly every chunk occurs in some other document; only 1000 and 1001 have 25 words in a row in common."""
    rng = random.Random(13)
    few, rows = common_words(rng)
    rows += [(100 + i, mixed(rng, few, 200)) for i in range(40)] + [(200 + i, " ".join(rng.choice(few) for _ in range(200))) for i in range(100)]
    passage = " ".join(rng.choice(few) for _ in range(80))
    rows += [(1000 + i, f"{mixed(rng, few, 50)} {passage} {mixed(rng, few, 50)}") for i in range(2)]
    rows.append((2000, ", ".join(["De"] * 120)))
    found = held(spark, rows, tmp_path)
    assert {r.doc_id for r in found} == {1000, 1001}
    for r in found:  # as a whole in the other document
        assert dict(rows)[r.doc_id][r.start : r.end] in dict(rows)[2001 - r.doc_id] and r.first == (r.doc_id == 1000)


def test_rows_of_one_id_with_several_texts_stay_whole(spark):
    """No span says which of them it is of; null ids neither. Columns named like helpers are kept."""
    rng = random.Random(15)
    passage = " ".join(word(rng) for _ in range(80))
    rest = [" ".join(word(rng) for _ in range(60)) for _ in range(5)]
    rows = [(1, f"{rest[0]} {passage}"), (2, f"{rest[1]} {passage}"), (3, f"{rest[2]} {passage}"), (3, f"{passage} {rest[3]}"), (None, f"{rest[4]} {passage}"), (2, f"{rest[1]} {passage}")]
    docs = spark.createDataFrame([(d, t, "g", 1, "e") for d, t in rows], "doc_id long, text string, _gone string, _id int, _edges string")
    left = cdc.without_repeats(docs)
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert left.columns == docs.columns and all((r._gone, r._id, r._edges) == ("g", 1, "e") for r in left.collect())
    cut = [t for d, t in got if d == 2]
    assert len(cut) == 2 and cut[0] == cut[1] and cut[0].startswith(rest[1]) and len(cut[0].split()) < 75
    assert sorted(t for d, t in got if d != 2) == sorted(t for d, t in rows if d != 2)

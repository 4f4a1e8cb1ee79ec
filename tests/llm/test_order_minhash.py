import hashlib
import random
from collections import Counter

import pytest

from lodestar.llm import order_minhash as omh


def plain(text, k=omh.K, bins=omh.BINS, row=omh.ROW):
    """The selected k-mers of each bin in text order, by the operator's own hashes of single k-mers."""
    import numpy as np

    from lodestar.llm.arrays import mix

    seen, found = Counter(), [[] for _ in range(bins)]
    with np.errstate(over="ignore"):
        for i in range(max(1, len(text) - k + 1) if text else 0):
            kmer = text[i : i + k]
            h = np.zeros(1, np.uint64)
            for j, c in enumerate(kmer):
                h = h + np.uint64(ord(c) + 1) * omh._K_POWERS[j]
            h = mix(h)
            key = int(mix(h + np.uint64(seen[kmer]) * omh._SPREAD)[0])
            seen[kmer] += 1
            found[key >> 58].append((key, i, kmer))
    return [tuple(m for _, m in sorted((i, m) for _, i, m in sorted(b)[:row])) for b in found]


def test_likeness_is_that_of_the_selected_tuples():
    rng = random.Random(3)
    words = ["the", "cat", "sat", "öl", "漢字", "🎉", "mat"]
    for n in (0, 1, 3, 30, 400, 3000):
        a = " ".join(rng.choice(words) for _ in range(n))
        b = a[: len(a) // 2] + "xy" + a[len(a) // 2 :]
        fa, fb, pa, pb = omh.fingerprint(a), omh.fingerprint(b), plain(a), plain(b)
        assert [x == 0 for x in fa] == [not t for t in pa]
        assert [x == y for x, y in zip(fa, fb)] == [x == y for x, y in zip(pa, pb)]


def test_sensitive_to_order_and_edits():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    text = " ".join(words)
    near = " ".join(words[:200] + ["changed"] + words[201:])
    moved = " ".join(words[200:] + words[:200])
    like = lambda b: omh.likeness(omh.fingerprint(text), omh.fingerprint(b))
    assert like(text) == 1.0
    assert like(near) > 0.9 > like(moved) > like(" ".join(reversed(words)))
    assert like(moved) < 0.75  # the same k-mers in another order


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_edited_texts(spark, ranges):
    rng = random.Random(2)
    texts = {i * 7 - 50: "".join(rng.choice("abc é🎉") for _ in range(rng.randint(0, 50))) for i in range(40)}
    texts[5] = None
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, range string").repartition(5)
    rows = {r.doc_id: r for r in omh.edited_likeness(docs, ranges=ranges).collect()}
    order = sorted(texts, reverse=True)
    assert rows.keys() == texts.keys()
    for d, e in zip(order, order[1:] + order[:1]):
        own, other = texts[d] or "", texts[e] or ""
        cut = len(own) // 3
        edited = own[: len(own) - cut] + other[:cut]
        r = rows[d]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        signs = [omh.fingerprint(x) for x in (own, edited, other)]
        assert (r.fingerprint, r.edited_fingerprint) == (omh.to_text(signs[0]), omh.to_text(signs[1]))
        assert (r.near_edited, r.near_next) == (omh.likeness(signs[0], signs[1]), omh.likeness(signs[0], signs[2]))


def test_repeated_single_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (None, "b")], "doc_id long, text string")
    assert omh.edited_likeness(docs, ranges=2).count() == 4
    assert omh.edited_likeness(docs.limit(1)).first().near_next == 1.0
    assert omh.edited_likeness(docs.limit(0)).count() == 0
    assert omh.fingerprints(docs).count() == 4


def test_very_long_texts_and_clashing_columns(spark):
    long = "".join(random.Random(3).choice("abcdefgh ") for _ in range(400_000))
    docs = spark.createDataFrame([(1, long, 1, True, 2), (2, long[:-100_000] + "z" * 100_000, 1, True, 2), (3, None, 1, True, 2)], "doc_id long, text string, range int, guest boolean, n_chars int")
    got = {r.doc_id: r for r in omh.edited_likeness(docs, ranges=2).collect()}
    assert got[1].n_chars == 400_000 and got[2].near_next > 0.5 and got[3].near_next == 0.0
    assert got[2].fingerprint == omh.to_text(omh.fingerprint(long[:-100_000] + "z" * 100_000))

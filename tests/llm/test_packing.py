import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestar.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["the cat sat", "", None, "the cat sat", "word " * 5000, "<|endoftext|> mid <|endoftext|>", "naïve 漢字 🎉  x\n\n" * 700, "a" * 6000, " "]


def test_pieces_and_places(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS * 4)], "doc_id long, text string, length long").repartition(3)
    rows = packing.pack_documents(docs, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    assert by_doc.keys() == set(range(len(TEXTS) * 4))
    for d, own in by_doc.items():
        ids = [*tokenizer.encode(TEXTS[d % len(TEXTS)] or "", add_special_tokens=False).ids, 0]
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 2048)))
        assert own[0].start == 0 and own[-1].start + own[-1].length == len(ids)
        assert all(r.length == 2048 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for own in by_bin.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0, *[r.length for r in own[:-1]]]))
        assert sum(r.length for r in own) <= 2048
    tokens = sum(r.length for r in rows)
    assert len(by_bin) <= 1.1 * tokens / 2048 + 2


@pytest.mark.parametrize("open_bins", [1, 4, 10_000])
def test_packer_is_best_fit_with_bounded_bins(open_bins):
    rng, packer, bins, closed = np.random.default_rng(7), packing.Packer(100, open_bins), {}, set()
    for size in rng.integers(1, 101, 3000).tolist():
        fit = [(100 - sum(v), k) for k, v in bins.items() if k not in closed and sum(v) < 100 and 100 - sum(v) >= size]
        number, offset = packer.place(size)
        if fit:
            assert 100 - sum(bins[number]) == min(fit)[0]
        else:
            assert number not in bins
            open_ = [k for k in bins if k not in closed and sum(bins[k]) < 100]
            if len(open_) == open_bins and size < 100:
                closed.add(next(k for k in reversed(packer_order(bins, open_)) if k not in packer_open(packer)))
        assert offset == sum(bins.setdefault(number, []))
        bins[number].append(size)
        assert packer.open <= open_bins
        assert packer_open(packer) == {k for k in bins if k not in closed and sum(bins[k]) < 100}


def packer_open(packer):
    return {n for own in packer.bins for n in own}


def packer_order(bins, open_):
    return sorted(open_, key=lambda k: -sum(bins[k]))


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "c"), (4, "same text"), (4, "same text"), (5, None)], "doc_id long, text string")
    rows = packing.pack_documents(docs, PATH).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["4", "4", "5", "None", "None"] and len({r.sequence_id for r in rows}) == 1
    at = sorted((r.offset, r.length) for r in rows)
    assert [a for a, _ in at] == [sum(n for _, n in at[:i]) for i in range(5)]

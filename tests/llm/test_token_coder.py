import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm import token_coder
from lodestar.llm.arrays import text_bytes
from lodestar.llm.byte_bpe import vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["the cat sat", "", None, "the cat sat", "word " * 9000, "<|endoftext|>", "naïve 漢字 🎉  x\n\n" * 700]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=60), st.integers(1, 40))
def test_blocks_round_trip(ids, times):
    ids = np.array(ids * times, np.int64)
    assert (token_coder.decode_blocks(*token_coder.encode_blocks(ids)) == ids).all()


@pytest.mark.parametrize("n", [1, 2, token_coder.BLOCK_IDS - 1, token_coder.BLOCK_IDS, token_coder.BLOCK_IDS + 1, 60_000])
def test_block_edges(n):
    rng = np.random.default_rng(n)
    for ids in (rng.zipf(1.2, n) % 50257, rng.integers(0, 50257, n), np.tile(rng.integers(0, 50257, 50), n // 50 + 1)[:n], np.full(n, 50256)):
        first, blocks = token_coder.encode_blocks(ids)
        assert len(blocks) == -(-n // token_coder.BLOCK_IDS) and (token_coder.decode_blocks(first, blocks) == ids).all()


def test_more_ids_than_contexts():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.repeat(np.arange(50257), 2), rng.integers(0, 50257, 100_000), np.tile(np.arange(9000), 4)])
    assert (token_coder.decode_blocks(*token_coder.encode_blocks(ids)) == ids).all()


def test_gain_on_real_text():
    """Bits an id, first state included, against zlib over the same blocks and the entropy of single ids."""
    data, offsets = text_bytes(pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"])
    ids = vocabulary(PATH).encode_special(data, offsets)[0]
    first, blocks = token_coder.encode_blocks(ids)
    bits = 8 * (len(first) + sum(map(len, blocks))) / len(ids)
    raw = [ids[i : i + token_coder.BLOCK_IDS].astype("<u2").tobytes() for i in range(0, len(ids), token_coder.BLOCK_IDS)]
    p = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    assert bits < 6.5 < -(p * np.log2(p)).sum() - 1 and bits < 0.7 * 8 * sum(len(zlib.compress(x, 9)) for x in raw) / len(ids)


def test_partial_last_blocks_of_real_text(monkeypatch):
    """A block ends where its ids do, with order 2 and without, in any order of the blocks."""
    data, offsets = text_bytes(pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"])
    ids = vocabulary(PATH).encode_special(data, offsets)[0]
    monkeypatch.setattr(token_coder, "BLOCK_IDS", 512)
    for share in (None, 1):
        if share:
            monkeypatch.setattr(token_coder, "FIRST", np.full(32, 1))
        for n in [*range(1, 40), *range(513, 9000, 397), 100_003]:
            first, blocks = token_coder.encode_blocks(ids[n : 2 * n])
            assert (token_coder.decode_blocks(first, blocks) == ids[n : 2 * n]).all()
            back = token_coder.decode_blocks(first, blocks[::-1])
            assert (back[: len(ids[n : 2 * n]) - 512 * (len(blocks) - 1)] == ids[n : 2 * n][512 * (len(blocks) - 1) :]).all()


def test_order_two_gains_on_real_text(monkeypatch):
    """Without order 2 a segment of real text costs more."""
    data, offsets = text_bytes(pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"][:3000].combine_chunks())
    ids = vocabulary(PATH).encode_special(data, offsets)[0]
    size = lambda: sum(map(len, token_coder.encode_blocks(ids)[1]))
    used = size()
    predict = token_coder.Shares.predict
    monkeypatch.setattr(token_coder.Shares, "predict", lambda self: (predict(self)[0] * 0 - 1, np.ones(len(self.hash), np.int64)))
    assert size() > 1.01 * used


def test_ids_beyond_the_format():
    with pytest.raises(ValueError):
        token_coder.encode_blocks(np.array([1, 65_536]))


def test_order_two_adapts_within_a_block():
    """Ids that the first state holds to be even, but that follow a rule from the last two, cost less the longer it holds."""
    rng = np.random.default_rng(3)
    rule = rng.integers(0, 32, (32, 32))
    rows = []
    for _ in range(8):
        ids = [0, 1]
        for _ in range(token_coder.BLOCK_IDS - 2):
            ids.append(rule[ids[-2], ids[-1]] if rng.random() > 0.03 else rng.integers(0, 32))
        rows.append(ids)
        rule = rng.permutation(rule.ravel()).reshape(32, 32)  # another rule in the next block
    ids = np.array(rows).ravel()
    first, blocks = token_coder.encode_blocks(ids)
    assert 8 * sum(map(len, blocks)) / len(ids) < 0.8 * 5 and (token_coder.decode_blocks(first, blocks) == ids).all()


def test_blocks_are_independent_and_checked():
    size = token_coder.BLOCK_IDS
    first, blocks = token_coder.encode_blocks(np.arange(5 * size) % 777)
    assert (token_coder.decode_blocks(first, blocks[2:3]) == np.arange(5 * size)[2 * size : 3 * size] % 777).all()
    with pytest.raises(ValueError):
        token_coder.decode_blocks(first, [blocks[1][:20] + bytes([blocks[1][20] ^ 64]) + blocks[1][21:]])
    with pytest.raises(ValueError):
        token_coder.decode_blocks(first, [b"????" + blocks[1][4:]])


def check(rows, texts):
    tokenizer, before = Tokenizer.from_file(PATH), 0
    for r, text in zip(rows, texts, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)


def test_documents_round_trip(spark, monkeypatch):
    docs = spark.createDataFrame([(3 * i, t, i) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string, n_tokens long").repartition(5)
    rows = sorted(token_coder.round_trip(docs, PATH, files=4).collect())
    assert [r.doc_id for r in rows] == [3 * i for i in range(len(TEXTS) * 3)]
    check(rows, TEXTS * 3)


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(2, "b"), (None, "z"), (2, "a"), (None, None), (1, "long " * 5000)], "doc_id long, text string")
    rows = token_coder.round_trip(docs, PATH, files=2).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 2]
    check(rows, [None, "z", "long " * 5000, "a", "b"])


def test_empty_table(spark):
    assert token_coder.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0

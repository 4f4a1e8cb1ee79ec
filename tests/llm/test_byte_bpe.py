import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodestar.llm import byte_bpe
from lodestar.llm.arrays import text_bytes

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = public_tokenizers.path("byte_bpe_50k.json")
EDGES = ["", None, " ", "\n\n", "'s", "'re", "I'll've'd''s 's", "x" * 3000, "ab" * 900 + " " * 300, "'" * 99, "a\x85b\xa0c　d", "naïve 漢字 🎉"]


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def split(ids, counts):
    ends = np.cumsum(counts)
    return [ids[a:b].tolist() for a, b in zip(ends - counts, ends)]


@pytest.mark.parametrize("cache", [400_000, 50])
def test_equals_the_libraries(cache, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", cache)
    rng = random.Random(5)
    letters = list("aabstmdrevl'''   \n\t09!.é漢🎉 　​Ä-_\x85²Ⅷ")
    texts = EDGES + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    ranks, model, library, tokenizer = byte_bpe.Vocabulary(RANKS), byte_bpe.Vocabulary(MODEL), encoding(), Tokenizer.from_file(MODEL)
    for part in (texts[:1500], texts[1500:]):
        assert split(*ranks.encode(*text_bytes(pa.array(part)))) == [library.encode_ordinary(t or "") for t in part]
        assert split(*model.encode(*text_bytes(pa.array(part)))) == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]


def test_special_tokens_in_texts():
    texts = ["<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endo", "ftext|>", "<|endoftext|><|endoftext|>x", "plain"]
    tokenizer = Tokenizer.from_file(MODEL)
    assert split(*byte_bpe.Vocabulary(MODEL).encode_special(*text_bytes(pa.array(texts)))) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_operator(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(EDGES)], "doc_id long, text string, ids long")
    library = encoding()
    rows = {r.doc_id: r for r in byte_bpe.round_trip(docs, RANKS).collect()}
    encoded = byte_bpe.encode(docs, RANKS)
    decoded = {r.doc_id: bytes(r.content) for r in byte_bpe.decode(encoded, RANKS).collect()}
    for r in encoded.collect():
        raw = (EDGES[r.doc_id] or "").encode()
        ids = library.encode_ordinary(raw.decode())
        assert r.ids == ids and decoded[r.doc_id] == raw
        assert [raw[a:b] for a, b in zip(r.offsets, [*r.offsets[1:], len(raw)])] == [library.decode_single_token_bytes(i) for i in ids]
        assert (rows[r.doc_id].n_tokens, rows[r.doc_id].ids_sha256, rows[r.doc_id].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest())
    assert byte_bpe.round_trip(docs.limit(0), RANKS).count() == 0


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (7, None)], "doc_id long, text string")
    rows = byte_bpe.round_trip(docs, RANKS).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == [("7", 0), ("7", 2), ("7", 2), ("None", 2)]


def test_states_equal_a_plain_scan():
    """Also where endings follow each other over the blocks' borders."""
    rng = np.random.default_rng(4)
    for p in ([0.4, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1], [0.05, 0, 0, 0, 0, 0.45, 0.5], [0.97, 0, 0, 0.02, 0, 0.01, 0]):
        classes = rng.choice(7, 1000, p=p).astype(np.uint8)
        classes[rng.random(1000) < 0.02] += byte_bpe.FIRST
        classes[0] = byte_bpe.FIRST + classes[0] % byte_bpe.FIRST
        state, want = byte_bpe.FRESH, []
        for c in classes.tolist():
            want.append(state)
            state = int(byte_bpe.STEP[c * 8 + state])
        assert byte_bpe.states_before(classes).tolist() == want

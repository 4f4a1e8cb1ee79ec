"""LM scoring by a weighted backoff automaton.

An n-gram is a state, a word an arc: p_k(w | h) = (1 - l) c(hw) / c(h) + l p_{k-1}(w | h'), where l is the share of
training tokens, after contexts counted about as often as h (by powers of two), whose n-gram occurs once: the
leave-one-out chance of a new continuation. A seen hw is an arc of weight log10 p_k; an unseen one follows the
failure arc of weight log10 l to the shorter context, down to p_1 = (c + 1) / (N + V + 1).

The model is as large as the corpus, so no task ever holds it. Texts become blocks (a dictionary of word hashes
and codes) in buckets on the shared folder; a block asks for its distinct n-grams only, in packed key ranges; the owner of
a range sums all training counts and answers each block with what others add to its own; the answers meet the block's bucket
without another shuffle of the blocks. The block then holds the part of the automaton that its texts can reach, and one
left-to-right traversal of all its texts in step carries each text's state and accumulates its log-probability. Nothing is
pruned, capped or sampled.

Words are 64-bit hashes, of which 56 travel beside their range's number, of longer n-grams 48. Defined results: null text is
empty and has only the end token; rows with a null doc_id are training rows; rows that repeat a doc_id are scored and count
each; no two n-grams tie, since weights are exact functions of counts; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_buckets
from .arrays import LOWER, groups, mix, pack, range_of, slices, span_hashes, tail, text_bytes, unpack, words

#: Highest n-gram length; bytes of text in a block; tokens a key range stands for.
ORDER, BLOCK_BYTES, RANGE_TOKENS = 3, 9 << 20, 2_000_000
END, START = np.uint64(0x8F3A6B1C2D4E5F60), np.uint64(0x1B7C9D2E3F405162)
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Powers of two of context counts; bits of a key that stay at home, of a word and of a longer n-gram.
BINS, WORD_DROPPED, GRAM_DROPPED = 48, 8, 16


def tokenize(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an end token after each text, tokens of each text)."""
    data = LOWER[data]
    starts, ends, owner = words(data, offsets)
    count = np.bincount(owner, minlength=len(offsets) - 1) if len(owner) else np.zeros(len(offsets) - 1, np.int64)
    tokens = np.full(len(starts) + len(count), END, np.uint64)
    tokens[np.arange(len(starts)) + owner] = span_hashes(data, starts, ends)
    return tokens, count + 1


def _blocks(docs: DataFrame, doc_id: Column, text: Column, held: Column) -> DataFrame:
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.binary()), ("words", pa.binary()), ("codes", pa.binary()), ("tokens", pa.int64()), ("train", pa.int64())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in slices(source, "text", BLOCK_BYTES):
            got = [tokenize(*text_bytes(x.column("text"))) for x in slices(iter([part]), "text")]
            tokens, lengths = (np.concatenate(x) for x in zip(*got))
            del got
            distinct, codes = groups(tokens)
            often = np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")  # small codes for frequent words
            place = np.empty(len(often), np.uint32)
            place[often] = np.arange(len(often), dtype=np.uint32)
            kept = part.column("held").to_pylist()
            train = int(lengths[~np.array(kept, bool)].sum())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([number, part.column("doc_id").to_pylist(), kept, pack(lengths.astype(np.uint32)), pack(distinct[often]), pack(place[codes]), len(tokens), train], schema.types)], schema=schema)
            number += 1

    rows = docs.select(doc_id.cast("long").alias("doc_id"), text.alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    return rows.mapInArrow(batches, "block long, doc_ids array<long>, held array<boolean>, lengths binary, words binary, codes binary, tokens long, train long")


def _grams(lengths: np.ndarray, tokens: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams ending at each token, by length; the start stands before a text."""
    keys, first = [tokens], np.cumsum(lengths) - lengths
    inside = np.arange(len(tokens)) - np.repeat(first, lengths)
    for k in range(2, order + 1):
        before = np.empty(len(tokens), np.uint64)
        before[1:] = keys[-1][:-1]
        before[inside == 0] = START + np.uint64(k)
        keys.append(mix(before * STEP + tokens + np.uint64(k)))
    return keys


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths = unpack(row["lengths"], np.uint32).astype(np.int64)
    codes = unpack(row["codes"], np.uint32)
    return lengths, codes, unpack(row["words"], np.uint64), np.repeat(~np.array(row["held"], bool), lengths)


def _dropped(k: int) -> int:
    return WORD_DROPPED if k == 1 else GRAM_DROPPED


def _requests(order: int, bits: int):
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("k", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                lengths, codes, table, train = _read(row)
                for k, keys in enumerate(_grams(lengths, table[codes], order), 1):
                    distinct, place = groups(keys)
                    counts = np.bincount(place, weights=train, minlength=len(distinct)).astype(np.uint32)
                    if k == 1:  # the start is a context only
                        distinct, counts = _with_start(distinct, counts, int((~np.array(row["held"], bool)).sum()))
                    parts = range_of(distinct, bits)
                    edges = np.flatnonzero(np.diff(parts, prepend=-1, append=-1))
                    columns: list[list] = [[], [], [], [], []]
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                        for column, value in zip(columns, (int(parts[a]), row["block"], k, pack(np.diff(tail(distinct[a:b], bits, _dropped(k)), prepend=np.uint64(0))), pack(counts[a:b]))):
                            column.append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return batches


def _with_start(distinct: np.ndarray, counts: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    at = int(np.searchsorted(distinct, START))
    return np.insert(distinct, at, START), np.insert(counts, at, texts)


def _answers(bits: int):
    start_part = int(range_of(np.array([START]), bits)[0])

    def answer(table: pa.Table) -> pa.Table:
        """All requests of one key range: sums by key, and for each block what other blocks add to its keys' counts, in its order."""
        out: list[list] = [[], [], [], [], []]
        rows = table.to_pylist()
        for k in sorted({r["k"] for r in rows}):
            own = [r for r in rows if r["k"] == k]
            keys = [np.cumsum(unpack(r["keys"], np.uint64)) for r in own]
            counts = np.concatenate([unpack(r["counts"], np.uint32) for r in own])
            distinct, place = groups(np.concatenate(keys) << np.uint64(_dropped(k)))
            sums = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.uint64)
            seen = int((sums > 0).sum())
            if k == 1 and rows[0]["part"] == start_part:
                seen -= int(sums[np.searchsorted(distinct, tail(np.array([START]), bits)[0] << np.uint64(WORD_DROPPED))] > 0)
            told, edge = sums[place] - counts, 0
            for r, n in zip(own, map(len, keys)):
                for column, value in zip(out, (r["block"], r["part"], k, pack(told[edge : edge + n]), seen if k == 1 else 0)):
                    column.append(value)
                edge += n
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()))], names=["block", "part", "k", "others", "seen"])

    return answer


@dataclass
class Counted:
    """A block's n-grams: for each length the place of the one ending at each token among the distinct, and their corpus counts."""

    lengths: np.ndarray
    train: np.ndarray
    places: list[np.ndarray]
    counts: list[np.ndarray]
    start: int

    def at_tokens(self, k: int) -> np.ndarray:
        return self.counts[k - 1][self.places[k - 1]]


def _counted(row: dict, told: list[bytes], order: int) -> Counted:
    """``told`` has what other blocks add to the counts of the block's distinct n-grams, in the order in which it asked (the start among the words)."""
    lengths, codes, table, train = _read(row)
    found = Counted(lengths, train, [], [], 0)
    for k, (keys, others) in enumerate(zip(_grams(lengths, table[codes], order), told), 1):
        distinct, place = groups(keys)
        counts, others = np.bincount(place, weights=train, minlength=len(distinct)).astype(np.int64), unpack(others, np.uint64).astype(np.int64)
        if k == 1:
            at = int(np.searchsorted(distinct, START))
            found.start = int(others[at]) + int((~np.array(row["held"], bool)).sum())
            others = np.delete(others, at)
        found.places.append(place)
        found.counts.append(counts + others)
    return found


def _resolve(order: int):
    def resolve(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        """What other blocks add to a block's distinct n-grams, and what the block adds to the shares of new continuations."""
        out = []
        told = sorted(answers.to_pylist(), key=lambda r: (r["k"], r["part"]))
        for row in blocks.to_pylist():
            others = [pack(np.concatenate([unpack(r["others"], np.uint64) for r in told if r["k"] == k])) for k in range(1, order + 1)]
            found = _counted(row, others, order)
            single, every = np.zeros((order, BINS)), np.zeros((order, BINS))
            for k in range(2, order + 1):
                now, context = found.at_tokens(k)[found.train], _before(found.lengths, found.at_tokens(k - 1), found.start)[found.train]
                slot = _bins(context)
                every[k - 1] = np.bincount(slot, minlength=BINS)
                single[k - 1] = np.bincount(slot[now == 1], minlength=BINS)
            out.append({"block": row["block"], "others": others, "single": single.ravel().tolist(), "every": every.ravel().tolist(), "ranges": [{"part": r["part"], "seen": r["seen"]} for r in told if r["k"] == 1]})
        return pa.Table.from_pylist(out, schema=_resolved_arrow)

    return resolve


_resolved_arrow = pa.schema([("block", pa.int64()), ("others", pa.list_(pa.binary())), ("single", pa.list_(pa.float64())), ("every", pa.list_(pa.float64())), ("ranges", pa.list_(pa.struct([("part", pa.int64()), ("seen", pa.int64())])))])
_resolved = "block long, others array<binary>, single array<double>, every array<double>, ranges array<struct<part: long, seen: long>>"


def _bins(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1].clip(0, BINS - 1)


def _before(lengths: np.ndarray, values: np.ndarray, start: int) -> np.ndarray:
    """The value of the token before each; of a text's first token that of the start."""
    out = np.empty(len(values), np.int64)
    out[1:] = values[:-1]
    out[np.cumsum(lengths) - lengths] = start
    return out


@dataclass
class Automaton:
    """States are 0 (no context) and contexts of up to order - 1 tokens; ``level`` has their length.

    Arc a leads from source[a] to target[a] with weight[a]; a failure arc from every state s but 0 to fail[s] with fail_weight[s].
    lookup[k, i] is the arc of the (k + 1)-gram that ends at token i, -1 if the corpus doesn't have it: an index by place instead
    of a table by (state, word), which a traversal checks against the arc's source.
    """

    source: np.ndarray
    target: np.ndarray
    weight: np.ndarray
    fail: np.ndarray
    fail_weight: np.ndarray
    level: np.ndarray
    lookup: np.ndarray
    start: int


def _automaton(found: Counted, order: int, room: float, share: np.ndarray) -> Automaton:
    """The part of the corpus's automaton that a block's texts can reach."""
    n, first = len(found.places[0]), np.cumsum(found.lengths) - found.lengths
    sizes = [len(c) for c in found.counts[: order - 1]]
    base = 1 + np.concatenate([[0], np.cumsum([s + 1 for s in sizes])]).astype(np.int64)  # the start is the last state of its level
    n_states = int(base[-1])
    ends = [found.places[k] + base[k] for k in range(order - 1)]  # the state of the context that ends at each token
    starts = [int(base[k + 1]) - 1 for k in range(order - 1)]
    fail, level, fail_weight = np.zeros(n_states, np.int64), np.zeros(n_states, np.int8), np.zeros(n_states)
    for k in range(order - 1):
        own = slice(int(base[k]), int(base[k + 1]))
        level[own] = k + 1
        if k:
            fail[ends[k]] = ends[k - 1]
            fail[starts[k]] = starts[k - 1]
        held = np.append(found.counts[k], found.start)
        fail_weight[own] = np.log10(np.where(held > 0, share[k + 1][_bins(held)], 1.0))
    lookup, sources, targets, weights, made = np.full((order, n), -1, np.int32), [], [], [], 0
    p = None
    for k in range(order):
        counts, place = found.counts[k], found.places[k]
        sample = np.zeros(len(counts), np.int64)
        sample[place] = np.arange(n)
        if k:
            source = _before(found.lengths, ends[k - 1], starts[k - 1])[sample]
            context = np.append(found.counts[k - 1], found.start)[source - base[k - 1]]
            left = 10.0 ** fail_weight[source]
            p = left * p[found.places[k - 1][sample]] + (1 - left) * counts / np.maximum(context, 1)
        else:
            source, p = np.zeros(len(counts), np.int64), (counts + 1) / room
        seen = np.flatnonzero(counts > 0) if k else np.arange(len(counts))
        arc = np.full(len(counts), -1, np.int32)
        arc[seen] = made + np.arange(len(seen))
        lookup[k] = arc[place]
        sources.append(source[seen])
        targets.append(ends[min(k, order - 2)][sample[seen]] if order > 1 else np.zeros(len(seen), np.int64))
        weights.append(np.log10(p[seen]))
        made += len(seen)
    return Automaton(*[np.concatenate(x) for x in (sources, targets, weights)], fail, fail_weight, level, lookup, starts[-1] if starts else 0)


def _traverse(lengths: np.ndarray, a: Automaton) -> np.ndarray:
    """log10 probability of each text: all texts advance together, each from the state that its last token left it in.

    Where a state has no arc for the token, its failure arc is taken, and then that state's; state 0 has one for every token.
    """
    score, order = np.zeros(len(lengths)), np.argsort(-lengths, kind="stable")
    first, left = (np.cumsum(lengths) - lengths)[order], lengths[order]
    alive = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), "left")
    total, state = np.zeros(len(lengths)), np.full(len(lengths), a.start)
    flat, n = a.lookup.ravel(), a.lookup.shape[1]
    for t, k in enumerate(alive.tolist()):
        rows, at, now = np.arange(k), first[:k] + t, state[:k].copy()
        while len(rows):
            arc = flat.take(a.level.take(now) * np.int64(n) + at)
            has = (arc >= 0) & (a.source.take(arc) == now)
            taken = arc[has]
            total[rows[has]] += a.weight.take(taken)
            state[rows[has]] = a.target.take(taken)
            has = ~has
            rows, at, now = rows[has], at[has], now[has]
            total[rows] += a.fail_weight.take(now)
            now = a.fail.take(now)
    score[order] = total
    return score


def _score(order: int, total: int, distinct: int, share: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    room = float(total + distinct + 1)

    def scores(blocks: pa.Table, resolved: pa.Table) -> pa.Table:
        """The automaton that a block's texts can reach, and its traversal."""
        told, out = {r["block"]: r["others"] for r in resolved.select(["block", "others"]).to_pylist()}, []
        for row in blocks.to_pylist():
            found = _counted(row, told[row["block"]], order)
            lengths = found.lengths
            if not len(lengths):
                continue
            edges, words_seen = np.cumsum(lengths) - lengths, found.at_tokens(1)
            score = _traverse(lengths, _automaton(found, order, room, share))
            base = np.log10((words_seen + 1) / room)
            sums = lambda x: np.add.reduceat(x, edges)  # noqa: E731  every text has its end token
            out.append(pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"]), pa.array(lengths), pa.array(sums((words_seen > 0).astype(np.int64))), pa.array(np.full(len(lengths), total)), pa.array(sums(base)), pa.array(score)], schema=schema))
        return pa.Table.from_batches(out, schema)

    return scores


def score(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", held: Column | None = None, order: int = ORDER) -> DataFrame:
    """Scores of every text under the model of the texts for which ``held`` isn't true.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram) and score, log10 probabilities.
    """
    blocks = stage_buckets(_blocks(docs, F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.lit(False) if held is None else held), "lm-blocks", "block")
    sizes = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("train"), F.lit(0)).alias("train")).first()
    bits = max(0, (int(sizes["tokens"]) * order // RANGE_TOKENS).bit_length())
    requests = blocks.select("block", "held", "lengths", "words", "codes").mapInArrow(_requests(order, bits), "part long, block long, k int, keys binary, counts binary")
    answers = requests.groupBy("part").applyInArrow(_answers(bits), "block long, part long, k int, others binary, seen long")
    payload = blocks.select("block", "doc_ids", "held", "lengths", "words", "codes").groupBy("block")
    resolved = stage_buckets(payload.cogroup(answers.groupBy("block")).applyInArrow(_resolve(order), _resolved), "lm-resolved", "block")
    new = {(r["what"], r["pos"]): r["n"] for what in ("single", "every") for r in resolved.select(F.lit(what).alias("what"), F.posexplode(what).alias("pos", "n")).groupBy("what", "pos").agg(F.sum("n").alias("n")).collect()}  # order * BINS numbers
    single, every = (np.array([new.get((what, i), 0.0) for i in range(order * BINS)]).reshape(order, BINS) for what in ("single", "every"))
    share = (single + 1) / (every + 2)  # never 0 or 1: a new continuation is always possible
    distinct = resolved.select(F.explode("ranges").alias("r")).select("r.part", "r.seen").distinct().agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("n")).first()["n"]
    scores = _score(order, int(sizes["train"]), int(distinct), share)
    return payload.cogroup(resolved.select("block", "others").groupBy("block")).applyInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""Quality classifier with hierarchical empirical Bayes over sites.

Text evidence: two logistic regressions, for poor and for toxic texts, on the shape of the text and on the presence of
the words most associated with either label, fitted on a bounded sample of labelled rows (SAMPLE rows, those of least
hash; everything after uses all documents). Site evidence: expected bad documents by host and by path, summed over all
documents with grouped aggregation. The spread of the hosts' rates beyond chance gives the strength of the global prior,
that of the paths' rates within hosts the strength of the hosts' prior: a site with few documents, or none beyond chance,
shrinks to its parent. A document's log-odds are those of its text plus its path's posterior against the global rate.

Sites that hold over 1/HOT_SHARE of all rows (at most HOT_SHARE) are joined by broadcast, the others by a shuffle.

Defined results: null text is empty; null labels are not used; without labels of both kinds nothing is rejected for that
kind; null host or path values are sites of their own; repeated rows count each, and rows with a null doc_id are one
document to ``keep_good``; an empty table gives an empty result. The table `documents` has no URLs: its `source` stands for
the host and its `lang` for the path, unless other columns are given. A document's own evidence is part of its site's sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .arrays import LOWER, groups, mix, slices, span_hashes, text_bytes
from .names import fresh

#: Labelled rows that the classifier is fitted on, words it may use for each label, the least documents a word is in.
SAMPLE, WORDS, SUPPORT = 6000, 256, 3
#: Bytes of the beginnings of words that are features as well.
PREFIXES = (4, 5)
#: Rejected at this probability.
REJECT, HOT_SHARE = 0.5, 1000
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "!#$%&*+<=>[\\]^_`{|}~"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
SHAPE = ("symbols", "symbol_words", "upper", "digits", "adjacent", "repeated", "word_bytes", "log_words", "no_words")


def _runs(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(solid)]
    first[inner] = solid[inner]
    last[:-1] &= ~solid[1:] | first[1:]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def look(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shape features by text, hashes of words and of their beginnings, text number of each)."""
    texts = len(offsets) - 1
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    count = lambda at, n=texts: np.bincount(at, minlength=n).astype(np.float64)
    starts, ends, word_of = _runs(_WORD[data], offsets)
    lower = LOWER[data]
    hashes = span_hashes(lower, starts, ends)
    words, size = count(word_of), np.maximum(1, np.diff(offsets)).astype(np.float64)
    per_word = np.maximum(1, words)
    spans, span_ends, span_of = _runs(~_SPACE[data], offsets)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    with_symbol = span_of[symbols[span_ends] > symbols[spans]]
    letters = ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90))
    upper = (data >= 65) & (data <= 90)
    same = np.zeros(len(hashes), bool)
    if len(hashes):
        same[1:] = (hashes[1:] == hashes[:-1]) & (word_of[1:] == word_of[:-1])
    # word pairs that the text had before, which long clean texts hardly repeat
    pairs = mix(hashes[1:] * np.uint64(3) + hashes[:-1] + word_of[1:].astype(np.uint64))[word_of[1:] == word_of[:-1]] if len(hashes) > 1 else hashes[:0]
    pair_of = word_of[1:][word_of[1:] == word_of[:-1]] if len(hashes) > 1 else word_of[:0]
    distinct, place = groups(pairs)
    sample = np.zeros(len(distinct), np.int64)
    sample[place] = np.arange(len(place))
    repeated = count(pair_of) - count(pair_of[sample])
    shape = np.column_stack([
        count(owner[_SYMBOL[data]]) / size, count(with_symbol) / np.maximum(1, count(span_of)), count(owner[upper]) / np.maximum(1, count(owner[letters])),
        count(owner[(data >= 48) & (data <= 57)]) / size, count(word_of[same]) / per_word, repeated / per_word,
        np.minimum(30, np.bincount(word_of, weights=ends - starts, minlength=texts) / per_word) / 10, np.log1p(words) / 5, words == 0,
    ])
    # beginnings of words stand for their families
    parts, owners = [hashes], [word_of]
    for n in PREFIXES:
        longer = ends - starts > n
        parts.append(mix(span_hashes(lower, starts[longer], starts[longer] + n) + np.uint64(n)))
        owners.append(word_of[longer])
    order = np.argsort(np.concatenate(owners), kind="stable")
    return shape, np.concatenate(parts)[order], np.concatenate(owners)[order]


@dataclass
class Model:
    """p(bad) of a kind: weights of the standardised shape, and of the words' presence."""

    words: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float = -30.0

    def log_odds(self, shape: np.ndarray, hashes: np.ndarray, word_of: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(shape), self.constant)
        at = np.minimum(np.searchsorted(self.words, hashes), max(0, len(self.words) - 1))
        found = self.words[at] == hashes if len(self.words) else np.zeros(len(hashes), bool)
        x = _design(shape, self.mean, self.scale)
        present = np.unique(word_of[found] * max(1, len(self.words)) + at[found])
        word_part = np.bincount(present // max(1, len(self.words)), weights=self.weights[x.shape[1] :][present % max(1, len(self.words))], minlength=len(shape)) if len(present) else np.zeros(len(shape))
        return x @ self.weights[: x.shape[1]] + word_part


def _design(shape: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(shape)), np.clip((shape - mean) / scale, -8, 8)])


def fit(shape: np.ndarray, words: list[np.ndarray], bad: np.ndarray, most: int = WORDS, support: int = SUPPORT) -> Model:
    """Logistic regression by Newton's method with a Gaussian prior; words chosen by their likelihood ratio statistic."""
    mean, scale = shape.mean(0), shape.std(0) + 1e-3
    if bad.all() or not bad.any():
        return Model(np.zeros(0, np.uint64), mean, scale, np.zeros(0), 30.0 if bad.all() and len(bad) else -30.0)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    distinct, place = np.unique(np.concatenate(words), return_inverse=True)
    inside, total = np.bincount(place, weights=bad[owner], minlength=len(distinct)), np.bincount(place, minlength=len(distinct))
    n1, n0 = bad.sum(), (~bad).sum()
    a, b = inside + 0.5, total - inside + 0.5
    ratio = np.log(a / (n1 + 1)) - np.log(b / (n0 + 1))
    gain = np.where((ratio > 1.5) & (inside >= support), inside * ratio, 0)
    chosen = np.argsort(-gain, kind="stable")[:most]
    chosen = np.sort(chosen[gain[chosen] > 6])
    x = np.zeros((len(words), 1 + shape.shape[1] + len(chosen)))
    x[:, : 1 + shape.shape[1]] = _design(shape, mean, scale)
    column = np.full(len(distinct), -1)
    column[chosen] = np.arange(len(chosen))
    keep = column[place] >= 0
    x[owner[keep], 1 + shape.shape[1] + column[place[keep]]] = 1
    prior = np.append([1e-4], np.full(x.shape[1] - 1, 0.3))
    prior[1 + shape.shape[1] :] = 0.01
    w, y = np.zeros(x.shape[1]), bad.astype(np.float64)
    w[0] = np.log(n1 / n0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(prior), x.T @ (y - p) - prior * w)
        w += step / max(1, np.abs(step).max() / 3)
        if np.abs(step).max() < 1e-4:
            break
    return Model(distinct[chosen], mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> tuple[Model, Model]:
    """Models of (poor, toxic) from the ``sample`` labelled rows of least hash."""
    rows = labels.select(F.col("doc_id").cast("long").alias("label_id"), (F.col("quality") == 0).alias("poor"), (F.col("toxic") == 1).alias("toxic")).dropna()
    rows = rows.orderBy(F.xxhash64("label_id"), "label_id", "poor", "toxic").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    joined = texts.join(F.broadcast(rows), F.col("id") == F.col("label_id")).select("id", "text", "poor", "toxic")  # at most ``sample`` rows

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(source, "text"):
            shape, hashes, word_of = look(*text_bytes(part.column("text")))
            first = np.searchsorted(word_of, np.arange(part.num_rows + 1))
            own = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(list(shape), pa.list_(pa.float64())), pa.array(own, pa.list_(pa.int64())), part.column("poor"), part.column("toxic")], ["id", "shape", "words", "poor", "toxic"])

    got = joined.mapInArrow(batches, "id long, shape array<double>, words array<long>, poor boolean, toxic boolean").toArrow().sort_by("id")
    if not got.num_rows:
        none = Model(np.zeros(0, np.uint64), np.zeros(len(SHAPE)), np.ones(len(SHAPE)), np.zeros(0))
        return none, none
    shape = np.array(got["shape"].to_pylist())
    words = [np.asarray(x.values, np.int64).view(np.uint64) for x in got["words"]]
    poor, toxic = np.array(got["poor"].to_pylist(), bool), np.array(got["toxic"].to_pylist(), bool)
    return fit(shape, words, poor), fit(shape, words, toxic)


def text_evidence(docs: DataFrame, models: tuple[Model, Model], host: Column, path: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, host, path, p_poor, p_toxic, p_text (bad for either reason) of every document."""
    poor, toxic = models

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(source, "text"):
            seen = look(*text_bytes(part.column("text")))
            p = [1 / (1 + np.exp(-np.clip(m.log_odds(*seen), -30, 30))) for m in (poor, toxic)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), part.column("path"), pa.array(p[0]), pa.array(p[1]), pa.array(1 - (1 - p[0]) * (1 - p[1]))], ["doc_id", "host", "path", "p_poor", "p_toxic", "p_text"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, host string, path string, p_poor double, p_toxic double, p_text double")


def _strength(between: Column, rate: Column) -> Column:
    """Prior documents that a rate is worth, from the variance of the rates between sites beyond chance; null if there is none."""
    return F.when(between > 1e-9, F.greatest(rate * (1 - rate) / between - 1, F.lit(1.0)))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """host, path, n, global_rate, host_rate, path_rate: rates of bad documents, each shrunk toward its parent's."""
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_text").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.count("*").alias("n_paths"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss"))
    all_ = hosts.agg(F.sum("host_n").alias("N"), F.sum("host_s").alias("S"), F.count("*").alias("H"), F.sum(F.col("host_n") * F.col("host_n")).alias("NN"), F.sum(F.col("host_s") * F.col("host_s") / F.col("host_n")).alias("SS"), F.sum(F.col("ss") - F.col("host_s") * F.col("host_s") / F.col("host_n")).alias("within"), F.sum(F.col("n_paths") - 1).alias("W"), F.sum(F.col("nn") / F.col("host_n")).alias("NW"))
    m = (F.col("S") + 0.5) / (F.col("N") + 1)
    chance = m * (1 - m)
    top = all_.select(
        m.alias("global_rate"),
        _strength((F.col("SS") - F.col("S") * F.col("S") / F.col("N") - (F.col("H") - 1) * chance) / F.greatest(F.lit(1.0), F.col("N") - F.col("NN") / F.col("N")), m).alias("host_k"),
        _strength((F.col("within") - F.col("W") * chance) / F.greatest(F.lit(1.0), F.col("N") - F.col("NW")), m).alias("path_k"),
    )
    shrink = lambda s, n, k, parent: F.when(k.isNull(), parent).otherwise((s + k * parent) / (n + k))
    rated = hosts.crossJoin(F.broadcast(top)).select("host", "global_rate", "path_k", shrink(F.col("host_s"), F.col("host_n"), F.col("host_k"), F.col("global_rate")).alias("host_rate"))  # ``top`` is one row
    rated = rated.withColumnRenamed("host", "of")
    return paths.join(rated, paths["host"].eqNullSafe(rated["of"])).select("host", "path", "n", "global_rate", "host_rate", shrink(F.col("s"), F.col("n"), F.col("path_k"), F.col("host_rate")).alias("path_rate"))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, reject: float = REJECT) -> DataFrame:
    """One row per document: doc_id, host, path, p_poor, p_toxic, p_text, path_rate, p_bad, keep."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    evidence = stage(text_evidence(docs, train(docs, labels, text_col, id_col, sample), host, path, text_col, id_col), "evidence")
    sites = stage(site_posteriors(evidence), "sites")
    total = sites.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rate = sites.select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), F.col("path_rate").alias("rate"), F.col("global_rate").alias("base"), "n")
    hot = rate.filter(F.col("n") * HOT_SHARE >= total).drop("n")
    cold = rate.filter(F.col("n") * HOT_SHARE < total).drop("n")
    at = (F.col("host").eqNullSafe(F.col("site_host"))) & (F.col("path").eqNullSafe(F.col("site_path")))
    warm = evidence.join(F.broadcast(hot), at, "left").drop("site_host", "site_path")
    rows = warm.filter("rate is not null").unionByName(warm.filter("rate is null").drop("rate", "base").join(cold, at).drop("site_host", "site_path"))
    odds = lambda p: F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
    bad = 1 / (1 + F.exp(-(odds(F.col("p_text")) + odds(F.col("rate")) - odds(F.col("base")))))
    return rows.select("doc_id", "host", "path", "p_poor", "p_toxic", "p_text", F.col("rate").alias("path_rate"), bad.alias("p_bad")).withColumn("keep", F.col("p_bad") < reject)


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those that the classifier rejects (all rows of a rejected doc_id)."""
    name = fresh(docs, "_gone")
    gone = classify(docs, labels, text_col=text_col, id_col=id_col, **options).filter("not keep").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(name)), "left_anti")

"""UDF-2..6: seams for models, with deterministic defaults that need none."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: An encoder adds a vector column to (id, text) rows; a scorer is a column over query and passage text.
Encoder = Callable[[DataFrame], DataFrame]
Scorer = Callable[[Column, Column], Column]
DIMENSIONS = 256
#: Texts that are encoded at once.
SLICE_TEXTS = 1024


def hashed_encoder(dimensions: int = DIMENSIONS) -> Encoder:
    """How many of a text's tokens fall into each bucket of their MD5; texts without tokens have no vector."""

    def vectors(texts: pa.Array) -> pa.Array:
        found, lengths = tx.token_runs(texts)
        coded, n = found.dictionary_encode(), len(texts)  # a distinct token is hashed once
        buckets = np.array([int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % dimensions for t in coded.dictionary.to_pylist()], np.int64)
        owner = np.repeat(np.arange(n), lengths)
        counts = np.bincount(owner * dimensions + buckets[coded.indices.to_numpy()], minlength=n * dimensions).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dimensions, pa.int32()), pa.array(counts), mask=pa.array(lengths == 0))

    def encode(rows: DataFrame) -> DataFrame:
        def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in (batch.slice(at, SLICE_TEXTS) for batch in source for at in range(0, batch.num_rows, SLICE_TEXTS)):
                yield pa.RecordBatch.from_arrays([part.column("id"), vectors(part.column("text"))], ["id", "vector"])

        return rows.select("id", F.lower("text").alias("text")).mapInArrow(batches, f"id {rows.schema['id'].dataType.simpleString()}, vector array<float>")

    return encode


def with_recovery(encoder: Encoder, least: int = 40) -> Encoder:
    """AGG-19, 2.11.11: texts that ``encoder`` leaves without a vector (null, or with a value that isn't finite) are encoded by their
    halves, cut at ``split_point``, whose mean stands for them; if a half fails too, the text has no vector."""

    def usable(rows: DataFrame) -> DataFrame:
        whole = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
        return rows.withColumn("vector", F.when(whole, F.col("vector")))

    def encode(rows: DataFrame) -> DataFrame:
        first = usable(encoder(rows))
        lost = rows.join(first.filter("vector IS NULL").select("id"), "id", "left_semi").filter(F.length("text") > 1)
        at = split_point(F.col("text"), least)
        halves = lost.select("id", F.explode(F.array(F.struct(F.lit(0).alias("half"), F.left("text", at).alias("text")), F.struct(F.lit(1).alias("half"), F.substr("text", at + 1).alias("text")))).alias("h"))
        again = usable(encoder(halves.select(F.struct("id", "h.half").alias("id"), "h.text")))
        side = lambda n: F.first(F.when(F.col("id.half") == n, F.col("vector")), ignorenulls=True)  # noqa: E731  two rows of each id
        mended = again.groupBy(F.col("id.id").alias("id")).agg(mean_of_halves(side(0), side(1)).alias("mended"))
        return first.join(mended, "id", "left").select("id", F.coalesce("vector", "mended").alias("vector"))

    return encode


def mean_of_halves(left: Column, right: Column) -> Column:
    """AGG-19: the vector of a text whose halves were encoded apart; null if either is."""
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def split_point(text: Column, least: int = 40) -> Column:
    """2.11.11: the last space before the middle, not before ``least``; the middle without one."""
    middle = F.floor(F.length(text) / 2).cast("int")
    head = F.left(text, middle)
    at = F.when(F.instr(head, " ") > 0, middle - F.instr(F.reverse(head), " ") + 1).otherwise(0)
    return F.when(at > least, at).otherwise(middle)


def overlap_scorer(query: Column, passage: Column) -> Column:
    """UDF-4's default: the share of the query's tokens that the passage has."""
    wanted, held = F.array_distinct(tx.tokens(query)), F.array_distinct(tx.tokens(tx.passage(passage)))
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, held)) / F.size(wanted)).otherwise(F.lit(0.0))


def extractive_answer(context: Column, question: Column) -> Column:
    """UDF-5's default: the first passage line."""
    return F.element_at(F.split(context, "\n"), 1)


def expanded(questions: DataFrame, generate: Column | None = None, n: int = 3) -> DataFrame:
    """UDF-6: (qid, variant, question): the question as variant 0, then up to ``n`` usable lines of what ``generate`` (a column of text over question) wrote; a failed or missing generation (null) leaves the question alone."""
    lines = F.split(F.coalesce(generate if generate is not None else F.lit(None).cast("string"), F.lit("")), "\n")
    every = F.concat(F.array("question"), tx.query_variants(F.col("question"), lines, n))
    return questions.select("qid", F.posexplode(every).alias("variant", "question"))


class Lazy:
    """UDF-10: a model that a worker loads at its first use, once. A failed load disables it for the worker's life, as do ``strikes``
    failed calls one after another (UDF-8): calls then give None, as a failed call does.

    ``tell`` (see ``plans.progress.ModelRegistry``) has the driver hear of loading, ready, disabled and every failure. Without
    ``strikes`` a failed call raises.
    """

    status: dict[str, str] = {}

    def __init__(self, name: str, load: Callable[[], Callable], tell: Callable[..., None] | None = None, strikes: int | None = None) -> None:
        self.name, self.load, self.tell, self.strikes = name, load, tell, strikes

    def _set(self, status: str, failures: int = 0, message: str | None = None) -> None:
        self.status[self.name] = status
        if self.tell:
            self.tell(self.name, status, failures, message)

    def _model(self) -> Callable | None:
        if self.status.get(self.name) == "disabled":
            return None
        if self.name not in _LOADED:
            self._set("loading")
            try:
                _LOADED[self.name] = self.load()
                self._set("ready")
            except Exception as e:  # noqa: BLE001  what can't be loaded is left out, not fatal
                self._set("disabled", 1, f"{type(e).__name__}: {e}"[:300])
                return None
        return _LOADED[self.name]

    def __call__(self, *args):
        model = self._model()
        if model is None:
            return None
        try:
            got = model(*args)
        except Exception as e:
            if self.strikes is None:
                raise
            _STRIKES[self.name] = _STRIKES.get(self.name, 0) + 1
            self._set("disabled" if _STRIKES[self.name] >= self.strikes else "ready", 1, f"{type(e).__name__}: {e}"[:300])
            return None
        _STRIKES[self.name] = 0
        return got


#: Fixed value: failed captions in a row that disable the captioner.
STRIKES = 5
_STRIKES: dict[str, int] = {}
_LOADED: dict[str, Callable] = {}


def batched_scorer(model: Lazy) -> Scorer:
    """UDF-4: a scorer that calls ``model(list of queries, list of passages) -> list of scores`` once a batch; all null where the model is disabled, so that ``rerank`` keeps the order."""

    @F.pandas_udf("double")
    def score(query: pd.Series, passage: pd.Series) -> pd.Series:
        got = model(query.tolist(), passage.tolist())
        return pd.Series([None] * len(query) if got is None else got, dtype="float64")

    return lambda query, text: score(query, tx.passage(text))

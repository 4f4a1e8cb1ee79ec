"""Operators with state of their own and timers: the debounce that fires without a later event, and the filter of thinking tokens
over micro-batches (STR-2, STR-3, STR-5, SCL-34). They need the RocksDB state store (``keep_state_in_rocksdb``)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import channel_step

#: Fixed value: seconds without an event after which a burst ends.
GAP_SECONDS = 10
#: Seconds without a token after which an answer counts as broken off.
IDLE_SECONDS = 60


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """The state store that these operators need, for queries started from now on in this session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Timer:
    """One timer of a key: setting it anew takes the last one back."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.due = handle, handle.getValueState("due", "at long")

    def set(self, at: int) -> None:
        self.clear()
        self.handle.registerTimer(at)
        self.due.update((at,))

    def clear(self) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()


class _Bursts(StatefulProcessor):
    """State of a key: when its open burst began, its last event and how many events it has; times are microseconds."""

    def __init__(self, gap: float) -> None:
        self.gap = int(gap * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open, self.timer = handle.getValueState("open", "started long, last long, n long"), _Timer(handle)

    def _ended(self, key: tuple, burst: tuple) -> Row:
        started, last, n = burst
        return Row(key=key[0], started=started, fires=last + self.gap, n_events=n, last_ts=last)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        burst = tuple(self.open.get()) if self.open.exists() else None
        for at in sorted(r["at"] for r in rows):
            if burst and at - burst[1] > self.gap:
                yield self._ended(key, burst)
                burst = None
            burst = (min(burst[0], at), max(burst[1], at), burst[2] + 1) if burst else (at, at, 1)
        self.open.update(burst)
        self.timer.set(timerValues.getCurrentProcessingTimeInMs() + self.gap // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists():
            yield self._ended(key, tuple(self.open.get()))
        self.open.clear()
        self.timer.due.clear()

    def close(self) -> None:
        pass


def debounce_timed(events: DataFrame, key: str, ts: str = "ts", gap: float = GAP_SECONDS) -> DataFrame:
    """STR-2 on a stream: the rows of ``events.debounce``, each as soon as it is known: when an event comes more than ``gap`` seconds
    after the last one, or, by a timer in processing time, when none has come for ``gap`` seconds. Events of a micro-batch are put
    in order; one that comes late joins the open burst. Events without a time are left out."""
    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at")).filter("at IS NOT NULL")
    schema = f"key {events.schema[key].dataType.simpleString()}, started long, fires long, n_events long, last_ts long"
    ended = rows.groupBy("key").transformWithState(_Bursts(gap), schema, "Append", "processingTime")
    time = lambda name: F.timestamp_micros(name).alias(name)
    return ended.select(F.col("key").alias(key), time("started"), time("fires"), "n_events", time("last_ts"))


class _Channels(StatefulProcessor):
    """State of an answer: the text held back because it may begin a tag, whether it is inside of one, and pieces so far."""

    def __init__(self, idle: float) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail, self.timer = handle.getValueState("tail", "held string, inside boolean, n int"), _Timer(handle)

    def _flushed(self, key: tuple, held: str, inside: bool, n: int) -> Iterator[Row]:
        if held:
            yield Row(answer_id=key[0], seq=n, kind="thinking" if inside else "token", text=held)
        self.tail.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, inside, n = tuple(self.tail.get()) if self.tail.exists() else ("", False, 0)
        ended = False
        for row in sorted(rows, key=lambda r: r["seq"]):
            pieces, held, inside = channel_step(held, inside, row["token"] or "")
            for kind, text in pieces:
                yield Row(answer_id=key[0], seq=n, kind=kind, text=text)
                n += 1
            ended |= bool(row["done"])
        if ended:
            yield from self._flushed(key, held, inside, n)
            self.timer.clear()
        else:
            self.tail.update((held, inside, n))
            self.timer.set(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.tail.exists():
            yield from self._flushed(key, *self.tail.get())
        self.timer.due.clear()

    def close(self) -> None:
        pass


def token_channels_stream(tokens: DataFrame, key: str = "answer_id", seq: str = "seq", token: str = "token", done: str = "done", idle: float = IDLE_SECONDS) -> DataFrame:
    """STR-5 on a stream: (answer_id, seq, kind, text) pieces as soon as they are settled. What may be the beginning of a tag is held
    back as state from one micro-batch to the next; the row with ``done`` ends the answer and gives up what is held. An answer
    that breaks off is ended after ``idle`` seconds. Tokens come in order; those of a micro-batch are put in order."""
    rows = tokens.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.col(token).alias("token"), F.coalesce(F.col(done), F.lit(False)).alias("done"))
    schema = f"answer_id {tokens.schema[key].dataType.simpleString()}, seq int, kind string, text string"
    return rows.groupBy("key").transformWithState(_Channels(idle), schema, "Append", "processingTime")

"""PIPE-1's on_progress, STR-4, STR-6, UDF-10's registry: what running tasks tell the driver, by accumulators.

A task's additions reach the driver when it ends; those of a task that is run again are added again, so counts are cut to
their total, and the last event of a phase has the exact count, which the phase's own result gives.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark import AccumulatorParam
from pyspark.sql import SparkSession

from ..streaming.events import apply_event, empty_snapshot

Event = dict[str, object]


class Progress:
    """The events of one source's ingest, given to ``on_progress`` as they come, and the snapshot that they leave.

    ``with progress.phase(kind, total) as seen:`` reports ``seen`` (to be called on workers, once an item) every ``every`` seconds
    while the block runs, if it grew, and ``total`` when it ends well. ``done`` or ``error`` ends the events.
    """

    def __init__(self, spark: SparkSession, source_id: str, on_progress: Callable[[str, Event], None] | None = None, every: float = 0.5) -> None:
        self.spark, self.source_id, self.every, self.told = spark, source_id, every, on_progress
        self.snapshot: Event = empty_snapshot()
        self.lock = threading.Lock()

    def event(self, kind: str, current: int = 0, total: int = 0, message: str | None = None) -> None:
        made = {"type": kind, "current": current, "total": total, "message": message}
        with self.lock:
            self.snapshot = apply_event(self.snapshot, made)
            if self.told:
                self.told(self.source_id, made)

    def phase(self, kind: str, total: int) -> _Phase:
        return _Phase(self, kind, total)


class _Phase:
    def __init__(self, progress: Progress, kind: str, total: int) -> None:
        self.progress, self.kind, self.total = progress, kind, total
        self.count = progress.spark.sparkContext.accumulator(0)
        self.over, self.last = threading.Event(), -1
        self.thread = threading.Thread(target=self._watch, daemon=True)

    def __enter__(self) -> Callable[[], None]:
        self._report(0)
        self.thread.start()
        count = self.count
        return lambda: count.add(1)

    def __exit__(self, kind, error, trace) -> None:
        self.over.set()
        self.thread.join()
        if error is None:
            self._report(self.total)

    def _watch(self) -> None:
        while not self.over.wait(self.progress.every):
            self._report(min(self.count.value, self.total))

    def _report(self, n: int) -> None:
        if n > self.last:
            self.last = n
            self.progress.event(self.kind, n, self.total)


#: How far a model got; of two workers' statuses the later one in this order is the registry's.
STATUSES = ("pending", "loading", "ready", "disabled")


class _Merged(AccumulatorParam):
    """Statuses by model (status, failures, message): the furthest status, the failures' sum, the latest message."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, value1: dict, value2: dict) -> dict:  # noqa: N802  Spark's name
        for name, (status, failures, message) in value2.items():
            held = value1.get(name, ("pending", 0, None))
            value1[name] = (max(held[0], status, key=STATUSES.index), held[1] + failures, message or held[2])
        return value1


class ModelRegistry:
    """UDF-10: the status of every model over all workers, as far as their tasks have ended: {name: (status, failures, message)}.

    ``tell`` is given to ``encoders.Lazy``. A model that any worker disabled counts as disabled.
    """

    def __init__(self, spark: SparkSession, *names: str) -> None:
        self._merged = spark.sparkContext.accumulator({}, _Merged())
        self.names = names

    @property
    def tell(self) -> Callable[[str, str, int, str | None], None]:
        merged = self._merged
        return lambda name, status, failures=0, message=None: merged.add({name: (status, failures, message)})

    def statuses(self) -> dict[str, tuple[str, int, str | None]]:
        return {n: ("pending", 0, None) for n in self.names} | dict(self._merged.value)

"""STR-3, STR-7, STR-10: one ingest of a source at a time, which can be paused, resumed and cancelled between groups of files."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: files between two looks at the switches.
GROUP = 15


class Busy(RuntimeError):
    """The source is being ingested already."""


class IngestControl:
    """The switches of one application's ingests, by source."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.lock = spark, threading.Lock()
        self.open: dict[str, threading.Event] = {}  # set: goes on; cleared: paused
        self.cancelled: set[str] = set()

    def _tag(self, source_id: str) -> str:
        return f"ingest-{source_id}"

    def running(self, source_id: str) -> bool:
        return source_id in self.open

    def pause(self, source_id: str) -> bool:
        """False, and nothing happens, if the source isn't being ingested; so for the others."""
        with self.lock:
            if live := source_id in self.open:
                self.open[source_id].clear()
        return live

    def resume(self, source_id: str) -> bool:
        with self.lock:
            if live := source_id in self.open:
                self.open[source_id].set()
        return live

    def cancel(self, source_id: str) -> bool:
        """Spark's jobs of the source end now, and no further group begins."""
        with self.lock:
            if live := source_id in self.open:
                self.cancelled.add(source_id)
                self.open[source_id].set()
        if live:
            self.spark.interruptTag(self._tag(source_id))
        return live

    def run(self, source_id: str, items: Iterable, action: Callable[[list], None], group: int = GROUP) -> str:
        """Runs ``action`` on groups of ``items``: "done" or "cancelled". A second run of a live source is refused."""
        with self.lock:
            if source_id in self.open:
                raise Busy(source_id)
            self.open[source_id] = threading.Event()
            self.open[source_id].set()
        self.spark.addTag(self._tag(source_id))
        try:
            for part in _groups(items, group):
                self.open[source_id].wait()
                if source_id in self.cancelled:
                    return "cancelled"
                try:
                    action(part)
                except Exception:
                    if source_id in self.cancelled:  # its jobs were interrupted
                        return "cancelled"
                    raise
            return "cancelled" if source_id in self.cancelled else "done"
        finally:
            self.spark.removeTag(self._tag(source_id))
            with self.lock:
                del self.open[source_id]
                self.cancelled.discard(source_id)


def _groups(items: Iterable, size: int) -> Iterator[list]:
    rest = iter(items)
    while part := list(islice(rest, size)):
        yield part


def reingest(ingest: Callable[[str], None], key: str = "source_id") -> Callable[[DataFrame, int], None]:
    """STR-3: what ``on_burst`` calls for each batch of bursts: a full ingest of every source in it, one after another; a failure is logged only."""

    def action(bursts: DataFrame, _: int) -> None:
        for row in bursts.select(key).distinct().orderBy(key).toLocalIterator():
            try:
                ingest(row[key])
            except Exception:  # noqa: BLE001  the stream goes on
                logging.getLogger(__name__).exception("ingest of %s", row[key])

    return action

"""SRC-28, STR-1: a streaming source of what happens to the files of a folder: created, modified, deleted, moved.

An offset is the number of a snapshot, a listing of the folder below the option ``state`` (on storage that outlives the query).
Between two snapshots, files are told by path; a path that is gone and one that is new with the same inode are a move. Each
snapshot is written before its offset is planned and deleted when a later one is committed, so that a restarted query sees every
change once, also those that happened while it was down. Like every file source, the listing is made on the driver; the
changes are dealt over tasks.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.scan import walk_all

SCHEMA = "event_type string, src_path string, dest_path string, is_directory boolean, ts timestamp"
#: Changes of a task.
TASK_CHANGES = 10_000


def snapshot(root: str) -> dict[str, list]:
    """path -> [device and inode, time, size, folder or not] of everything visible below ``root``."""
    return {path: [f"{s.st_dev}:{s.st_ino}", s.st_mtime_ns, s.st_size, folder] for path, s, folder in walk_all(root)}


def difference(old: dict[str, list], new: dict[str, list]) -> list[tuple[str, str, str | None, bool]]:
    """(event_type, src_path, dest_path, is_directory) of the changes that make ``new`` of ``old``, in order of paths."""
    gone = {path: x for path, x in old.items() if path not in new}
    came = {path: x for path, x in new.items() if path not in old}
    places: dict[str, list[str]] = {}
    for path in sorted(gone):
        places.setdefault(gone[path][0], []).append(path)
    out = []
    for path in sorted(came):
        inode, _, size, folder = came[path]
        from_ = next((p for p in places.get(inode, ()) if gone[p][3] == folder and (folder or gone[p][2] == size)), None)  # an inode may be used again
        if from_ is None:
            out.append(("created", path, None, folder))
        else:
            places[inode].remove(from_)
            out.append(("moved", from_, path, folder))
            del gone[from_]
    out += [("deleted", path, None, x[3]) for path, x in gone.items()]
    out += [("modified", path, None, False) for path, x in new.items() if path in old and not x[3] and x[:3] != old[path][:3]]
    return sorted(out, key=lambda x: (x[2] or x[1], x[0]))


class _Changes(InputPartition):
    def __init__(self, rows: list[tuple], at: float) -> None:
        self.rows, self.at = rows, at


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root, self.state, self.first = options["path"], options["state"], None
        os.makedirs(self.state, exist_ok=True)

    def _file(self, number: int) -> str:
        return os.path.join(self.state, f"{number}.json")

    def _load(self, number: int) -> dict:
        with open(self._file(number), encoding="utf-8") as f:
            return json.load(f)

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in os.listdir(self.state) if n.endswith(".json"))

    def _save(self, number: int, files: dict) -> None:
        with open(self._file(number) + ".part", "w", encoding="utf-8") as f:
            json.dump({"at": datetime.now(timezone.utc).timestamp(), "files": files}, f)
        os.replace(f.name, self._file(number))

    def _begun(self) -> int:
        """The first snapshot of this reader: what is there when the query first begins is no change."""
        if self.first is None:
            self.first = (self._numbers() or [-1])[-1] + 1
            self._save(self.first, snapshot(self.root))
        return self.first

    def initialOffset(self) -> dict:
        return {"snapshot": self._begun()}

    def latestOffset(self, *_) -> dict:
        number, files = (self._numbers() or [self._begun()])[-1], snapshot(self.root)
        if files != self._load(number)["files"]:
            number += 1
            self._save(number, files)
        return {"snapshot": number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        new = self._load(end["snapshot"])
        rows = difference(self._load(start["snapshot"])["files"], new["files"])
        return [_Changes(rows[i : i + TASK_CHANGES], new["at"]) for i in range(0, len(rows), TASK_CHANGES)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at = datetime.fromtimestamp(partition.at, timezone.utc)
        for kind, path, to, folder in partition.rows:
            yield kind, path, to, folder, at

    def commit(self, end: dict) -> None:
        for number in self._numbers():
            if number < end["snapshot"]:
                os.remove(self._file(number))

    def stop(self) -> None:
        pass


class FolderChanges(DataSource):
    """Options: ``path``, the folder; ``state``, a folder outside of it for the snapshots of one query."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def folder_changes(spark: SparkSession, path: str, state: str) -> DataFrame:
    """A stream of (event_type, src_path, dest_path, is_directory, ts), for ``events.changes`` once a source_id is added."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").option("path", path).option("state", state).load()

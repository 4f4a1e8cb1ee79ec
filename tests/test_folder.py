"""The folder's change source and the scan on executors."""

import os
import time

import pytest

from lodestar.plans.control import IngestControl
from lodestar.sources import scan
from lodestar.streaming import events, folder


def put(root, path, text="x"):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    return full


def test_changes_between_two_listings(tmp_path):
    root = f"{tmp_path}/r"
    keep, edit, gone, move = (put(root, f"d/{n}.txt", n) for n in ("keep", "edit", "gone", "move"))
    put(root, ".git/config")
    old = folder.snapshot(root)
    time.sleep(0.02)
    put(root, "d/edit.txt", "longer than before")
    os.remove(gone)
    os.rename(move, f"{root}/d/moved.txt")
    new = put(root, "d/e/new.txt")
    put(root, "node_modules/x.js")
    got = folder.difference(old, folder.snapshot(root))
    assert got == sorted([("created", f"{root}/d/e", None, True), ("created", new, None, False), ("modified", edit, None, False), ("deleted", gone, None, False), ("moved", move, f"{root}/d/moved.txt", False)], key=lambda x: (x[2] or x[1], x[0]))
    assert keep not in str(got) and folder.difference(old, old) == []
    reused = folder.difference({"a": ["1:1", 1, 1, False]}, {"b": ["1:1", 9, 7, False]})
    assert sorted(reused) == [("created", "b", None, False), ("deleted", "a", None, False)]
    assert folder.difference({}, {"a": ["1:1", 1, 1, False]}) == [("created", "a", None, False)]


def test_each_change_appears_once_over_a_restart(spark, tmp_path):
    root = f"{tmp_path}/watched"
    first, moved = put(root, "first.txt", "1"), put(root, "before.md", "22")
    stream = folder.folder_changes(spark, root, f"{tmp_path}/state").select("event_type", "src_path", "dest_path", "is_directory")

    def run(change, n):
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
        out, end = [], time.time() + 60
        try:
            while not query.recentProgress and query.isActive and time.time() < end:
                time.sleep(0.2)
            change()
            while len(out) < n and time.time() < end:
                assert query.exception() is None
                time.sleep(0.3)
                out = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect() if os.path.exists(f"{tmp_path}/out/_spark_metadata") else []
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((r.event_type, os.path.basename(r.src_path), os.path.basename(r.dest_path or "")) for r in out)

    assert run(lambda: put(root, "new.txt", "3"), 1) == [("created", "new.txt", "")]
    put(root, "first.txt", "changed while it was down")
    os.rename(moved, f"{root}/after.md")
    got = run(lambda: os.remove(f"{root}/new.txt"), 4)
    assert got == [("created", "new.txt", ""), ("deleted", "new.txt", ""), ("modified", "first.txt", ""), ("moved", "before.md", "after.md")]
    assert os.path.exists(first) and len(os.listdir(f"{tmp_path}/state")) <= 3
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert {os.path.basename(r.path) for r in events.changes(rows).collect()} == {"new.txt", "first.txt", "after.md"}


def test_scan_on_executors_equals_the_walk(spark, tmp_path):
    root = f"{tmp_path}/r"
    for path, text in {"a.txt": "t", "d/e/f/deep.PDF": "p", "d/_under.md": "m", "d/noext": "plain text", "d/bin": b"\x00\x01" * 50, ".hidden/x.txt": "h", "d/.git/y": "g", "d/Thumbs.db": "z", "d/$x/z.txt": "q", "e/data.zzz": "text too", "é/ü.txt": "u"}.items():
        put(root, path, text)
    os.makedirs(f"{root}/empty")
    rows = scan.scan_tree(spark, root).collect()
    walked = {(p, size, round(m, 3), round(c, 3)) for p, c, m, size in scan.walk(root)}
    assert {(r.path, r.size, round(r.modified_at.timestamp(), 3), round(r.created_at.timestamp(), 3)) for r in rows} == walked and len(rows) == 7
    kinds = {r.name: (r.extension, r.category, r.mime_type) for r in rows}
    assert kinds["noext"] == ("", "text", "text/plain") and kinds["bin"][1] == "other" and kinds["data.zzz"][1] == "text" and kinds["deep.PDF"][:2] == (".pdf", "document")
    assert scan.scan_tree(spark, f"{root}/empty").collect() == [] and scan.scan_tree(spark, f"{tmp_path}/none").collect() == []


def test_content_is_read_only_of_what_can_be_indexed(spark, tmp_path):
    put(tmp_path, "r/a.txt", "hello"), put(tmp_path, "r/b.bin", b"\x00" * 9)
    secret = put(tmp_path, "r/c.iso", b"\x00" * 20_000)
    os.chmod(secret, 0o644)
    got = {r.name: r.content for r in scan.scan_tree(spark, f"{tmp_path}/r", content=True).collect()}
    assert got == {"a.txt": bytearray(b"hello"), "b.bin": None, "c.iso": None}


def test_heads_end_at_the_sniffed_bytes(tmp_path, monkeypatch):
    import pyarrow as pa

    put(tmp_path, "r/long", b"x" * 50_000), put(tmp_path, "r/known.txt", b"y" * 50_000)
    (batch,) = scan._list_folders(iter([pa.RecordBatch.from_pydict({"path": [f"{tmp_path}/r"]})]))
    heads = dict(zip(batch.column("path").to_pylist(), batch.column("head").to_pylist()))
    assert heads == {f"{tmp_path}/r/long": b"x" * scan.SNIFF_BYTES, f"{tmp_path}/r/known.txt": None}


@pytest.mark.parametrize("switch", ["pause", "resume", "cancel"])
def test_switches_of_an_idle_source_do_nothing(spark, switch):
    control, seen = IngestControl(spark), []
    assert getattr(control, switch)("s") is False
    assert control.run("s", range(3), seen.append) == "done" and seen == [[0, 1, 2]]

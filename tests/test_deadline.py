import os
import time

import pytest

from lodestar.plans import pipelines
from lodestar.sources import extract, scan
from lodestar.sources.deadline import Child, Died


def test_calls_results_and_errors():
    with Child(lambda x, y: x // y) as child:
        assert child(7, 2, seconds=20) == 3
        first = child.process.pid
        with pytest.raises(RuntimeError, match="ZeroDivisionError"):
            child(1, 0, seconds=20)
        assert child(9, 3, seconds=20) == 3 and child.process.pid == first  # an error keeps the process
    assert child.process is None


def test_a_hanging_call_is_killed_and_the_next_one_served():
    with Child(lambda s: time.sleep(s) or s) as child:
        assert child(0, seconds=20) == 0
        first, begun = child.process.pid, time.monotonic()
        with pytest.raises(TimeoutError):
            child(60, seconds=0.3)
        assert time.monotonic() - begun < 20
        with pytest.raises(ProcessLookupError):
            os.kill(first, 0)
        assert child(0, seconds=20) == 0


def test_a_dying_process_and_large_results():
    with Child(lambda n: os._exit(3) if n < 0 else b"x" * n) as child:
        with pytest.raises(Died, match="3"):
            child(-1, seconds=20)
        assert len(child(20 << 20, seconds=20)) == 20 << 20


def slow():
    """An extractor that hangs on some files and dies of others, as a closure, which Spark pickles by value."""

    def run(content):
        if content.startswith(b"hang"):
            time.sleep(600)
        if content.startswith(b"die"):
            os._exit(9)
        return content.decode(), [], "slow"

    return run


def test_a_hanging_extractor_is_a_row(spark):
    names = ["good1", "hang", "good2", "die", "good3"]
    rows = spark.createDataFrame([(n, ".slow", "document", bytearray(n.encode())) for n in names] + [("media", ".slow", "audio", bytearray(b"hang")), ("none", ".slow", None, None)], "path string, extension string, category string, content binary").coalesce(1)
    got = {r.path: r for r in extract.extract(rows, extract.EXTRACTORS | {".slow": slow()}, timeouts={"": 1.0, "audio": 2.0}).collect()}
    assert {p: r.text for p, r in got.items()} == {"good1": "good1", "hang": None, "good2": "good2", "die": None, "good3": "good3", "media": None, "none": ""}
    assert got["hang"].error == got["media"].error == "timeout" and got["die"].error == "Died: exit code 9" and got["good3"].error is None


def test_ingest_marks_it_failed(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Salmon swim upstream.")
    (tmp_path / "b.rtf").write_text("hang")
    options = pipelines.Options(timeouts={"": 1.0})
    made, status = pipelines.prepare(scan.scan(spark, str(tmp_path), content=True), str(tmp_path), options, extract.EXTRACTORS | {".rtf": slow()})
    got = {r.path.rpartition("/")[2]: (r.error, r.index_status) for r in status.collect()}
    assert got == {"a.txt": (None, "done"), "b.rtf": ("timeout", "failed")} and made.count() == 1

import time

import pytest
from pyspark.sql import functions as F

from lodestar.operators import encoders
from lodestar.plans import pipelines
from lodestar.plans.progress import ModelRegistry, Progress, _Merged
from lodestar.sources import extract, scan
from lodestar.streaming import events as ev


def write_files(folder, n):
    for i in range(n):
        (folder / f"note{i}.txt").write_text(f"Note {i} about salmon, rivers and glaciers.")
    (folder / "picture.png").write_bytes(b"\x89PNG")


def test_counts_rise_while_files_are_read(spark, tmp_path):
    write_files(tmp_path, 12)

    def slowly(content):
        time.sleep(0.15)
        return content.decode(), [], "text"

    told = []
    progress = Progress(spark, "s1", lambda source, e: told.append((source, e)), every=0.05)
    files = scan.scan(spark, str(tmp_path), content=True).repartition(12, "path")
    made, _ = pipelines.prepare(files, str(tmp_path), pipelines.Options(), extract.EXTRACTORS | {".txt": slowly}, progress)
    assert made.count() == 12 and {s for s, _ in told} == {"s1"}
    counts = [e["current"] for _, e in told if e["type"] == "extracting_progress"]
    assert counts[0] == 0 and counts[-1] == 12 and len(counts) > 3 and counts == sorted(set(counts))
    assert {e["total"] for _, e in told if e["type"] == "extracting_progress"} == {12}
    assert [e["current"] for _, e in told if e["type"] == "embedding_progress"][-1] == 12


def test_an_ingest_leaves_the_folded_snapshot(spark, tmp_path):
    """The events folded as a table are the driver's own snapshot."""
    write_files(tmp_path, 5)
    told = []
    files, chunks = pipelines.ingest(spark, str(tmp_path), "s1", on_progress=lambda source, e: told.append({"source": source, "seq": len(told), **e}))
    assert chunks.count() == 5 and told[0]["type"] == "scanning" and told[-1]["type"] == "done"
    rows = spark.createDataFrame(told, "source string, seq long, type string, current long, total long, message string")
    got = ev.fold_progress(rows, "source", "seq").first().asDict()
    snap = ev.empty_snapshot()
    for e in told:
        snap = ev.apply_event(snap, e)
    assert got == {"key": "s1", **snap}
    assert (got["phase"], got["active"], got["scan_total"], got["extract_current"], got["embed_current"], got["index_current"]) == ("done", False, 6, 5, 5, 5)
    plain = pipelines.ingest(spark, str(tmp_path), "s1")
    assert sorted(r.chunk_id for r in plain[1].collect()) == sorted(r.chunk_id for r in chunks.collect()) and plain[0].count() == files.count() == 6


def test_an_empty_folder_and_a_failure(spark, tmp_path):
    told = []
    pipelines.ingest(spark, str(tmp_path), "s1", on_progress=lambda _, e: told.append(e["type"]))
    assert told[0] == "scanning" and told[-1] == "done"

    def broken(rows):
        raise RuntimeError("no encoder")

    write_files(tmp_path, 1)
    failed = []
    with pytest.raises(RuntimeError):
        pipelines.ingest(spark, str(tmp_path), "s1", options=pipelines.Options(encoder=broken), on_progress=lambda _, e: failed.append(e))
    assert failed[-1]["type"] == "error" and failed[-1]["message"] == "RuntimeError: no encoder"


def lengths(model):
    @F.pandas_udf("long")
    def f(x):
        got = x.map(lambda v: model(v))
        return got.astype("Int64")

    return f


def test_the_driver_hears_of_a_failing_load(spark):
    registry = ModelRegistry(spark, "reader-a", "reader-b", "reader-c")

    def missing():
        raise OSError("no weights")

    good, bad = encoders.Lazy("reader-a", lambda: len, registry.tell), encoders.Lazy("reader-b", missing, registry.tell)
    assert registry.statuses() == dict.fromkeys(["reader-a", "reader-b", "reader-c"], ("pending", 0, None))
    rows = spark.createDataFrame([("one",), ("three",)], "text string").coalesce(1)
    assert [tuple(r) for r in rows.select(lengths(good)("text").alias("a"), lengths(bad)("text").alias("b")).collect()] == [(3, None), (5, None)]
    got = registry.statuses()
    assert got["reader-a"] == ("ready", 0, None) and got["reader-c"][0] == "pending"
    assert got["reader-b"][0] == "disabled" and got["reader-b"][2] == "OSError: no weights"


def test_five_strikes_disable(spark):
    registry = ModelRegistry(spark, "captions")

    def load():
        calls = []

        def model(text):
            calls.append(text)
            if text == "bad":
                raise ValueError("out of memory")
            return len(calls)

        return model

    model = encoders.Lazy("captions", load, registry.tell, strikes=encoders.STRIKES)
    texts = ["bad"] * 4 + ["fine"] + ["bad"] * 5 + ["fine"] * 3  # four failures are forgiven, five in a row aren't
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = [r.n for r in rows.select(lengths(model)("text").alias("n")).collect()]
    assert got == [None] * 4 + [5] + [None] * 8
    assert registry.statuses() == {"captions": ("disabled", 9, "ValueError: out of memory")}


def test_merged_statuses():
    m = _Merged()
    held = m.addInPlace(m.zero({}), {"a": ("ready", 1, "x"), "b": ("loading", 0, None)})
    assert m.addInPlace(held, {"a": ("loading", 2, None), "b": ("ready", 0, None)}) == {"a": ("ready", 3, "x"), "b": ("ready", 0, None)}


def test_an_empty_caption_is_asked_for_again():
    run = extract.media_extractor("image", caption=lambda c: "", caption_again=lambda c: "a lighthouse")
    assert run(b"picture")[0] == "Descripcion: a lighthouse"
    run = extract.media_extractor("image", caption=lambda c: "first", caption_again=lambda c: 1 / 0)
    assert run(b"picture")[0] == "Descripcion: first"

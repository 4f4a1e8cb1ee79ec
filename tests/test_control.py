import threading

import pytest
from pyspark.sql import functions as F

from lodestar.operators import encoders
from lodestar.operators import catalog as ct
from lodestar.operators import retrieval as rt
from lodestar.plans import control, pipelines
from lodestar.sources import extract


def test_groups_pause_resume_and_single_flight(spark):
    switches, seen, at = control.IngestControl(spark), [], threading.Event()

    def action(part):
        seen.append(len(part))
        if len(seen) == 1:
            switches.pause("s")
            at.set()

    result = []
    thread = threading.Thread(target=lambda: result.append(switches.run("s", range(40), action)))
    thread.start()
    at.wait()
    with pytest.raises(control.Busy):
        switches.run("s", [1], action)
    thread.join(0.3)
    assert seen == [15] and thread.is_alive() and switches.running("s")
    switches.resume("s")
    thread.join()
    assert seen == [15, 15, 10] and result == ["done"] and not switches.running("s")


def test_cancel_ends_between_groups(spark):
    switches, seen = control.IngestControl(spark), []

    def action(part):
        seen.append(part)
        switches.cancel("s")

    assert switches.run("s", range(40), action) == "cancelled" and len(seen) == 1
    assert switches.run("s", range(3), seen.append) == "done"  # a new run begins afresh


def test_bursts_ingest_their_sources_and_go_on_after_a_failure(spark):
    done = []

    def ingest(source):
        done.append(source)
        if source == "a":
            raise ValueError("no")

    control.reingest(ingest)(spark.createDataFrame([("b",), ("a",), ("b",)], "source_id string"), 0)
    assert done == ["a", "b"]


def test_recovery_encodes_halves(spark):
    calls = []

    def encoder(rows):
        calls.append(1)
        length = F.length("text").cast("float")
        return rows.select("id", F.when(F.contains("text", F.lit("null")), None).when(length > 100, F.array(F.lit(float("nan")).cast("float"), length)).otherwise(F.array(length, F.lit(1.0).cast("float"))).alias("vector"))

    rows = spark.createDataFrame([(1, "short"), (2, "word " * 30), (3, "null " * 30), (4, "x" * 300)], "id long, text string")
    got = {r.id: r.vector for r in encoders.with_recovery(encoder)(rows).collect()}
    assert got == {1: [5.0, 1.0], 2: [75.0, 1.0], 3: None, 4: None} and len(calls) == 2


def test_expander_lazy_models_and_rerank_fallback(spark):
    questions = spark.createDataFrame([(1, "where do salmon swim?")], "qid long, question string")
    assert [r.question for r in encoders.expanded(questions).collect()] == ["where do salmon swim?"]
    loads = []

    def broken():
        loads.append(1)
        raise OSError("no model")

    model = encoders.Lazy("broken", broken)
    assert model([1]) is None and model([1]) is None and loads == [1] and model.status["broken"] == "disabled"
    assert encoders.Lazy("fine", lambda: lambda x: x + 1)(1) == 2
    hits = spark.createDataFrame([("q", 1, 0.9, 1, 5.0), ("q", 2, 0.1, 2, None), ("r", 1, 0.2, 1, 1.0), ("r", 2, 0.1, 2, 9.0)], "qid string, id long, score double, rank long, new double")
    got = {(r.qid, r.id): (r.score, r.rank) for r in rt.rerank(hits, F.col("new")).collect()}
    assert got == {("q", 1): (0.9, 1), ("q", 2): (0.1, 2), ("r", 2): (9.0, 1)}  # q's scorer failed: no cut, as it was


def test_add_source_and_ensure_table(spark, tmp_path):
    sources = spark.createDataFrame([("a", "/old")], "source_id string, path string")
    new = spark.createDataFrame([("b", str(tmp_path))], "source_id string, path string")
    assert ct.add_source(sources, new).count() == 2
    with pytest.raises(FileNotFoundError):
        ct.add_source(sources, spark.createDataFrame([("b", f"{tmp_path}/none")], "source_id string, path string"))
    with pytest.raises(ValueError):
        ct.add_source(new, new)
    columns = "chunk_id string, dense array<float>, source_id string"
    assert ct.ensure_table(spark, "chunks_made", "chunk_id string, source_id string")
    assert ct.ensure_table(spark, "chunks_made", columns) and not ct.ensure_table(spark, "chunks_made", columns)
    assert "dense" in spark.table("chunks_made").columns
    spark.sql("DROP TABLE chunks_made")


def pdf_file(flate=False):
    """Two pages; the second in a font whose codes a ToUnicode map explains."""
    import zlib

    def stream(body, extra=b""):
        data = zlib.compress(body) if flate else body
        return b"<<" + extra + (b"/Filter /FlateDecode " if flate else b"") + b"/Length %d>>\nstream\n" % len(data) + data + b"\nendstream"

    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0048> <0002> <00E9> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    objects = [
        b"<</Type /Catalog /Pages 2 0 R>>", b"<</Type /Pages /Kids [3 0 R 4 0 R] /Count 2>>", b"<</Type /Page /Parent 2 0 R /Contents 5 0 R /Resources <</Font <</F1 7 0 R>>>>>>",
        b"<</Type /Page /Parent 2 0 R /Contents [6 0 R] /Resources <</Font <</F2 8 0 R>>>>>>", stream(rb"BT /F1 12 Tf 72 720 Td (First \(page\)) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ ET"),
        stream(b"BT /F2 12 Tf 72 720 Td <00010002001000110012> Tj ET"), b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica>>", b"<</Type /Font /Subtype /Type0 /ToUnicode 9 0 R>>", stream(cmap),
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer <</Root 1 0 R>>\n%%EOF"


@pytest.mark.parametrize("flate", [False, True])
def test_pdf_text_and_page_map(spark, flate):
    files = spark.createDataFrame([("a.pdf", ".pdf", bytearray(pdf_file(flate))), ("b.pdf", ".pdf", bytearray(b"%PDF /Encrypt"))], "path string, extension string, content binary")
    got = {r.path: r for r in extract.extract(files).collect()}
    assert got["a.pdf"].text == "First (page)\nsecond line" + "Héabc" and [tuple(p) for p in got["a.pdf"].page_map] == [(1, 0), (2, 24)] and got["a.pdf"].extractor == "pdf"
    assert got["b.pdf"].error == "ValueError: encrypted"


def test_media_extractors_and_metadata(spark):
    import io
    import struct
    import wave

    fails = lambda _: 1 / 0
    assert extract.media_extractor("image", caption=lambda _: "a dog", read=lambda _: " STOP ")(b"")[0] == "Descripcion: a dog\n\nTexto en la imagen: STOP"
    assert extract.media_extractor("image", caption=fails, read=lambda _: "x")(b"")[0] == "Texto en la imagen: x"
    assert extract.media_extractor("audio", transcribe=lambda _: [" one", "", "two"])(b"")[0] == "one two"
    video = extract.media_extractor("video", transcribe=fails, caption=lambda f: f.decode(), frames=lambda _: [b"a", b"", b"c", b"d"], interval=45, most=3)
    assert video(b"")[0] == "[00:00] a\n[01:30] c"
    assert extract.media_extractor("pdf-ocr", read=lambda p: p.decode(), frames=lambda _: [b"one", b"two"])(b"") == ("onetwo", [(1, 0), (2, 3)], "pdf-ocr")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0\0" * 16000)
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 30, 20) + b"\x08\x02\0\0\0crc_\0\0\0\x09pHYs" + struct.pack(">II", 11811, 11811) + b"\x01crc_"
    rows = [("t", ".txt", "text", b"two words"), ("w", ".wav", "audio", out.getvalue()), ("p", ".png", "image", png), ("d", ".pdf", "document", pdf_file()), ("x", ".docx", "document", b"broken")]
    files = spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in rows], "path string, extension string, category string, content binary")
    got = {r.path: {k: v for k, v in r.metadata.asDict().items() if v is not None} for r in extract.metadata(files).collect()}
    assert got == {"t": {"wordCount": 2, "charCount": 9}, "w": {"duration": 2, "bitrate": 128}, "p": {"width": 30, "height": 20, "ppi": 300.0}, "d": {"wordCount": 4, "charCount": 29}, "x": {}}


def test_pdf_ingest_search_dispatch_and_single_file(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("salmon swim upstream")
    (tmp_path / "paper.pdf").write_bytes(pdf_file(True))
    files, chunks = pipelines.ingest(spark, str(tmp_path), "s1")
    pages = {r.file_name: r.page for r in chunks.collect()}
    assert pages == {"notes.txt": None, "paper.pdf": 1} and {r.index_status for r in files.collect()} == {"done"}
    listed = files.withColumn("file_id", F.col("path"))
    assert [r["name"] for r in pipelines.search_files("  ", chunks, listed).collect()] == ["notes.txt", "paper.pdf"]
    assert [r["name"] for r in pipelines.search_files("PAPER", None, listed).collect()] == ["paper.pdf"]
    found = pipelines.search_files("where do salmon swim", chunks, listed).orderBy("place").collect()
    assert found[0]["name"] == "notes.txt"
    (tmp_path / "notes.txt").write_text("trout swim too")
    from lodestar.sources import scan

    again, status = pipelines.index_file(scan.scan(spark, str(tmp_path), content=True), f"{tmp_path}/notes.txt", chunks)
    assert {r.text for r in again.collect()} == {"trout swim too", "First (page)\nsecond lineHéabc"} and status.first().index_status == "done"

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestar.plans import pipelines
from lodestar.sources import extract, scan


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


W = 'xmlns:w="urn:w"'
ODF = 'xmlns:text="urn:text" xmlns:table="urn:table" xmlns:draw="urn:draw" xmlns:p="urn:p"'
FILES = {
    "a.docx": (zipped(word__document_dot_xml=f"<w:document {W}><w:p><w:t>One </w:t><w:t>line</w:t></w:p><w:p><w:t> </w:t></w:p><w:p><w:t>Two</w:t></w:p></w:document>"), "One line\nTwo"),
    "a.pptx": (zipped(ppt__slides__slide2_dot_xml=f"<s {W}><w:p><w:t>second</w:t></w:p></s>", ppt__slides__slide1_dot_xml=f"<s {W}><w:p><w:t>first</w:t></w:p></s>"), "first\nsecond"),
    "a.odt": (zipped(content_dot_xml=f"<o {ODF}><text:p>Hello</text:p><text:p> </text:p><text:p>there</text:p></o>"), "Hello\nthere"),
    "a.ods": (zipped(content_dot_xml=f'<o {ODF}><table:table table:name="S"><table:table-row><table:table-cell><text:p>a</text:p></table:table-cell><table:table-cell/><table:table-cell><text:p>b</text:p></table:table-cell></table:table-row><table:table-row><table:table-cell/></table:table-row></table:table></o>'), "[S]\na\t\tb"),
    "a.odp": (zipped(content_dot_xml=f"<o {ODF}><draw:page><text:p>Title</text:p><p:notes><text:p>remember</text:p></p:notes></draw:page></o>"), "[Diapositiva 1]\nTitle\n[Notas] remember"),
    "a.xlsx": (zipped(xl__workbook_dot_xml=f'<w {W}><w:sheet name="Data"/></w>', xl__sharedStrings_dot_xml=f"<s {W}><w:si><w:t>name</w:t></w:si></s>", xl__worksheets__sheet1_dot_xml=f'<s {W}><w:row><w:c r="A1" t="s"><w:v>0</w:v></w:c><w:c r="C1"><w:v>7</w:v></w:c></w:row></s>'), "[Data]\nname\t\t7"),
    "a.rtf": (rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\pard Caf\'e9 {\b bold}\par next}", "Café bold\nnext"),
    "a.svg": (b"<svg><style>x{}</style><text>Shown <tspan>inner</tspan> tail</text></svg>", "Shown\ninner\ntail"),
    "bad.svg": (b"<svg><script>no</script><text>Broken & shown", "Broken & shown"),
    "a.txt": ("é\xff".encode("latin-1"), "��"),
    "a.ppt": (struct.pack("<HHI", 0, 0x0FA0, 4) + "hi".encode("utf-16-le") + struct.pack("<HHI", 0x0F, 1, 12) + struct.pack("<HHI", 0, 0x0FA8, 4) + b"yes ", "hi\nyes"),
    "a.doc": (b"\x00\x01" * 9 + "recovered text".encode("utf-16-le") + b"\x05\x00", "recovered text"),
    "a.epub": (zipped(**{"META-INF__container_dot_xml": '<c xmlns="urn:c"><rootfile full-path="O/p.opf"/></c>', "O__p_dot_opf": '<p xmlns="urn:o"><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><itemref idref="a"/><itemref idref="b"/></p>', "O__a_dot_xhtml": "<html><head><title>t</title></head><body><p>First</p></body></html>", "O__b_dot_xhtml": "<p>Second</p><script>x</script>"}), "First\n\nSecond"),
}


@pytest.mark.parametrize("name", FILES)
def test_extractors(name):
    content, want = FILES[name]
    text, pages, _ = extract.EXTRACTORS["." + name.rpartition(".")[2]](content)
    assert text == want and pages == []


def test_pages_and_sizes():
    assert extract.join_pages(["ab", "", "c"]) == ("abc", [(1, 0), (2, 2), (3, 2)])
    assert extract.image_size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 3, 4)) == (3, 4)
    assert extract.image_size(b"nothing") is None
    assert extract.html_to_text("<head><title>x</title></head><p>a&amp;b</p><style>y</style> <i> c </i>") == "a&b\nc"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "notes" / "moonBase.md").write_text("The moon base has three domes and a greenhouse. " * 80)
    (tmp_path / "notes" / "rivers.txt").write_text("Rivers carry water to the sea. Salmon swim upstream.")
    (tmp_path / "empty_report.txt").write_text("  ")
    (tmp_path / "blob.bin").write_bytes(b"\x00\x01\x02")
    (tmp_path / "readme").write_text("plain text without an extension about volcanoes")
    (tmp_path / "picture.png").write_bytes(b"\x89PNG")
    (tmp_path / ".git" / "config").write_text("hidden")
    (tmp_path / "thumbs.db").write_text("x")
    return tmp_path


def test_scan_and_classify(spark, folder):
    got = {r.name: (r.category, r.mime_type) for r in scan.scan(spark, str(folder)).collect()}
    assert {n: c for n, (c, _) in got.items()} == {"moonBase.md": "text", "rivers.txt": "text", "empty_report.txt": "text", "blob.bin": "other", "readme": "text", "picture.png": "image"}
    assert got["readme"][1] == "text/plain" and got["picture.png"][1] == "image/png"
    (folder / "_kept.txt").write_text("x")
    assert {r.name for r in scan.listing(spark, str(folder)).collect()} == {*got, "_kept.txt"}


def test_ingest_search_and_incremental(spark, folder, tmp_path_factory):
    store = tmp_path_factory.mktemp("store")
    files, chunks = pipelines.ingest(spark, str(folder), "s1")
    files.write.parquet(f"{store}/files1")
    chunks.write.parquet(f"{store}/chunks1")
    files, chunks = spark.read.parquet(f"{store}/files1"), spark.read.parquet(f"{store}/chunks1")
    status = {r.name: r.index_status for r in files.collect()}
    assert status == {"moonBase.md": "done", "rivers.txt": "done", "empty_report.txt": "done", "readme": "done", "blob.bin": None, "picture.png": None}
    assert chunks.filter(F.col("file_name") == "empty_report.txt").first().text == "empty_report.txt"  # found by its name
    q = spark.createDataFrame([("q1", "Where do salmon swim?"), ("q2", "moon greenhouse domes")], "qid string, question string")
    best = {r.qid: r.file_id.rpartition("/")[2] for r in pipelines.retrieve(q, chunks, 3).filter("rank = 1").collect()}
    assert best == {"q1": "rivers.txt", "q2": "moonBase.md"}
    found = pipelines.search(q, chunks, files.withColumn("file_id", F.col("path")), 1, 2).collect()
    assert {(r.qid, r.name) for r in found if r.place == 1} == {("q1", "rivers.txt"), ("q2", "moonBase.md")}
    cited, answers = pipelines.ask(q, chunks, 2)
    assert cited.count() and all(r.answer.startswith("[1] (chunk_id=") for r in answers.collect())
    assert pipelines.ask(q, chunks, 2, source_id="other")[1].first().answer == pipelines.prompts.NO_HITS
    variants = spark.createDataFrame([("q1", 0, "Where do salmon swim?"), ("q1", 1, "fish rivers sea")], "qid string, variant int, question string")
    assert pipelines.retrieve_multi(variants, chunks, 2).filter("rank = 1").first().file_name == "rivers.txt"
    data = q.withColumn("relevant_ids", F.array(F.concat(F.lit(f"{folder}/notes/"), F.when(F.col("qid") == "q1", "rivers.txt").otherwise("moonBase.md")))).withColumn("latency", F.lit(1.0))
    assert pipelines.score_pipeline(data, chunks, 3).first().mrr == 1.0
    (folder / "readme").unlink()
    (folder / "notes" / "rivers.txt").write_text("Deserts hold little water.")
    (folder / "new.txt").write_text("Glaciers move slowly.")
    files2, chunks2 = pipelines.ingest(spark, str(folder), "s1", files, chunks)
    names = {r.file_name for r in chunks2.select("file_name").distinct().collect()}
    assert names == {"moonBase.md", "rivers.txt", "empty_report.txt", "new.txt"}
    assert "Deserts" in chunks2.filter("file_name = 'rivers.txt'").first().text
    assert {r.name for r in files2.collect()} == {"moonBase.md", "rivers.txt", "empty_report.txt", "new.txt", "blob.bin", "picture.png"}


def test_a_broken_file_is_an_error_row(spark):
    rows = spark.createDataFrame([("a", ".docx", bytearray(b"no zip")), ("b", ".xyz", bytearray(b"\x00")), ("c", ".zzz", bytearray(b"fine"))], "path string, extension string, content binary")
    got = {r.path: r for r in extract.extract(rows).collect()}
    assert got["a"].error.startswith("BadZipFile") and got["b"].error == "unsupported" and got["c"].text == "fine"

import struct

import pytest
from pyspark.sql import functions as F

from lodestar.sources import extract, workbooks


def record(number, body=b""):
    return struct.pack("<HH", number, len(body)) + body


def compound(name, stream):
    """A compound file of one stream: a table sector, a directory sector, then the stream."""
    n = -(-len(stream) // 512)
    assert n < 120
    links = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, n + 2), 0xFFFFFFFE]
    head = bytearray(512)
    head[:8] = bytes.fromhex("D0CF11E0A1B11AE1")
    struct.pack_into("<HHHHH", head, 24, 62, 3, 0xFFFE, 9, 6)
    struct.pack_into("<IIIIIIII", head, 44, 1, 1, 0, 0, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    struct.pack_into("<109I", head, 76, 0, *[0xFFFFFFFF] * 108)

    def entry(name, kind, start, size):
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HB", len(raw), kind) + b"\0" * 49 + struct.pack("<IQ", start, size)

    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry(name, 2, 2, len(stream))
    return bytes(head) + struct.pack("<128I", *links, *[0xFFFFFFFF] * (128 - len(links))) + directory.ljust(512, b"\0") + stream.ljust(512 * n, b"\0")


def short(text):
    wide = any(ord(c) > 255 for c in text)
    return bytes([wide]) + text.encode("utf-16-le" if wide else "latin-1")


def workbook(shared_parts, *sheets):
    """A workbook stream of these parts of shared strings and (name, kind, records) of sheets."""
    shared = record(workbooks.SHARED, shared_parts[0]) + b"".join(record(workbooks.CONTINUE, p) for p in shared_parts[1:])
    begin = record(workbooks.BOF, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    size = len(begin) + len(shared) + 4 + sum(4 + 7 + len(short(n)) for n, _, _ in sheets)
    heads, bodies = b"", b""
    for name, kind, cells in sheets:
        heads += record(workbooks.BOUND_SHEET, struct.pack("<IBBB", size + len(bodies), 0, kind, len(name)) + short(name))
        bodies += record(workbooks.BOF, struct.pack("<HHHHII", 0x600, 16, 0, 0, 0, 0)) + cells + record(workbooks.EOF)
    return begin + heads + shared + record(workbooks.EOF) + bodies


def cell(number, row, column, body):
    return record(number, struct.pack("<HHH", row, column, 0) + body)


STRINGS = [
    # name | wide, cut by a border where it goes on narrow | formatting runs and phonetic data
    struct.pack("<II", 4, 4) + struct.pack("<H", 4) + b"\0name" + struct.pack("<H", 5) + b"\1" + "日本".encode("utf-16-le"),
    b"\0abc" + struct.pack("<HBH", 4, 8, 1) + b"bold" + b"\0" * 4 + struct.pack("<HBI", 3, 4, 5) + b"pho" + b"\0" * 5,
]
CELLS = (
    cell(workbooks.LABEL_SHARED, 0, 0, struct.pack("<I", 0)) + cell(workbooks.LABEL_SHARED, 0, 2, struct.pack("<I", 1)) + cell(workbooks.NUMBER, 1, 0, struct.pack("<d", 7)) + cell(workbooks.NUMBER, 1, 1, struct.pack("<d", 7.25))
    + cell(workbooks.RK, 1, 2, struct.pack("<I", (-5 << 2 & 0xFFFFFFFF) | 2)) + record(workbooks.BOF, struct.pack("<HHHHII", 0x600, 32, 0, 0, 0, 0)) + cell(workbooks.NUMBER, 9, 9, struct.pack("<d", 1)) + record(workbooks.EOF)
    + record(workbooks.MULTIPLE_RK, struct.pack("<HHHIHIH", 2, 1, 0, 1234 << 2 | 3, 0, struct.unpack("<II", struct.pack("<d", 1.5))[1], 2)) + cell(workbooks.BOOL_ERROR, 3, 0, b"\1\0") + cell(workbooks.BOOL_ERROR, 3, 1, b"\x07\1")
    + cell(workbooks.FORMULA, 4, 0, struct.pack("<d", 3) + b"\0" * 8) + cell(workbooks.FORMULA, 4, 1, b"\0" * 6 + b"\xff\xff" + b"\0" * 8) + record(workbooks.STRING, struct.pack("<H", 2) + b"\0ok") + cell(workbooks.LABEL, 4, 2, struct.pack("<H", 3) + b"\0old")
    + cell(workbooks.LABEL_SHARED, 4, 3, struct.pack("<I", 2)) + cell(workbooks.LABEL_SHARED, 4, 4, struct.pack("<I", 3))
)
WANT = "[Año]\nname\t\t日本abc\n7\t7.25\t-5\n\t12.34\t1.5\nTrue\t#DIV/0!\n3\tok\told\tbold\tpho"


def test_every_kind_of_cell():
    stream = workbook(STRINGS, ("Año", 0, CELLS), ("chart", 2, b""), ("empty", 0, b""))
    assert extract.EXTRACTORS[".xls"](compound("Workbook", stream)) == (WANT, [], "xlsx")


def test_strings_over_every_border():
    """Shared strings cut at any byte of their characters read the same."""
    words = ["alpha", "", "Größe", "漢字かな", "x" * 50]
    for cut in range(1, 60):
        parts, part = [], struct.pack("<II", 5, 5)
        for w in words:
            wide = any(ord(c) > 255 for c in w)
            part += struct.pack("<HB", len(w), wide)
            for c in w:
                if len(part) > cut:
                    parts, part = [*parts, part], bytes([wide])
                part += c.encode("utf-16-le" if wide else "latin-1")
        cells = b"".join(cell(workbooks.LABEL_SHARED, i, 0, struct.pack("<I", i)) for i in range(5))
        assert workbooks.sheets(workbook([*parts, part], ("s", 0, cells))) == [("s", [[w] for w in words])]


def test_other_workbooks_are_error_rows(spark):
    good = workbook(STRINGS, ("s", 0, CELLS))
    files = {"old": compound("Workbook", record(workbooks.BOF, struct.pack("<HHHHII", 0x500, 5, 0, 0, 0, 0)) + b"\0" * 99), "locked": compound("Workbook", good[:20] + record(workbooks.FILE_PASS, b"\0\0") + good[20:]), "cut": compound("Workbook", good)[:1100], "none": compound("Other", b"x" * 600), "text": b"no workbook", "empty": b"", "good": compound("Workbook", good)}
    rows = spark.createDataFrame([(k, ".xls", bytearray(v)) for k, v in files.items()], "path string, extension string, content binary")
    got = {r.path: r for r in extract.extract(rows).collect()}
    assert got["good"].text.startswith("[s]\nname") and got["good"].error is None
    assert all(got[k].error and got[k].text is None for k in files if k not in ("good", "cut"))


@pytest.mark.parametrize("texts", [["one", "two words", "drei Wörter hier"], ["日本語", "", "mixed 漢字"]])
def test_equals_the_twin_workbook(spark, texts):
    """The same texts in a .xls and a .xlsx file give the same rows."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    shared = struct.pack("<II", len(texts), len(texts)) + b"".join(struct.pack("<H", len(t)) + short(t) for t in texts)
    old = compound("Workbook", workbook([shared], ("Data", 0, b"".join(cell(workbooks.LABEL_SHARED, i, i % 2, struct.pack("<I", i)) for i in range(len(texts))))))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<w xmlns="urn:w"><sheet name="Data"/></w>')
        z.writestr("xl/sharedStrings.xml", '<s xmlns="urn:w">' + "".join(f"<si><t>{escape(t)}</t></si>" for t in texts) + "</s>")
        z.writestr("xl/worksheets/sheet1.xml", '<s xmlns="urn:w">' + "".join(f'<row><c r="{"AB"[i % 2]}{i + 1}" t="s"><v>{i}</v></c></row>' for i in range(len(texts))) + "</s>")
    rows = spark.createDataFrame([("old", ".xls", bytearray(old)), ("new", ".xlsx", bytearray(out.getvalue()))], "path string, extension string, content binary")
    got = extract.extract(rows).select("text", "extractor", F.col("error")).distinct().collect()
    assert len(got) == 1 and got[0].error is None

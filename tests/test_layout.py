import zlib

import pytest

from lodestar.plans import pipelines
from lodestar.sources import extract, layout, scan


def pdf_file(*pages, flate=False):
    """A PDF of these contents, each with the font /F1."""
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(pages)))
    parts = [b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n", f"2 0 obj <</Type /Pages /Kids [{kids}] /Count {len(pages)}>> endobj\n3 0 obj <</Type /Font /Subtype /Type1 /BaseFont /Helvetica>> endobj\n".encode()]
    for i, page in enumerate(pages):
        body = zlib.compress(page.encode("latin-1")) if flate else page.encode("latin-1")
        parts.append(f"{10 + 2 * i} 0 obj <</Type /Page /Parent 2 0 R /Resources <</Font <</F1 3 0 R>>>> /Contents {11 + 2 * i} 0 R>> endobj\n{11 + 2 * i} 0 obj <</Length {len(body)}{' /Filter /FlateDecode' if flate else ''}>> stream\n".encode() + body + b"\nendstream endobj\n")
    return b"".join(parts)


def put(x, y, text, size=10):
    return f"BT /F1 {size} Tf {x} {y} Td ({text}) Tj ET\n"


def column(x, top, words, name):
    """Lines of 36 characters, 12 points apart."""
    return [(x, top - 12 * i, f"{name} line {i} has words that fill it {w}") for i, w in enumerate(words)]


LEFT, RIGHT = column(50, 680, ["oak", "elm", "ash", "fir"], "left"), column(320, 680, ["sea", "bay", "ria", "fen"], "right")


@pytest.mark.parametrize("flate", [False, True])
def test_two_columns_are_read_one_after_the_other(flate):
    rows = [t for pair in zip(LEFT, RIGHT) for t in pair]  # written line by line across the page
    page = put(50, 720, "A heading over both columns", 20) + "".join(put(*t) for t in rows)
    text, pages, name = layout.layout_extractor()(pdf_file(page, flate=flate))
    want = ["# A heading over both columns", " ".join(t for _, _, t in LEFT), " ".join(t for _, _, t in RIGHT)]
    assert text.split("\n\n") == want and pages == [(1, 0)] and name == "pdf-layout"


def test_paragraphs_that_line_up_over_columns():
    """A blank strip across both columns doesn't make the reading order jump between them."""
    low = [(x, y - 80, t.replace("line", "late line")) for x, y, t in LEFT + RIGHT]
    text = layout.layout_extractor()(pdf_file("".join(put(*t) for t in LEFT + RIGHT + low)))[0]
    order = [text.index(x) for x in ("left line 0", "left line 3", "left late line 0", "left late line 3", "right line 0", "right late line 3")]
    assert order == sorted(order) and len(text.split("\n\n")) == 4


def test_a_table_between_paragraphs():
    cells = [["Name", "Size", "Place"], ["oak", "12 m", "hill"], ["elm|x", "", "shore"], ["fir", "30 m", "ridge"]]
    page = put(50, 700, "Trees were measured in the spring of that year, as the table shows.")
    page += "".join(put(50 + 150 * j, 660 - 14 * i, c) for i, row in enumerate(cells) for j, c in enumerate(row) if c)
    page += put(50, 560, "Later years have other figures, which the next chapter has in full.", 10) + put(50, 590, "Later years", 13)
    text = layout.layout_extractor()(pdf_file(page))[0]
    assert text.split("\n\n") == ["Trees were measured in the spring of that year, as the table shows.", "| Name | Size | Place |\n|---|---|---|\n| oak | 12 m | hill |\n| elm\\|x |  | shore |\n| fir | 30 m | ridge |", "## Later years", "Later years have other figures, which the next chapter has in full."]


def test_matrices_leading_and_gaps():
    """Places by cm, Tm, T* and TD; gaps within arrays; states that q and Q keep."""
    page = "q 2 0 0 2 100 200 cm BT /F1 5 Tf 1 0 0 1 10 20 Tm 6 TL (one) Tj T* (two) Tj ET Q BT /F1 10 Tf 30 40 Td [(a) -300 (b) 20 (c) -3000 (far)] TJ 0 -15 TD (x) Tj T* (y) Tj (z) ' ET"
    got = [(round(r.left), round(r.base), round(r.size), r.text) for r in layout.page_runs(*extract.pdf_pages(pdf_file(page))[0])]
    assert got == [(120, 240, 10, "one"), (120, 228, 10, "two"), (30, 40, 10, "a bc"), (78, 40, 10, "far"), (30, 25, 10, "x"), (30, 10, 10, "y"), (30, -5, 10, "z")]


def test_page_map_gate_and_failures():
    long = "".join(put(50, 700 - 12 * i, f"line {i} of a page that has enough text to count as digital") for i in range(20))
    content = pdf_file(long, long, long)
    text, pages, _ = layout.layout_extractor()(content)
    assert pages == [(1, 0), (2, len(text) // 3), (3, 2 * (len(text) // 3))]
    assert layout.layout_extractor(most_bytes=100)(content) == (*extract.pdf(content), "pdf")
    ocr = extract.media_extractor("pdf-ocr", read=lambda page: page.decode(), frames=lambda c: [b"read", b"twice"])
    assert layout.layout_extractor(ocr)(content)[2] == "pdf-layout"
    want = ("readtwice", [(1, 0), (2, 4)], "pdf-ocr")
    assert layout.layout_extractor(ocr)(b"/Encrypt " + content) == want
    with pytest.raises(ValueError, match="encrypted"):
        layout.layout_extractor()(b"/Encrypt " + content)
    assert layout.layout_extractor(ocr)(pdf_file("", "")) == want  # scanned: no text
    assert layout.layout_extractor()(pdf_file(""))[:2] == ("", [(1, 0)]) and layout.layout_extractor()(b"")[:2] == ("", [])


def test_garbled_text_goes_to_ocr():
    broken = pdf_file("".join(put(50, 700 - 12 * i, r"\001\002\003\004 broken \005\006") for i in range(30)))
    ocr = extract.media_extractor("pdf-ocr", read=lambda page: "seen", frames=lambda c: [b"1"])
    for made in (layout.text_extractor, layout.layout_extractor):
        assert made(ocr)(broken)[::2] == ("seen", "pdf-ocr") and made()(broken)[2] != "pdf-ocr"
    fine = pdf_file(put(50, 700, "A text of its own"))
    assert layout.text_extractor(ocr)(fine) == ("A text of its own", [(1, 0)], "pdf")


def test_ingest_with_layout(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf_file("".join(put(*t) for pair in zip(LEFT, RIGHT) for t in pair)))
    options = pipelines.Options(registry=extract.EXTRACTORS | {".pdf": layout.layout_extractor()}, timeouts=extract.LAYOUT_TIMEOUTS)
    made, status = pipelines.prepare(scan.scan(spark, str(tmp_path), content=True), str(tmp_path), options)
    row = made.first()
    assert " ".join(t for _, _, t in LEFT) in row.text and row.page == 1 and status.first().extractor == "pdf-layout"

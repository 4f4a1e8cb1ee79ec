"""SRC-6..25, UDF-1: text of files by format, with the standard library only.

An extractor takes the file's bytes and returns (text, [(page, start)], name). Formats that need models (images, audio, video,
PDF pages without a text layer) are seams: ``media_extractor`` makes one of models, or register an extractor for their
extensions. A failure is a row's error, never the task's.
"""

from __future__ import annotations

import contextlib
import io
import re
import struct
import wave
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import deadline, media, workbooks

Extracted = tuple[str, list[tuple[int, int]], str]
Extractor = Callable[[bytes], Extracted]
EXTRACTORS: dict[str, Extractor] = {}
#: SCL-31's fixed values: seconds that reading a file may take, by category; "" for all others.
TIMEOUTS = {"audio": 600.0, "image": 900.0, "video": 1800.0, "": 45.0}
LAYOUT_TIMEOUTS = TIMEOUTS | {".pdf": 1800.0}
RESULT = "text string, page_map array<struct<page: int, start: int>>, extractor string, error string"


def extractor(name: str, *extensions: str):
    """Registers ``f(bytes) -> text or (text, page_map)`` for the extensions."""

    def register(f):
        def run(content: bytes) -> Extracted:
            got = f(content)
            return (*got, name) if isinstance(got, tuple) else (got, [], name)

        for e in extensions:
            EXTRACTORS[f".{e}"] = run
        return f

    return register


@extractor("text", *"txt md markdown html htm css js mjs cjs ts tsx jsx json jsonl xml yaml yml toml ini cfg conf env sh bat ps1 sql csv tsv log py java go rs c cpp h hpp cs php rb swift kt r m tex rst".split())
def plain(content: bytes) -> str:
    """SRC-7: UTF-8, bad bytes replaced."""
    return content.decode("utf-8", "replace")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def _paragraphs(root: ElementTree.Element, tag: str, text_tag: str) -> Iterator[str]:
    for p in root.iter():
        if _local(p.tag) == tag:
            line = "".join(x.text or "" for x in p.iter() if _local(x.tag) == text_tag)
            if line.strip():
                yield line


@extractor("docx", "docx")
def docx(content: bytes) -> str:
    """SRC-11: paragraphs that aren't blank, by line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return "\n".join(_paragraphs(_xml(z, "word/document.xml"), "p", "t"))


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


@extractor("pptx", "pptx")
def pptx(content: bytes) -> str:
    """SRC-13: paragraphs of all slides in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return "\n".join(line for n in _numbered(z, r"ppt/slides/slide(\d+)\.xml") for line in _paragraphs(_xml(z, n), "p", "t"))


def _odf(content: bytes) -> ElementTree.Element:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return _xml(z, "content.xml")


@extractor("odt", "odt")
def odt(content: bytes) -> str:
    """SRC-15: the paragraphs' own text."""
    rows = ((p.text or "") + "".join(x.tail or "" for x in p) for p in _odf(content).iter() if _local(p.tag) == "p")
    return "\n".join(r for r in rows if r.strip())


def _sheets(sheets: Iterator[tuple[str, list[list[str]]]]) -> str:
    """Each sheet's name in brackets over its rows, cells parted by tabs, blank rows and sheets without others left out, a blank line between sheets."""
    out = []
    for name, rows in sheets:
        lines = [line for line in ("\t".join(r).rstrip() for r in rows) if line]
        out += ["\n".join([f"[{name}]", *lines])] if lines else []
    return "\n\n".join(out)


@extractor("ods", "ods")
def ods(content: bytes) -> str:
    """SRC-16."""

    def attribute(e: ElementTree.Element, name: str) -> str | None:
        return next((v for k, v in e.attrib.items() if _local(k) == name), None)

    def cells(row: ElementTree.Element) -> list[str]:
        out: list[str] = []
        for cell in row:
            if _local(cell.tag) in ("table-cell", "covered-table-cell"):
                text = "\n".join("".join(p.itertext()) for p in cell if _local(p.tag) == "p")
                out += [text] * (min(int(attribute(cell, "number-columns-repeated") or 1), 1024) if text else 1)
        return out

    tables = (t for t in _odf(content).iter() if _local(t.tag) == "table")
    return _sheets((attribute(t, "name") or "", [cells(r) for r in t.iter() if _local(r.tag) == "table-row"]) for t in tables)


@extractor("odp", "odp")
def odp(content: bytes) -> str:
    """SRC-17: a heading for each slide, its frames' text, notes marked."""
    slides = []
    for number, page in enumerate((p for p in _odf(content).iter() if _local(p.tag) == "page"), 1):
        lines, notes = [f"[Diapositiva {number}]"], {id(x) for n in page.iter() if _local(n.tag) == "notes" for x in n.iter()}
        for p in page.iter():
            if _local(p.tag) == "p" and (line := "".join(p.itertext()).strip()):
                lines.append(f"[Notas] {line}" if id(p) in notes else line)
        slides.append("\n".join(lines))
    return "\n\n".join(slides)


@extractor("xlsx", "xlsx")
def xlsx(content: bytes) -> str:
    """SRC-18: cached values of all sheets."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in _xml(z, "xl/sharedStrings.xml") if _local(s.tag) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
        names = [s.attrib.get("name", "") for s in _xml(z, "xl/workbook.xml").iter() if _local(s.tag) == "sheet"]

        def value(c: ElementTree.Element) -> str:
            kind, got = c.attrib.get("t"), "".join(x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t"))
            return shared[int(got)] if kind == "s" and got else {"1": "True", "0": "False"}.get(got, got) if kind == "b" else got

        def column(reference: str) -> int:
            n = 0
            for c in re.match("[A-Z]*", reference)[0]:
                n = n * 26 + ord(c) - 64
            return n

        def rows(root: ElementTree.Element) -> list[list[str]]:
            out = []
            for r in (r for r in root.iter() if _local(r.tag) == "row"):
                cells: list[str] = []
                for c in (c for c in r if _local(c.tag) == "c"):
                    cells += [""] * (min(column(c.attrib.get("r", "")), 16_384) - 1 - len(cells))
                    cells.append(value(c))
                out.append(cells)
            return out

        return _sheets(zip(names, (rows(_xml(z, n)) for n in _numbered(z, r"xl/worksheets/sheet(\d+)\.xml"))))


@extractor("rtf", "rtf")
def rtf(content: bytes) -> str:
    """SRC-19: Latin-1, control words and groups of definitions out."""
    text, out, depth, skip = content.decode("latin-1"), [], 0, None
    for m in re.finditer(r"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\(.)|([{}])|([^\\{}]+)", text, re.S):
        code, word, number, escaped, brace, run = m.groups()
        if brace:
            depth += 1 if brace == "{" else -1
            if skip is not None and depth < skip:
                skip = None
        elif skip is not None:
            continue
        elif code:
            out.append(bytes.fromhex(code).decode("cp1252", "replace"))
        elif word:
            if word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "generator"):
                skip = depth
            elif word == "u" and number:
                out.append(chr(int(number) % 65536))
            elif word in ("par", "line", "tab"):
                out.append("\t" if word == "tab" else "\n")
        elif escaped:
            if escaped == "*":
                skip = depth
            elif escaped in "\\{}":
                out.append(escaped)
        else:
            out.append(run.replace("\r", "").replace("\n", ""))
    return "".join(out).strip()


class _Text(HTMLParser):
    HIDDEN = ("script", "style", "head")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.HIDDEN

    def handle_endtag(self, tag):
        self.depth -= tag in self.HIDDEN and self.depth > 0

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.lines.append(data.strip())


def html_to_text(markup: str) -> str:
    """SCL-12: trimmed text nodes by line, without script, style and head."""
    parser = _Text()
    parser.feed(markup)
    parser.close()
    return "\n".join(parser.lines)


@extractor("epub", "epub")
def epub(content: bytes) -> str:
    """SRC-20: chapters in the package's order, a blank line between."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        package = next(e.attrib["full-path"] for e in _xml(z, "META-INF/container.xml").iter() if _local(e.tag) == "rootfile")
        root, base = _xml(z, package), package.rpartition("/")[0]
        items = [e.attrib for e in root.iter() if _local(e.tag) == "item" and "html" in e.attrib.get("media-type", "")]
        spine = [e.attrib.get("idref") for e in root.iter() if _local(e.tag) == "itemref"]
        items.sort(key=lambda i: spine.index(i.get("id")) if i.get("id") in spine else len(spine))
        chapters = (html_to_text(z.read(f"{base}/{i['href']}" if base else i["href"]).decode("utf-8", "replace")) for i in items)
        return "\n\n".join(c for c in chapters if c)


@extractor("svg", "svg")
def svg(content: bytes) -> str:
    """SRC-21: visible text; tags are stripped where the XML is broken."""
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError:
        bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", content.decode("utf-8", "replace"))
        return " ".join(re.sub("<[^>]*>", " ", bare).split())
    out: list[str] = []

    def visit(e: ElementTree.Element) -> None:
        if isinstance(e.tag, str) and _local(e.tag) not in ("style", "script"):
            out.append(e.text or "")
            for child in e:
                visit(child)
                out.append(child.tail or "")

    visit(root)
    return "\n".join(x for x in (" ".join(o.split()) for o in out) if x)


def ole_streams(content: bytes) -> dict[str, bytes]:
    """Streams of a compound file, by name."""
    if content[:8] != bytes.fromhex("D0CF11E0A1B11AE1"):
        raise ValueError("not a compound file")
    size, mini = 1 << struct.unpack_from("<H", content, 30)[0], 1 << struct.unpack_from("<H", content, 32)[0]
    first_dir, cutoff, first_mini = struct.unpack_from("<I", content, 48)[0], *struct.unpack_from("<II", content, 56)
    sector = lambda n: content[(n + 1) * size : (n + 2) * size]
    difat = list(struct.unpack_from("<109I", content, 76))
    more = struct.unpack_from("<I", content, 68)[0]
    for _ in range(struct.unpack_from("<I", content, 72)[0]):
        row = struct.unpack(f"<{size // 4}I", sector(more))
        difat, more = difat + list(row[:-1]), row[-1]
    table = [x for n in difat if n < 0xFFFFFFFC for x in struct.unpack(f"<{size // 4}I", sector(n).ljust(size, b"\xff"))]

    def chain(n: int, links: list[int], read) -> bytes:
        out, seen = [], set()
        while n < len(links) and n not in seen:
            seen.add(n)
            out.append(read(n))
            n = links[n]
        return b"".join(out)

    entries, directory = {}, chain(first_dir, table, sector)
    for at in range(0, len(directory) - 127, 128):
        length, kind = struct.unpack_from("<HB", directory, at + 64)
        if kind in (2, 5):
            entries[directory[at : at + max(0, length - 2)].decode("utf-16-le", "replace")] = (kind, *struct.unpack_from("<IQ", directory, at + 116))
    root = next((chain(start, table, sector) for kind, start, _ in entries.values() if kind == 5), b"")
    mini_raw = chain(first_mini, table, sector)
    mini_table = list(struct.unpack(f"<{len(mini_raw) // 4}I", mini_raw[: len(mini_raw) // 4 * 4]))
    small = lambda n: root[n * mini : (n + 1) * mini]
    return {name: (chain(start, table, sector) if length >= cutoff else chain(start, mini_table, small))[:length] for name, (kind, start, length) in entries.items() if kind == 2}


@extractor("doc", "doc")
def doc(content: bytes) -> str:
    """SRC-12: the piece table of a Word file; else runs of printable UTF-16 of six or more."""
    try:
        streams = ole_streams(content)
        word = streams["WordDocument"]
        table = streams["1Table" if struct.unpack_from("<H", word, 10)[0] & 0x200 else "0Table"]
        at, length = struct.unpack_from("<II", word, 0x1A2)
        clx, pos = table[at : at + length], 0
        while clx[pos] == 1:  # property runs come before the pieces
            pos += 3 + struct.unpack_from("<H", clx, pos + 1)[0]
        n = (struct.unpack_from("<I", clx, pos + 1)[0] - 4) // 12
        ends, out = struct.unpack_from(f"<{n + 1}I", clx, pos + 5), []
        for i in range(n):
            start = struct.unpack_from("<I", clx, pos + 5 + 4 * (n + 1) + 8 * i + 2)[0]
            count = ends[i + 1] - ends[i]
            if start & 0x40000000:
                begin = (start & 0x3FFFFFFF) // 2
                out.append(word[begin : begin + count].decode("cp1252", "replace"))
            else:
                out.append(word[start : start + 2 * count].decode("utf-16-le", "replace"))
        text = "".join(out)
    except (KeyError, IndexError, ValueError, struct.error):
        text = "\n".join(m[0].decode("utf-16-le") for m in re.finditer(rb"(?:[\x20-\x7e\xa0-\xff\t\n\r]\x00){6,}", content))
    text = re.sub(r"[\r\x07\x0b\x0c]", "\n", text)
    return re.sub(r"[\x00-\x08\x0e-\x1f]", "", text).strip()


@extractor("xlsx", "xls")
def xls(content: bytes) -> str:
    """SRC-18: like ``xlsx``, of a BIFF8 workbook."""
    streams = ole_streams(content)
    return _sheets(workbooks.sheets(streams["Workbook"]))


@extractor("ppt", "ppt")
def ppt(content: bytes) -> str:
    """SRC-14: text atoms of a PowerPoint file, UTF-16 (0x0FA0) or Latin-1 (0x0FA8)."""
    try:
        stream = ole_streams(content).get("PowerPoint Document", content)
    except ValueError:
        stream = content
    out, at = [], 0
    while at + 8 <= len(stream):
        version, kind, length = struct.unpack_from("<HHI", stream, at)
        body = stream[at + 8 : at + 8 + length]
        if kind in (0x0FA0, 0x0FA8) and len(body) == length:
            line = body.decode("utf-16-le" if kind == 0x0FA0 else "latin-1", "replace").replace("\r", "\n").strip()
            out += [line] if line else []
        at += 8 if version & 0x0F == 0x0F else 8 + length  # containers are entered
    return "\n".join(out)


def join_pages(pages: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """SRC-8, WIN-5: pages end to end and where each begins; for extractors of paged formats."""
    starts, at = [], 0
    for number, text in enumerate(pages, 1):
        starts.append((number, at))
        at += len(text)
    return "".join(pages), starts


_TOKENS = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()%]*|[-+.\d]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes) -> bytes:
    """The bytes of a literal or hexadecimal string."""
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))
    unescape = lambda m: b"" if m[1] in (b"\n", b"\r\n") else bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", unescape, raw[1:-1], flags=re.S)


def _pdf_objects(content: bytes) -> dict[int, tuple[bytes, bytes]]:
    """(dictionary text, decoded stream) by object number, those in object streams included."""
    found: dict[int, tuple[bytes, bytes]] = {}
    for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", content, re.S):
        head, _, rest = m[2].partition(b"stream")
        body = rest.lstrip(b"\r\n").rpartition(b"endstream")[0] if rest else b""
        if b"FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                body = b""
        found[int(m[1])] = (head, body)
    for head, body in list(found.values()):
        if b"/ObjStm" in head and (first := re.search(rb"/First\s+(\d+)", head)):
            numbers = [int(x) for x in body[: int(first[1])].split()]
            edges = [*[int(first[1]) + at for at in numbers[1::2]], len(body)]
            for number, a, b in zip(numbers[::2], edges, edges[1:]):
                found.setdefault(number, (body[a:b], b""))
    return found


def _pdf_font(objects: dict[int, tuple[bytes, bytes]], number: int) -> tuple[dict[int, str], int]:
    """(characters by code, bytes of a code) of a font, by its ToUnicode map; without one, Latin-1 of single bytes."""
    ref = re.search(rb"/ToUnicode\s+(\d+)", objects.get(number, (b"", b""))[0])
    if not ref:
        return {}, 1
    cmap, table = objects.get(int(ref[1]), (b"", b""))[1], {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        table |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            table |= {int(a, 16) + i: text(c[:-4]) + chr(int(c[-4:], 16) + i) for i in range(min(int(b, 16) - int(a, 16), 65535) + 1)}
    wide = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", cmap)
    return table, len(wide[1]) // 2 if wide else 1


def pdf_text(raw: bytes, font: tuple[dict[int, str], int]) -> str:
    """What a string shows in a font."""
    (table, width), data = font, _pdf_string(raw)
    return "".join(table.get(int.from_bytes(data[i : i + width], "big"), "") for i in range(0, len(data), width)) if table else data.decode("latin-1")


def pdf_tokens(stream: bytes) -> list[bytes]:
    return _TOKENS.findall(stream)


def pdf_page_text(stream: bytes, fonts: dict[bytes, tuple[dict[int, str], int]]) -> str:
    """The text that a page's content shows; a move to another line starts one."""
    out, stack, font = [], [], ({}, 1)

    def show(raw: bytes) -> None:
        out.append(pdf_text(raw, font))

    for token in pdf_tokens(stream):
        if not re.match(rb"[A-Za-z'\"*]", token):
            stack.append(token)
            continue
        if token in (b"Td", b"TD", b"T*", b"'", b'"', b"Tm") and out and out[-1] != "\n":
            moved = stack[-1:] not in ([b"0"], [b"0.0"]) if token in (b"Td", b"TD") else True
            out += ["\n"] if moved else [" "]
        if token == b"Tf" and len(stack) > 1:
            font = fonts.get(stack[-2], ({}, 1))
        elif token in (b"Tj", b"'", b'"') and stack:
            show(stack[-1])
        elif token == b"TJ":
            begin = len(stack) - 1 - stack[::-1].index(b"[") if b"[" in stack else 0
            for item in stack[begin:]:
                if item[:1] in b"(<":
                    show(item)
                elif re.fullmatch(rb"-\d+(\.\d+)?", item) and float(item) < -200:
                    out.append(" ")  # a gap as wide as a space
        stack = []
    return "".join(out).strip("\n")


def pdf_pages(content: bytes) -> list[tuple[bytes, dict[bytes, tuple[dict[int, str], int]]]]:
    """(content, fonts by name) of every page, uncompressed or Flate streams. Encrypted files fail."""
    if b"/Encrypt" in content:
        raise ValueError("encrypted")
    objects = _pdf_objects(content)
    refs = lambda key, head: [int(x) for m in re.findall(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", head) for x in re.findall(rb"(\d+)\s+\d+\s+R", m)]

    def pages(number: int, seen: frozenset) -> Iterator[int]:
        head = objects.get(number, (b"", b""))[0]
        if re.search(rb"/Type\s*/Pages\b", head):
            for kid in refs(b"Kids", head):
                if kid not in seen:
                    yield from pages(kid, seen | {kid})
        elif re.search(rb"/Type\s*/Page\b", head):
            yield number

    roots = [n for n, (head, _) in objects.items() if re.search(rb"/Type\s*/Pages\b", head) and not re.search(rb"/Parent\b", head)]
    found = []
    for number in [p for r in roots for p in pages(r, frozenset([r]))]:
        head = objects[number][0]
        held = head
        for ref in refs(b"Resources", head) + refs(b"Parent", head):
            held += objects.get(ref, (b"", b""))[0]
        for ref in refs(b"Font", held):
            held += objects.get(ref, (b"", b""))[0]
        fonts = {b"/" + name: _pdf_font(objects, int(ref)) for name, ref in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", held) if b"/Font" in objects.get(int(ref), (b"", b""))[0]}
        found.append((b"\n".join(objects.get(c, (b"", b""))[1] for c in refs(b"Contents", head)), fonts))
    return found


@extractor("pdf", "pdf")
def pdf(content: bytes) -> tuple[str, list[tuple[int, int]]]:
    """SRC-8: the text layer of every page, pages end to end, with where each begins. Pages that are pictures have no text."""
    return join_pages([pdf_page_text(*page) for page in pdf_pages(content)])


def run_one(content: bytes | None, ext: str | None, texty: bool, registry: dict[str, Extractor]) -> tuple[str | None, list | None, str | None, str | None]:
    """SRC-6: by extension, else as text if it looks like it: (text, page_map, extractor, error)."""
    use = registry.get((ext or "").lower()) or (registry[".txt"] if texty else None)
    if use is None:
        return None, None, None, "unsupported"
    try:
        text, pages, name = use(content or b"")
        return text, [{"page": p, "start": s} for p, s in pages], name, None
    except Exception as e:  # noqa: BLE001  a broken file must not fail the task
        return None, None, None, f"{type(e).__name__}: {e}"[:300]


def extract(files: DataFrame, registry: dict[str, Extractor] | None = None, key: str = "path", timeouts: dict[str, float] | None = None, seen: Callable[[], None] | None = None) -> DataFrame:
    """UDF-1: (key, text, page_map, extractor, error) of files (key, extension, content): one Arrow pass, a file at a time in memory.

    With ``timeouts`` (seconds by extension or category, "" for others; ``files`` then have a category) every task extracts in a child process:
    a file that takes longer is the error "timeout", and the task goes on with a new child (see ``deadline``). ``seen`` is called
    on the worker after each file.
    """
    from .scan import looks_like_text

    registry = registry or EXTRACTORS
    kind = pa.list_(pa.struct([("page", pa.int32()), ("start", pa.int32())]))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with contextlib.ExitStack() as held:
            child = held.enter_context(deadline.Child(lambda *file: run_one(*file, registry))) if timeouts is not None else None
            for batch in source:
                yield from rows_of(batch, child)

    def one(file: tuple, category: str | None, child: deadline.Child | None) -> tuple:
        if child is None:
            return run_one(*file, registry)
        try:
            wait = next((timeouts[x] for x in ((file[1] or "").lower(), category, "") if x in timeouts), TIMEOUTS[""])
            return child(*file, seconds=wait)
        except TimeoutError:
            return None, None, None, "timeout"
        except deadline.Died as e:
            return None, None, None, f"Died: {e}"

    def rows_of(batch: pa.RecordBatch, child: deadline.Child | None) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            file = tuple(batch.column(c)[i].as_py() for c in ("content", "extension", "texty"))
            text, pages, name, error = one(file, batch.column("category")[i].as_py(), child)
            if seen:
                seen()
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, 1), pa.array([text], pa.string()), pa.array([pages], kind), pa.array([name], pa.string()), pa.array([error], pa.string())], ["key", "text", "page_map", "extractor", "error"])

    category = F.col("category") if timeouts is not None else F.lit("")
    rows = files.select(F.col(key).alias("key"), "extension", "content", category.alias("category"), looks_like_text(F.col("content")).alias("texty"))
    return rows.mapInArrow(batches, f"key {files.schema[key].dataType.simpleString()}, {RESULT}").withColumnRenamed("key", key)


def html_texts(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """SCL-12 on a table: (key, text)."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([html_to_text(m or "") for m in batch.column("markup").to_pylist()], pa.string())], [key, "text"])

    return pages.select(key, F.col(markup).alias("markup")).mapInArrow(batches, f"{key} {pages.schema[key].dataType.simpleString()}, text string")


def zip_words(content: bytes) -> int:
    """SRC-25: words of three or more letters in the XML of an office file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = " ".join(z.read(n).decode("utf-8", "replace") for n in z.namelist() if n.endswith(".xml"))
    return len(re.findall(r"[^\W\d_]{3,}", re.sub("<[^>]+>", " ", xml)))


def image_size(content: bytes) -> tuple[int, int] | None:
    """SRC-25: (width, height) of PNG, GIF, BMP and JPEG files."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack_from(">II", content, 16)
    if content[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack_from("<HH", content, 6)
    if content[:2] == b"BM":
        return struct.unpack_from("<ii", content, 18)
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content):
            marker, length = content[at + 1], struct.unpack_from(">H", content, at + 2)[0]
            if marker in (*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                height, width = struct.unpack_from(">HH", content, at + 5)
                return width, height
            at += 2 + length
    return None


def media_extractor(kind: str, transcribe: Callable[[bytes], list[str]] | None = None, caption: Callable[[bytes], str] | None = None, read: Callable[[bytes], str] | None = None, frames: Callable[[bytes], list[bytes]] | None = None, interval: int = 30, most: int = 20, caption_again: Callable[[bytes], str] | None = None) -> Extractor:
    """SRC-10, SRC-22..24, UDF-7..9: an extractor of a kind (audio, image, video, pdf-ocr) from models, each of which may be missing or fail (its part is then left out).

    A caption that came out empty is asked for once more with ``caption_again`` (a shorter prompt). Models may be ``encoders.Lazy``."""

    def attempt(model, *args, default):
        try:
            return model(*args) or default if model else default
        except Exception:  # noqa: BLE001  a part that fails is left out
            return default

    def described(picture: bytes) -> str:
        return attempt(caption, picture, default="") or attempt(caption_again, picture, default="")

    def run(content: bytes) -> Extracted:
        if kind == "pdf-ocr":
            text, pages = join_pages([attempt(read, page, default="") for page in attempt(frames, content, default=[])])
            return text, pages, kind
        spoken = " ".join(x.strip() for x in attempt(transcribe, content, default=[]) if x.strip())
        if kind == "audio":
            return spoken, [], kind
        if kind == "image":
            parts = [("Descripcion: ", described(content).strip()), ("Texto en la imagen: ", attempt(read, content, default="").strip())]
            return "\n\n".join(label + x for label, x in parts if x), [], kind
        seen = [(i * interval, described(frame)) for i, frame in enumerate(attempt(frames, content, default=[])[:most])]
        lines = "\n".join(f"[{at // 60:02d}:{at % 60:02d}] {x}" for at, x in seen if x)
        return "\n\n".join(x for x in (spoken, lines) if x), [], kind

    return run


def pdf_words(content: bytes) -> tuple[int, int]:
    text = pdf(content)[0]
    return len(text.split()), len(text)


def read_metadata(content: bytes | None, ext: str, category: str) -> dict:
    """SRC-25: what a file's bytes say of it; nothing where they can't be read."""
    try:
        if ext == ".pdf":
            words, chars = pdf_words(content)
            return {"wordCount": words, "charCount": chars}
        if ext == ".docx":
            text = EXTRACTORS[ext](content)[0]
            return {"wordCount": len(text.split()), "charCount": len(text)}
        if ext in (".pptx", ".odt", ".odp"):
            return {"wordCount": zip_words(content)}
        if category == "text":
            text = plain(content)
            return {"wordCount": len(text.split()), "charCount": len(text)}
        if category == "image" and (size := image_size(content)):
            return {"width": size[0], "height": abs(size[1])} | ({"ppi": ppi} if (ppi := image_ppi(content)) else {})
        if ext == ".wav":
            with wave.open(io.BytesIO(content)) as w:
                return {"duration": round(w.getnframes() / w.getframerate()), "bitrate": round(w.getframerate() * w.getsampwidth() * 8 * w.getnchannels() / 1000)}
        if category in ("audio", "video"):
            return media.probe(content, category)
    except Exception:  # noqa: BLE001  unreadable files have no metadata
        pass
    return {}


def image_ppi(content: bytes) -> float | None:
    """SRC-25: dots an inch of a PNG with physical dimensions, or a JPEG with a JFIF density."""
    at = content.find(b"pHYs")
    if content[:4] == b"\x89PNG" and at > 0 and content[at + 12] == 1:
        return round(struct.unpack_from(">I", content, at + 4)[0] * 0.0254, 1)
    at = content.find(b"JFIF\0")
    if content[:2] == b"\xff\xd8" and 0 < at < 64 and content[at + 7] == 1:
        return float(struct.unpack_from(">H", content, at + 8)[0])
    return None


METADATA = "struct<wordCount: int, charCount: int, width: int, height: int, ppi: double, duration: int, bitrate: int, fps: double>"


def metadata(files: DataFrame, key: str = "path") -> DataFrame:
    """SRC-25: (key, metadata) of files (key, extension, category, content): one Arrow pass, a file at a time in memory."""
    names = [x.split(":")[0].strip() for x in METADATA[7:-1].split(",")]
    kinds = [pa.float64() if n in ("ppi", "fps") else pa.int32() for n in names]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = [read_metadata(batch.column("content")[i].as_py(), batch.column("extension")[i].as_py(), batch.column("category")[i].as_py()) for i in range(batch.num_rows)]
            struct_ = pa.StructArray.from_arrays([pa.array([x.get(n) for x in found], k) for n, k in zip(names, kinds)], names)
            yield pa.RecordBatch.from_arrays([batch.column("key"), struct_], ["key", "metadata"])

    rows = files.select(F.col(key).alias("key"), "extension", "category", "content")
    return rows.mapInArrow(batches, f"key {files.schema[key].dataType.simpleString()}, metadata {METADATA}").withColumnRenamed("key", key)

"""SRC-9, SRC-10: PDF files as Markdown in reading order, from the positions of their text; OCR where there is no usable text.

A page's content is replayed into runs of text with a place and a size. Recursive cuts through empty vertical strips (columns),
then empty horizontal ones (paragraphs), give blocks; columns of short cells on common baselines are a table. Widths are
estimated at half the font size a character, since fonts' own widths aren't read. The thresholds are shares of the body's size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

from ..functions.text import CONTROL_SHARE, LATIN_EXTENDED_SHARE
from . import extract

#: Largest file that is laid out, pages sampled, and characters a page below which a file counts as scanned.
MOST_BYTES, SAMPLE_PAGES, LEAST_CHARS = 10 << 20, 5, 50
#: In body sizes: least width of a strip between columns, least height of one between blocks. Headings' sizes, first and second level.
STRIP, GAP, FIRST_LEVEL, SECOND_LEVEL = 1.5, 0.8, 1.6, 1.15
#: Mean characters of a table's cells at most.
CELL_CHARS = 25
#: Thousandths of the size: a gap within a shown array that is a space, and one that begins another run.
SPACE, JUMP = 200, 2000

Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1, 0, 0, 1, 0, 0)


class Run(NamedTuple):
    left: float
    right: float
    base: float
    size: float
    text: str


def _times(a: Matrix, b: Matrix) -> Matrix:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


class _Replay:
    """Text state of a page's content; every operator that shows text leaves runs."""

    def __init__(self, fonts: dict) -> None:
        self.fonts, self.font, self.size, self.leading, self.runs = fonts, ({}, 1), 0.0, 0.0, []
        self.page, self.saved, self.line, self.text = UNIT, [], UNIT, UNIT

    def move(self, x: float, y: float) -> None:
        self.line = self.text = _times((1, 0, 0, 1, x, y), self.line)

    def show(self, items: list[bytes]) -> None:
        said, begin, ahead = "", self.text, 0.0
        for item in items:
            if item[:1] in b"(<":
                shown = extract.pdf_text(item, self.font)
                said, ahead = said + shown, ahead + len(shown) * self.size / 2
            elif re.fullmatch(rb"[-+]?(\d+\.?\d*|\.\d+)", item):
                back = float(item)
                ahead -= back * self.size / 1000
                if back < -JUMP:
                    self._keep(said, begin, ahead + back * self.size / 1000)
                    said, begin, self.text, ahead = "", *(_times((1, 0, 0, 1, ahead, 0), begin),) * 2, 0.0
                elif back < -SPACE and said:
                    said += " "
        self._keep(said, begin, ahead)
        self.text = _times((1, 0, 0, 1, ahead, 0), begin)

    def _keep(self, said: str, begin: Matrix, width: float) -> None:
        at = _times(begin, self.page)
        if said.strip():
            across, up = (at[0] ** 2 + at[1] ** 2) ** 0.5, (at[2] ** 2 + at[3] ** 2) ** 0.5
            self.runs.append(Run(at[4], at[4] + max(width, 0.0) * across, at[5], self.size * up, said))

    def do(self, operator: bytes, stack: list[bytes]) -> None:
        n = [float(x) for x in stack if re.fullmatch(rb"[-+]?(\d+\.?\d*|\.\d+)", x)]
        if operator == b"q":
            self.saved.append((self.page, self.font, self.size, self.leading))
        elif operator == b"Q" and self.saved:
            self.page, self.font, self.size, self.leading = self.saved.pop()
        elif operator == b"cm" and len(n) == 6:
            self.page = _times(tuple(n), self.page)
        elif operator == b"BT":
            self.line = self.text = UNIT
        elif operator == b"Tf" and len(stack) > 1:
            self.font, self.size = self.fonts.get(stack[-2], ({}, 1)), n[-1] if n else 0.0
        elif operator == b"TL" and n:
            self.leading = n[-1]
        elif operator in (b"Td", b"TD") and len(n) == 2:
            self.leading = -n[1] if operator == b"TD" else self.leading
            self.move(*n)
        elif operator == b"Tm" and len(n) == 6:
            self.line = self.text = tuple(n)
        elif operator == b"T*":
            self.move(0, -self.leading)
        elif operator in (b"'", b'"') and stack:
            self.move(0, -self.leading)
            self.show(stack[-1:])
        elif operator == b"Tj" and stack:
            self.show(stack[-1:])
        elif operator == b"TJ" and b"[" in stack:
            self.show(stack[len(stack) - stack[::-1].index(b"[") :])


def page_runs(stream: bytes, fonts: dict) -> list[Run]:
    replay, stack = _Replay(fonts), []
    for token in extract.pdf_tokens(stream):
        if re.match(rb"[A-Za-z'\"*]", token):
            replay.do(token, stack)
            stack = []
        else:
            stack.append(token)
    return replay.runs


def _apart(runs: list[Run], low: Callable[[Run], float], high: Callable[[Run], float], least: float) -> list[list[Run]]:
    """Groups of runs between which an empty strip of ``least`` lies, ascending."""
    out: list[list[Run]] = []
    reach = 0.0
    for r in sorted(runs, key=low):
        if not out or low(r) - reach > least:
            out.append([])
            reach = high(r)
        out[-1].append(r)
        reach = max(reach, high(r))
    return out


def _columns(runs: list[Run], body: float) -> list[list[Run]]:
    return _apart(runs, lambda r: r.left, lambda r: r.right, STRIP * body)


def lines(runs: list[Run]) -> list[list[Run]]:
    """Runs by baseline from the top, each line from the left."""
    out: list[list[Run]] = []
    for r in sorted(runs, key=lambda r: (-r.base, r.left)):
        if out and out[-1][0].base - r.base < 0.4 * max(r.size, out[-1][0].size):
            out[-1].append(r)
        else:
            out.append([r])
    return [sorted(line, key=lambda r: r.left) for line in out]


def _line_text(line: list[Run], body: float) -> str:
    said, reach = "", None
    for r in line:
        said += (" " if reach is not None and r.left - reach > 0.1 * body else "") + r.text
        reach = r.right
    return " ".join(said.split())


def _table(columns: list[list[Run]], body: float) -> list[list[str]] | None:
    """Rows of cells, if most rows have several and the cells are short."""
    place = {id(r): i for i, c in enumerate(columns) for r in c}
    rows = []
    for line in lines([r for c in columns for r in c]):
        rows.append([_line_text([r for r in line if place[id(r)] == i], body) for i in range(len(columns))])
    filled = [sum(bool(c) for c in row) for row in rows]
    short = sum(len(c) for row in rows for c in row) <= CELL_CHARS * sum(filled)
    return rows if len(rows) > 1 and short and 2 * sum(n > 1 for n in filled) > len(rows) else None


def _bands(runs: list[Run], body: float) -> list[list[Run]]:
    """Runs between empty horizontal strips or changes of size, from the top; neighbours that share a strip between columns stay together."""
    bands: list[list[Run]] = []
    for group in reversed(_apart(runs, lambda r: r.base, lambda r: r.base + r.size, GAP * body)):
        size = None
        for line in lines(group):
            now = max(r.size for r in line)
            if size is None or abs(now - size) > 0.1 * body:
                bands.append([])
            bands[-1] += line
            size = now
    out: list[list[Run]] = []
    for band in bands:
        if out and len(_columns(out[-1], body)) > 1 and len(_columns(band, body)) > 1 and len(_columns(out[-1] + band, body)) > 1:
            out[-1] += band
        else:
            out.append(band)
    return out


def blocks(runs: list[Run], body: float) -> Iterator[tuple[str, list]]:
    """("table", rows of cells) and ("text", runs) in reading order."""
    columns = _columns(runs, body)
    if len(columns) > 1:
        if rows := _table(columns, body):
            yield "table", rows
            return
        if all(len(lines(c)) > 1 for c in columns):
            for c in columns:
                yield from blocks(c, body)
            return
    bands = _bands(runs, body)
    if len(bands) > 1:
        for band in bands:
            yield from blocks(band, body)
    elif runs:
        yield "text", runs


def _markdown(kind: str, held: list, body: float) -> str:
    if kind == "table":
        row = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
        return "\n".join([row(held[0]), "|" + "---|" * len(held[0]), *map(row, held[1:])])
    said = " ".join(_line_text(line, body) for line in lines(held))
    size = min(r.size for r in held)
    return ("# " if size >= FIRST_LEVEL * body else "## " if size >= SECOND_LEVEL * body else "") + said


def markdown(pages: list[list[Run]]) -> str:
    """All pages' blocks, a blank line between; the body's size is the one of most characters."""
    chars = Counter()
    for runs in pages:
        for r in runs:
            chars[round(r.size, 1)] += len(r.text)
    body = max(chars.most_common(1)[0][0], 0.1) if chars else 1.0
    return "\n\n".join(_markdown(kind, held, body) for runs in pages for kind, held in blocks(runs, body))


def garbled(text: str) -> bool:
    """SCL-9 of one text."""
    seen = re.sub(r"\s", "", text)
    control, latin = len(re.findall(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", text)), len(re.findall("[Ā-ɏ]", seen))
    return bool(seen) and (control > CONTROL_SHARE * len(text) or latin > LATIN_EXTENDED_SHARE * len(seen))


def scanned(texts: list[str]) -> bool:
    """Of pages spread over the file, few characters on average, or garbled ones; not without pages."""
    step = max(1, len(texts) // SAMPLE_PAGES)
    sample = texts[::step][:SAMPLE_PAGES]
    return bool(sample) and (len("".join(sample).strip()) < LEAST_CHARS * len(sample) or garbled("".join(sample)))


def text_extractor(ocr: extract.Extractor | None = None) -> extract.Extractor:
    """SRC-8 with SRC-10: the text layer; ``ocr`` (``media_extractor("pdf-ocr", ...)``) where it is garbled. Without ``ocr`` it stays as it is."""

    def run(content: bytes) -> extract.Extracted:
        text, pages = extract.pdf(content)
        return ocr(content) if ocr and garbled(text) else (text, pages, "pdf")

    return run


def layout_extractor(ocr: extract.Extractor | None = None, most_bytes: int = MOST_BYTES) -> extract.Extractor:
    """SRC-9: Markdown with an approximate page map (pages of equal length); files over ``most_bytes`` take the fast path, scanned
    ones and those that can't be laid out ``ocr``. Without ``ocr`` scanned files are laid out as they are, and failures raise."""
    fast = text_extractor(ocr)

    def run(content: bytes) -> extract.Extracted:
        if len(content) > most_bytes:
            return fast(content)
        try:
            pages = extract.pdf_pages(content)
            if ocr and scanned([extract.pdf_page_text(*p) for p in pages]):
                return ocr(content)
            text = markdown([page_runs(*p) for p in pages])
        except Exception:
            if ocr is None:
                raise
            return ocr(content)
        each = max(1, len(text) // max(1, len(pages)))
        return text, [(i + 1, i * each) for i in range(len(pages))], "pdf-layout"

    return run

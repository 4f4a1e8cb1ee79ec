"""SRC-18: cell values of BIFF8 workbooks (.xls), from the records of the compound file's workbook stream."""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: Numbers of the records that are read.
BOF, EOF, CONTINUE, FILE_PASS, BOUND_SHEET, SHARED = 0x0809, 0x0A, 0x3C, 0x2F, 0x85, 0xFC
LABEL_SHARED, LABEL, NUMBER, RK, MULTIPLE_RK, BOOL_ERROR, FORMULA, STRING = 0xFD, 0x0204, 0x0203, 0x027E, 0xBD, 0x0205, 0x06, 0x0207
#: The texts of error cells.
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
BIFF8, WORKSHEET = 0x0600, 0


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(number, parts) of the records from ``at`` to the end of the substream: the record's own bytes, then those of each CONTINUE record."""
    held: tuple[int, list[bytes]] | None = None
    while at + 4 <= len(stream):
        number, length = struct.unpack_from("<HH", stream, at)
        body = stream[at + 4 : at + 4 + length]
        at += 4 + length
        if number == CONTINUE and held:
            held[1].append(body)
            continue
        if held:
            yield held
        held = number, [body]
        if number == EOF:
            break
    if held:
        yield held


class _Parts:
    """Reads over the borders of a record's parts. Characters cut by a border go on after a byte that says how wide they are from there."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts, self.part, self.at = parts, 0, 0

    def _next_part(self) -> None:
        self.part, self.at = self.part + 1, 0
        if self.part >= len(self.parts):
            raise ValueError("a record ends early")

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at >= len(self.parts[self.part]):
                self._next_part()
            got = self.parts[self.part][self.at : self.at + n - len(out)]
            out, self.at = out + got, self.at + len(got)
        return out

    def number(self, kind: str) -> int:
        return struct.unpack("<" + kind, self.take(struct.calcsize("<" + kind)))[0]

    def text(self, n: int) -> str:
        """A string of ``n`` characters with its flags, formatting runs and phonetic data, which are passed over."""
        flags = self.number("B")
        runs = self.number("H") if flags & 8 else 0
        phonetic = self.number("I") if flags & 4 else 0
        out, wide = [], flags & 1
        while n:
            if self.at >= len(self.parts[self.part]):
                self._next_part()
                wide = self.number("B") & 1
            here = min(n, (len(self.parts[self.part]) - self.at) >> wide)
            if not here:
                raise ValueError("a character is cut")
            raw = self.parts[self.part][self.at : self.at + (here << wide)]
            out.append(raw if wide else raw.decode("latin-1").encode("utf-16-le"))
            self.at, n = self.at + len(raw), n - here
        self.take(4 * runs + phonetic)
        return b"".join(out).decode("utf-16-le", "replace")


def _plain(value: float) -> str:
    return str(int(value)) if value == value and abs(value) < 1e15 and value == int(value) else repr(value)


def _packed(raw: int) -> str:
    """A number in 30 bits: the high part of a double, or a signed whole number; in hundredths if the lowest bit is set."""
    value = struct.unpack("<i", struct.pack("<I", raw))[0] >> 2 if raw & 2 else struct.unpack("<d", struct.pack("<II", 0, raw & 0xFFFFFFFC))[0]
    return _plain(value / 100 if raw & 1 else value)


def _result(raw: bytes) -> str | None:
    """The cached result of a formula; None if it is a string, which a record of its own has."""
    if raw[6:8] != b"\xff\xff":
        return _plain(struct.unpack("<d", raw)[0])
    return None if raw[0] == 0 else _flag(raw[2], raw[0] == 2) if raw[0] in (1, 2) else ""


def _flag(value: int, error: bool) -> str:
    return ERRORS.get(value, "#ERR") if error else str(bool(value))


def _cells(stream: bytes, at: int, shared: list[str]) -> Iterator[tuple[int, int, str]]:
    """(row, column, value) of a sheet's cells. Charts and other substreams within the sheet have no cells of it."""
    waiting = None
    depth = 0
    for number, parts in _substream(stream, at):
        depth += (number == BOF) - (number == EOF)
        body = parts[0]
        if depth != 1 or len(body) < 6:
            if not (depth == 1 and number == STRING and waiting):
                continue
        if number == STRING and waiting:
            whole = _Parts(parts)
            yield *waiting, whole.text(whole.number("H"))
            waiting = None
            continue
        row, column = struct.unpack_from("<HH", body)
        if number == LABEL_SHARED:
            yield row, column, shared[struct.unpack_from("<I", body, 6)[0]]
        elif number == LABEL:
            whole = _Parts(parts)
            whole.take(6)
            yield row, column, whole.text(whole.number("H"))
        elif number == NUMBER:
            yield row, column, _plain(struct.unpack_from("<d", body, 6)[0])
        elif number == RK:
            yield row, column, _packed(struct.unpack_from("<I", body, 6)[0])
        elif number == MULTIPLE_RK:
            for i in range((len(body) - 6) // 6):
                yield row, column + i, _packed(struct.unpack_from("<I", body, 6 + 6 * i)[0])
        elif number == BOOL_ERROR:
            yield row, column, _flag(body[6], body[7] == 1)
        elif number == FORMULA:
            value = _result(body[6:14])
            if value is None:
                waiting = row, column
            else:
                yield row, column, value


def _substream(stream: bytes, at: int) -> Iterator[tuple[int, list[bytes]]]:
    """The records of a sheet, those of substreams within it included, to its own end."""
    depth = 0
    while True:
        read = 0
        for number, parts in records(stream, at):
            read += sum(4 + len(p) for p in parts)
            depth += (number == BOF) - (number == EOF)
            yield number, parts
        at += read
        if depth <= 0 or not read:
            return


def sheets(stream: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows of values) of every worksheet of a workbook stream; empty cells are empty strings. Older formats and encrypted workbooks raise ValueError."""
    version = struct.unpack_from("<H", stream, 4)[0] if len(stream) > 8 and struct.unpack_from("<H", stream)[0] == BOF else 0
    if version != BIFF8:
        raise ValueError("not a BIFF8 workbook")
    shared, found = [], []
    for number, parts in records(stream):
        if number == FILE_PASS:
            raise ValueError("encrypted")
        if number == SHARED:
            whole = _Parts(parts)
            whole.take(4)
            shared = [whole.text(whole.number("H")) for _ in range(whole.number("I"))]
        elif number == BOUND_SHEET and parts[0][5] == WORKSHEET:
            whole = _Parts(parts)
            begin = whole.number("I")
            whole.take(2)
            found.append((begin, whole.text(whole.number("B"))))
    out = []
    for begin, name in found:
        rows: dict[int, dict[int, str]] = {}
        for row, column, value in _cells(stream, begin, shared):
            rows.setdefault(row, {})[column] = value
        out.append((name, [[rows[r].get(c, "") for c in range(max(rows[r]) + 1)] for r in sorted(rows)]))
    return out

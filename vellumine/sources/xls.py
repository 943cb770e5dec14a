"""Binary workbooks (BIFF8): every sheet as a table, hidden ones too, with cached values and merges."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from vellumine.sources.office import DATE_FORMATS, Compound, Options, ReadError, date_code, moment
from vellumine.sources.runs import Block, block

# Record numbers.
BOF, EOF, BOUNDSHEET, SST, CONTINUE, LABELSST, LABEL, NUMBER, RK, MULRK, BOOLERR, FORMULA, STRING, FORMAT, XF, DATEMODE, MERGED, FILEPASS = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x207, 0x41E, 0xE0, 0x22, 0xE5, 0x2F


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(number, parts): a record with those that continue it; a truncated one ends the stream."""
    kind, parts = -1, []
    while at + 4 <= len(data):
        number, size = struct.unpack_from("<HH", data, at)
        body, at = data[at + 4 : at + 4 + size], at + 4 + size
        if len(body) < size:
            break
        if number == CONTINUE and parts:
            parts.append(body)
            continue
        if parts:
            yield kind, parts
        kind, parts = number, [body]
    if parts:
        yield kind, parts


class _Parts:
    """Bytes of a record that goes on in others; a string's characters begin anew with their width in each."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def more(self) -> bool:
        while self.part < len(self.parts) and self.at >= len(self.parts[self.part]):
            self.part, self.at = self.part + 1, 0
        return self.part < len(self.parts)

    def take(self, n: int) -> bytes:
        out = b""
        while n > 0 and self.more():
            got = self.parts[self.part][self.at : self.at + n]
            out, self.at, n = out + got, self.at + len(got), n - len(got)
        return out

    def characters(self, n: int, wide: bool) -> str:
        out = ""
        while n > 0:
            if self.at >= len(self.parts[self.part]):
                if not self.more():
                    break
                wide = bool(self.take(1)[0] & 1)
            left = (len(self.parts[self.part]) - self.at) // (1 + wide)
            if not left:
                break
            got = self.take(min(n, left) * (1 + wide))
            out, n = out + got.decode("utf-16-le" if wide else "latin-1", "replace"), n - len(got) // (1 + wide)
        return out

    def string(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        text = self.characters(n, bool(flags & 1))
        self.take(4 * runs + extra)
        return text


def rk_value(raw: int) -> float:
    """A packed number: a whole one or the upper bits of a double, perhaps in hundredths."""
    value = float((raw - (1 << 32) if raw >> 31 else raw) >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


def read_xls(data: bytes, options: Options | None = None) -> list[Block]:
    options = options or Options()
    file = Compound(data)
    name = next((n for n in ("Workbook", "Book") if n in file.paths), None)
    if name is None:
        raise ReadError("no workbook")
    book = file.read(name)
    sheets, shared, formats, styles, from_1904 = [], [], {}, [], False
    for kind, parts in records(book):
        body = parts[0]
        if kind == BOF and len(body) >= 2 and struct.unpack_from("<H", body)[0] != 0x600:
            raise ReadError("an older workbook format")
        if kind == FILEPASS:
            raise ReadError("encrypted")
        if kind == BOUNDSHEET:
            at, _, sort, size, flags = struct.unpack_from("<IBBBB", body)
            if sort == 0:
                sheets.append((at, body[8 : 8 + size * (1 + (flags & 1))].decode("utf-16-le" if flags & 1 else "latin-1", "replace")))
        elif kind == SST:
            reader = _Parts(parts)
            count = struct.unpack("<II", reader.take(8))[1]
            while len(shared) < count and reader.more():
                shared.append(reader.string())
        elif kind == FORMAT:
            formats[struct.unpack_from("<H", body)[0]] = _Parts([body[2:]]).string()
        elif kind == XF:
            styles.append(struct.unpack_from("<H", body, 2)[0])
        elif kind == DATEMODE:
            from_1904 = body[:1] == b"\x01"
        elif kind == EOF:
            break

    def number(value: float, style: int) -> str:
        code = styles[style] if style < len(styles) else 0
        if date_code(formats[code]) if code in formats else code in DATE_FORMATS:
            return moment(value, from_1904)
        return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)

    out = []
    for at, title in sheets:
        cells: dict[tuple[int, int], str] = {}
        merges: dict[tuple[int, int], tuple[int, int]] = {}
        waiting, depth, cut = None, 0, False
        for kind, parts in records(book, at):
            body = parts[0]
            depth += (kind == BOF) - (kind == EOF)
            if kind == EOF and depth <= 0:
                break
            if kind == MERGED:
                for i in range(struct.unpack_from("<H", body)[0]):
                    r0, r1, c0, c1 = struct.unpack_from("<HHHH", body, 2 + 8 * i)
                    merges[r0, c0] = (r1 - r0 + 1, c1 - c0 + 1)
            elif kind == STRING and waiting is not None:
                cells[waiting], waiting = _Parts(parts).string(), None
            elif kind in (LABELSST, LABEL, NUMBER, RK, MULRK, BOOLERR, FORMULA) and depth == 1:
                r, c, style = struct.unpack_from("<HHH", body)
                if r >= options.max_rows:
                    cut = True
                elif kind == LABELSST:
                    i = struct.unpack_from("<I", body, 6)[0]
                    cells[r, c] = shared[i] if i < len(shared) else ""
                elif kind == LABEL:
                    cells[r, c] = _Parts([body[6:]]).string()
                elif kind == NUMBER:
                    cells[r, c] = number(struct.unpack_from("<d", body, 6)[0], style)
                elif kind == RK:
                    cells[r, c] = number(rk_value(struct.unpack_from("<I", body, 6)[0]), style)
                elif kind == MULRK:
                    for k in range((len(body) - 6) // 6):
                        own, raw = struct.unpack_from("<HI", body, 4 + 6 * k)
                        cells[r, c + k] = number(rk_value(raw), own)
                elif kind == BOOLERR:
                    cells[r, c] = "#ERROR" if body[7] else "TRUE" if body[6] else "FALSE"
                elif body[12:14] != b"\xff\xff":
                    cells[r, c] = number(struct.unpack_from("<d", body, 6)[0], style)
                elif body[6] == 0:
                    waiting = (r, c)
                else:
                    cells[r, c] = {1: "TRUE" if body[8] else "FALSE", 2: "#ERROR"}.get(body[6], "")
        if cut:
            options.warnings.append(f"sheet {title}: only the first {options.max_rows} rows are read")
        covered = {(r + i, c + k) for (r, c), (h, w) in merges.items() for i in range(h) for k in range(w) if i or k}
        out.append(block("table", title, cells=[(*p, *merges.get(p, (1, 1)), t) for p, t in sorted(cells.items()) if p not in covered]))
    return out

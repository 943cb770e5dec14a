"""PDF by plain lines: wrapped by width, laid on A4 pages, in a standard CJK font that readers supply."""

from __future__ import annotations

import zlib

from vellumine.sources.runs import Block

#: A wrapped line stands closer to the one before than a new one does, so readers can tell them apart.
WIDTH, HEIGHT, MARGIN, SIZE, LEADING, CLOSE, CELLS = 595, 842, 56, 10, 15, 12, 90
LINES = (HEIGHT - 2 * MARGIN) // LEADING


def cells_of(ch: str) -> int:
    return 2 if ord(ch) > 0x1100 else 1


def wrapped(line: str, width: int = CELLS) -> list[str]:
    """Pieces of at most ``width`` cells, cut after a blank where there is one."""
    out, at, used, blank = [], 0, 0, -1
    i = 0
    while i < len(line):
        used += cells_of(line[i])
        if used > width and i > at:
            end = blank + 1 if blank >= at else i
            out.append(line[at:end].rstrip())
            at, used, blank, i = end, 0, -1, end
            continue
        if line[i] == " ":
            blank = i
        i += 1
    return [*out, line[at:]]


def plain_pages(text_lines: list[str], lines: int = LINES) -> list[list[tuple[str, bool]]]:
    """Lines, and whether each goes on from the one before, on pages; a form feed begins a new one."""
    pages: list[list[tuple[str, bool]]] = [[]]
    for line in text_lines:
        if line == "\f":
            pages.append([])
            continue
        for k, part in enumerate(wrapped(line.replace("\t", "    "))):
            if len(pages[-1]) == lines:
                pages.append([])
            pages[-1].append((part, k > 0))
    return pages


def write_pdf(blocks: list[Block], title: str = "") -> bytes:
    from vellumine.sinks.office import write_txt

    pages = plain_pages(write_txt(blocks, title).decode().rstrip("\n").split("\n"))
    objects: list[bytes] = []

    def add(body: bytes | str) -> int:
        objects.append(body if isinstance(body, bytes) else body.encode("latin-1"))
        return len(objects)

    add("<< /Type /Catalog /Pages 2 0 R >>")
    add("")
    add("<< /Type /Font /Subtype /Type0 /BaseFont /HYSMyeongJoStd-Medium /Encoding /UniKS-UTF16-H /DescendantFonts [4 0 R] >>")
    add("<< /Type /Font /Subtype /CIDFontType0 /BaseFont /HYSMyeongJoStd-Medium /CIDSystemInfo << /Registry (Adobe) /Ordering (Korea1) /Supplement 1 >> /DW 1000 /W [1 95 500] /FontDescriptor 5 0 R >>")
    add("<< /Type /FontDescriptor /FontName /HYSMyeongJoStd-Medium /Flags 6 /FontBBox [0 -148 1001 880] /ItalicAngle 0 /Ascent 880 /Descent -148 /CapHeight 720 /StemV 60 >>")
    title_id = add(b"<< /Title <FEFF" + title.encode("utf-16-be", "replace").hex().upper().encode() + b"> >>")
    kids = []
    for k, page in enumerate(pages):
        shown, y = [], HEIGHT - MARGIN - SIZE + LEADING
        for line, goes_on in page:
            y -= CLOSE if goes_on else LEADING
            if line.strip():
                code = line.encode("utf-16-be", "replace").hex().upper()
                shown.append(f"BT /F1 {SIZE} Tf 1 0 0 1 {MARGIN} {y} Tm <{code}> Tj ET")
        body = zlib.compress("\n".join(shown).encode("latin-1"))
        content = add(b"<< /Filter /FlateDecode /Length %d >>\nstream\n" % len(body) + body + b"\nendstream")
        kids.append(add(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {WIDTH} {HEIGHT}] /Resources << /Font << /F1 3 0 R >> >> /Contents {content} 0 R >>"))
    objects[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    out, places = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + o + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<< /Size %d /Root 1 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, title_id, start)
    return bytes(out)

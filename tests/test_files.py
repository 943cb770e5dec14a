"""Readers, writers, recognition and conversion of files."""

import io
import struct
import zipfile
import zlib

import pytest

from vellumine import convert
from vellumine.sinks import office as sinks
from vellumine.sources import files, office

BLOCKS = [
    office.block(text="제목 One", heading=1),
    office.block(text="plain & <b> text"),
    office.block(text="item", list_kind="bullet"),
    office.block("table", "t", cells=[(0, 0, 1, 2, "wide"), (0, 2, 1, 1, "c"), (1, 0, 2, 1, "tall"), (1, 1, 1, 1, "1.5"), (1, 2, 1, 1, ""), (2, 1, 1, 1, "x"), (2, 2, 1, 1, "y")]),
    office.block(text="after"),
]


def texts(blocks):
    return [b["text"] for b in blocks if b["kind"] == "paragraph" and b["text"].strip()]


@pytest.mark.parametrize("fmt", ["docx", "hwpx", "html"])
def test_spans_survive(fmt):
    got = office.READERS[fmt](sinks.WRITERS[fmt](BLOCKS, "title"))
    assert texts(got) == texts(BLOCKS)
    table = next(b for b in got if b["kind"] == "table")
    want = {c[:4] for c in BLOCKS[3]["cells"]}
    assert {tuple(c[:4]) for c in table["cells"]} == want
    assert office.format_of_content(sinks.WRITERS[fmt](BLOCKS, "")) == (fmt if fmt != "html" else None)


def test_xlsx_merges_and_sheets():
    got = office.read_xlsx(sinks.write_xlsx(BLOCKS))
    assert [b["text"] for b in got] == ["본문", "t"]
    assert (0, 0, 1, 2, "wide") in got[1]["cells"] and (1, 1, 1, 1, "1.5") in got[1]["cells"]


def test_xlsx_widths_and_styles():
    cells = [(0, 0, 1, 1, "가나다라마바"), (1, 0, 1, 1, "x\n" + "y" * 90), (0, 1, 1, 1, "z" * 90), (0, 3, 1, 1, "2"), (400, 4, 1, 1, "beyond"), (0, 5, 1, 1, "")]
    assert sinks.column_widths(cells) == {0: 14, 1: 60, 3: 8}
    assert sinks.column_widths([]) == {}
    data = sinks.write_xlsx([{"kind": "table", "text": "t", "cells": cells, "heading": 0}])
    archive = office.Archive(data)
    sheet = archive.xml("xl/worksheets/sheet1.xml")
    assert [office.local(e.tag) for e in sheet] == ["cols", "sheetData"]
    assert [office.attribute(c, "width") for c in sheet[0]] == ["14", "60", "8"]
    assert {office.attribute(c, "s") for row in sheet[1] for c in row} == {"1"}
    formats = next(e for e in archive.xml("xl/styles.xml") if office.local(e.tag) == "cellXfs")
    assert len(formats) == 2 and office.attribute(formats[1][0], "wrapText") == "1"
    assert {c[:2]: c[4] for c in office.read_xlsx(data)[0]["cells"]}[0, 0] == "가나다라마바"


def test_hwpx_media_type_is_first_and_stored():
    data = sinks.write_hwpx(BLOCKS)
    assert data[30:38] == b"mimetype" and struct.unpack_from("<H", data, 8)[0] == 0 and data[38:57] == b"application/hwp+zip"


def test_markdown_round_trip():
    got = office.read_md(sinks.write_md(BLOCKS))
    assert [b["heading"] for b in got if b["text"].startswith("제목")] == [1]
    assert any(b["list_kind"] == "bullet" and b["text"] == "item" for b in got)
    assert len(next(b for b in got if b["kind"] == "table")["cells"]) == 9
    assert texts(office.read_md(b"# A\n\n```\n# code\n```\n1. one\n"))[0] == "A"


def record(tag, level, payload):
    return struct.pack("<I", tag | level << 10 | min(len(payload), 0xFFF) << 20) + (struct.pack("<I", len(payload)) if len(payload) >= 0xFFF else b"") + payload


def compound(streams):
    """A compound file whose streams all have sectors of their own."""
    streams = {k: v + b"\0" * max(0, 4096 - len(v)) for k, v in streams.items()}
    names = ["Root Entry", "FileHeader", "BodyText", "Section0"]
    body, fat, start = b"", [], {}
    for name, data in streams.items():
        n = -(-len(data) // 512)
        start[name] = len(fat)
        fat += [*range(len(fat) + 1, len(fat) + n), 0xFFFFFFFE]
        body += data + b"\0" * (n * 512 - len(data))
    listing = len(fat)
    fat.append(0xFFFFFFFE)

    def entry(name, kind, right=0xFFFFFFFF, child=0xFFFFFFFF, at=0xFFFFFFFE, size=0):
        raw = (name + "\0").encode("utf-16-le")
        return raw + b"\0" * (64 - len(raw)) + struct.pack("<HBBIII", len(raw), kind, 1, 0xFFFFFFFF, right, child) + b"\0" * 36 + struct.pack("<IQ", at, size)

    sizes = {k: len(v) for k, v in streams.items()}
    body += entry(names[0], 5, child=1) + entry(names[1], 2, right=2, at=start["FileHeader"], size=sizes["FileHeader"]) + entry(names[2], 1, child=3) + entry(names[3], 2, at=start["Section0"], size=sizes["Section0"])
    table = len(fat)
    fat.append(0xFFFFFFFD)
    fat += [0xFFFFFFFF] * (-len(fat) % 128)
    assert len(fat) == 128
    body += struct.pack("<128I", *fat)
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, 1, listing, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", table, *[0xFFFFFFFF] * 108)
    return head + body


@pytest.mark.parametrize("packed", [False, True])
def test_hwp(packed):
    lines = ["한글 문서 변환기", "DocumentConverter\t1,234,567", "", "x" * 5000]
    section = b"".join(record(66, 0, b"\0" * 22) + record(67, 1, b"".join(struct.pack("<H7xx", 9)[:16].ljust(16, b"\0") if c == "\t" else c.encode("utf-16-le") for c in line) + b"\r\0") for line in lines)
    if packed:
        pack = zlib.compressobj(9, zlib.DEFLATED, -15)
        section = pack.compress(section) + pack.flush()
    head = (b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 0x05000300, int(packed))).ljust(256, b"\0")
    data = compound({"FileHeader": head, "Section0": section})
    assert office.format_of_content(data) == "hwp"
    assert [b["text"] for b in office.read_hwp(data)][:4] == lines
    with pytest.raises(office.ReadError):
        office.read_hwp(compound({"FileHeader": head[:36] + b"\x02" + head[37:], "Section0": section}))


def test_records_stop_where_data_ends():
    assert [r[0] for r in office.hwp_records(record(66, 0, b"ab") + record(67, 1, b"c" * 5000)[:40])] == [66]


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in entries.items():
            z.writestr(k, v)
    return out.getvalue()


def test_odt_and_rtf():
    ns = 'xmlns:o="urn:o" xmlns:t="urn:t" xmlns:b="urn:b"'
    odt = archive({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": f'<o:d {ns}><o:body><o:text><t:h t:outline-level="2">H</t:h><t:p>a<t:s t:c="2"/>b<t:line-break/>c</t:p><t:list><t:list-item><t:p>i</t:p></t:list-item></t:list></o:text></o:body></o:d>'})
    got = office.read_odt(odt)
    assert [(b["text"], b["heading"], b["list_kind"]) for b in got] == [("H", 2, "none"), ("a  b\nc", 0, "none"), ("i", 0, "bullet")]
    assert office.format_of_content(odt) == "odt"
    rtf = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\x hidden}Hello \b bold\b0\par caf\u233?\par \'b0\'a1 \{x\}}"
    assert [b["text"] for b in office.read_rtf(rtf)] == ["Hello bold", "café", "가 {x}"]


@pytest.mark.parametrize("entries", [{"../x": "a", "word/document.xml": "<a/>"}, {"word/document.xml": "<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>"}, {"word/document.xml": "<a>"}, {"other": ""}])
def test_unsafe_archives(entries):
    with pytest.raises(office.ReadError):
        office.read_docx(archive(entries))


def test_csv_and_encodings():
    data = "이름;값\r\n\"a;b\";1\r\nlonger row;2;3\r\n;;\r\n".encode("cp949")
    cells = office.read_csv(data)[0]["cells"]
    assert [c[4] for c in cells] == ["이름", "값", "", "a;b", "1", "", "longer row", "2", "3"]
    assert office.encoding_of("가나다라마바사 문서".encode("cp949")) == "cp949" and office.encoding_of(b"plain") == "utf-8-sig"


def test_convert_folder(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    (tmp_path / "in/a.docx").write_bytes(sinks.write_docx(BLOCKS))
    (tmp_path / "in/sub/b.dat").write_bytes(sinks.write_hwpx(BLOCKS))
    (tmp_path / "in/c.md").write_text("# T\n\ntext\n")
    (tmp_path / "in/bad.docx").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "in/e.xyz").write_bytes(b"what")
    got = {r["path"].rpartition("/")[2]: r for r in files.convert(files.scan(spark, str(tmp_path / "in")), "txt").collect()}
    assert {k: r["format"] for k, r in got.items()} == {"a.docx": "docx", "b.dat": "hwpx", "c.md": "md", "bad.docx": "docx", "e.xyz": None}
    assert {k for k, r in got.items() if r["error"]} == {"bad.docx", "e.xyz"}
    assert "plain & <b> text" in bytes(got["b.dat"]["output"]).decode()
    for _ in range(2):
        done = convert.save(files.convert(files.scan(spark, str(tmp_path / "in")), "md"), str(tmp_path / "out"), "md").collect()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a (1).md", "a.md", "b (1).md", "b.md", "c (1).md", "c.md"]
    assert sum(r["error"] is not None for r in done) == 2


RICH = [
    office.block(heading=2, runs=[office.run("Bold", bold=True), office.run(" head", italic=True)]),
    office.block(align="center", runs=[office.run("plain "), office.run("red", colour="C81E1E", size=15.0), office.run(" under", underline=True), office.run(" gone", strike=True), office.run("2", script="super"), office.run(" both", bold=True, italic=True)]),
    office.block(text="end"),
]
PNG = b"\x89PNG\r\n\x1a\n" + b"data" * 20


@pytest.mark.parametrize("fmt", ["docx", "hwpx"])
def test_runs_survive(fmt):
    got = office.READERS[fmt](sinks.WRITERS[fmt]([*RICH, office.block("image", "p.png", image=PNG)], "t"))
    assert [b["runs"] for b in got[:3]] == [b["runs"] for b in RICH]
    assert [(b["heading"], b["align"]) for b in got[:3]] == [(2, "left"), (0, "center"), (0, "left")]
    assert [b["image"] for b in got if b["kind"] == "image"] == [PNG]


def test_hwpx_styles_all_resolve():
    import re

    data = zipfile.ZipFile(io.BytesIO(sinks.write_hwpx(RICH)))
    header, section = (data.read(f"Contents/{n}.xml").decode() for n in ("header", "section0"))
    for kind in ("char", "para"):
        known = re.findall(rf'<hh:{kind}Pr id="(\d+)"', header)
        assert known == [str(i) for i in range(len(known))] and set(re.findall(rf'{kind}PrIDRef="(\d+)"', section)) <= set(known)
    wave = header.replace('type="BOTTOM" shape="SOLID"', 'type="WAVE" shape="SOLID"').replace('shape="SOLID"/>', 'shape="3D"/>')
    entries = {n: data.read(n) for n in data.namelist()} | {"Contents/header.xml": wave}
    assert not any(r["underline"] or r["strike"] for b in office.read_hwpx(archive(entries)) for r in b["runs"])


def test_links_and_inline_marks():
    runs = [office.run("see "), office.run("here", href="https://a.example/?x=1&y=2"), office.run(" or "), office.run("not", bold=True)]
    for fmt in ("docx", "html", "md"):
        got = office.READERS[fmt](sinks.WRITERS[fmt]([office.block(runs=runs)], ""))
        assert [b["runs"] for b in got if b["text"].strip()] == [runs]
    got = office.read_html(b"<p>a <b>b<i>c</i></b> <code>d</code><br>e <a href='/u'>f</a><sub>g</sub></p>")[0]
    assert got["text"] == "a bc d\ne fg" and [(r["text"], r["bold"], r["italic"], r["font"], r["href"], r["script"]) for r in got["runs"]] == [
        ("a ", False, False, "", "", ""), ("b", True, False, "", "", ""), ("c", True, True, "", "", ""), (" ", False, False, "", "", ""), ("d", False, False, "Consolas", "", ""), ("\ne ", False, False, "", "", ""), ("f", False, False, "", "/u", ""), ("g", False, False, "", "", "sub")]
    assert office.read_md(b"[t]() and snake_case_name * 2")[0]["runs"] == []


def test_docx_nested_tables_controls_and_highlight():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, pr="": f"<w:p><w:r>{pr}<w:t>{t}</w:t></w:r></w:p>"
    inner = f"<w:tbl><w:tr><w:tc>{p('x')}</w:tc><w:tc>{p('y')}</w:tc></w:tr></w:tbl>"
    body = f"<w:sdt><w:sdtContent>{p('in control')}</w:sdtContent></w:sdt>{p('m', '<w:rPr><w:highlight w:val=%sgreen%s/></w:rPr>' % (chr(34), chr(34)))}<w:tbl><w:tr><w:tc>{p('a')}{inner}{p('b')}</w:tc></w:tr></w:tbl>"
    got = office.read_docx(archive({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"}))
    assert [b["text"] for b in got] == ["in control", "m", ""] and got[1]["runs"][0]["highlight"] == "FFFF00"
    assert got[2]["cells"] == [(0, 0, 1, 1, "a\nx\ty\nb")]


def test_xlsx_dates_hidden_sheets_and_row_cap():
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rows = '<row r="1"><c r="A1" s="1"><v>45292</v></c><c r="B1" s="2"><v>45292.5</v></c><c r="C1" s="1"><v>0.25</v></c><c r="D1" s="3"><v>45292</v></c><c r="E1" t="e"><v>#N/A</v></c></row><row r="2"><c r="A2"><v>2</v></c></row><row r="3"><c r="A3"><v>3</v></c></row>'
    data = archive({
        "xl/workbook.xml": f'<workbook {m}><sheets><sheet name="a" r:id="rId1"/><sheet name="b" state="hidden" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/s.xml"/></Relationships>',
        "xl/worksheets/s.xml": f"<worksheet {m}><sheetData>{rows}</sheetData></worksheet>",
        "xl/styles.xml": f'<styleSheet {m}><numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;x&quot;mm"/><numFmt numFmtId="171" formatCode="[Red]0.00&quot;day&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>',
    })
    asked = office.Options(max_rows=2)
    got = office.read_xlsx(data, asked)
    assert [c[4] for c in got[0]["cells"]] == ["2024-01-01", "2024-01-01 12:00:00", "06:00:00", "45292", "#ERROR", "2"]
    assert len(got) == 1 and len(asked.warnings) == 1
    assert len(office.read_xlsx(data, office.Options(hidden_sheets=True))) == 2


def test_hwp_tables():
    text = lambda s: s.encode("utf-16-le") + b"\r\0"
    cell = lambda c, r, w=1, h=1: struct.pack("<IIHHHH", 1, 32, c, r, w, h) + b"\0" * 31
    para = lambda level, s: record(66, level, b"\0" * 22) + record(67, level + 1, text(s))
    section = para(0, "before") + record(71, 1, b" lbt") + record(77, 2, struct.pack("<IHH", 0, 2, 2) + b"\0" * 10)
    section += record(72, 2, cell(0, 0, 2)) + para(2, "wide") + para(2, "more") + record(72, 2, cell(0, 1)) + para(2, "l") + record(72, 2, cell(0, 1)) + para(2, "r") + para(0, "after")
    got = office.hwp_section(section)
    assert [(b["kind"], b["text"]) for b in got] == [("paragraph", "before"), ("table", ""), ("paragraph", "after")]
    assert got[1]["cells"] == [(0, 0, 1, 2, "wide\nmore"), (1, 0, 1, 1, "l"), (1, 0, 1, 1, "r")] or got[1]["cells"][2][:2] == (1, 0)
    fixed = bytes.fromhex("010000002000000001000000010001009b2d0000") + b"\0" * 27
    assert struct.unpack_from("<HHHH", fixed, 8) == (1, 0, 1, 1)


def test_odt_round_trip():
    got = office.read_odt(sinks.write_odt(BLOCKS))
    assert texts(got) == texts(BLOCKS) and got[0]["heading"] == 1 and got[2]["list_kind"] == "bullet"
    assert {c[:4] for c in next(b for b in got if b["kind"] == "table")["cells"]} == {c[:4] for c in BLOCKS[3]["cells"]}


def test_pdf_round_trip():
    from vellumine.sources.pdf import page_range, read_pdf

    lines = ["문서 변환기 DocumentConverter", "", "가나다라마바사 1,234,567", "", " ".join(["word"] * 60)]
    blocks = [office.block(text=t) for t in lines] + [office.block("page_break"), office.block(text="second (page) \\ 100%")]
    data = sinks.write_pdf(blocks, "제목")
    assert office.format_of_content(data) == "pdf" and len(data) < 20_000
    got = read_pdf(data)
    assert [b["text"] for b in got if b["kind"] == "paragraph"] == [lines[0], lines[2], lines[4], "second (page) \\ 100%"]
    assert [b["kind"] for b in got].count("page_break") == 1
    assert [b["text"] for b in read_pdf(data, office.Options(pages="2"))] == ["second (page) \\ 100%"]
    asked = office.Options()
    assert read_pdf(sinks.write_pdf([], ""), asked) == [] and asked.warnings
    assert page_range("1-2,9,2-", 4) == [0, 1, 2, 3]
    with pytest.raises(office.ReadError):
        read_pdf(b"nothing")
    assert len(sinks.write_pdf([office.block(text=str(i)) for i in range(200)]).split(b"/Type /Page ")) == 6


def test_pdf_fonts_object_streams_and_headings():
    from vellumine.sources.pdf import read_pdf

    cmap = b"1 beginbfrange <01> <03> <0041> endbfrange 1 beginbfchar <04> <AC00> endbfchar"
    shown = b"BT /F1 20 Tf 1 0 0 1 50 700 Tm <010203> Tj ET BT /F2 10 Tf 50 650 Td (Plain te) Tj (xt with hy-) Tj 0 -12 Td [(phen and \\(more\\)) -300 (words)] TJ T* ET BT /F1 10 Tf 50 500 Td <04> Tj ET"
    inner = b"1 0 2 37 << /Type /Catalog /Pages 2 0 R >>"
    objects = b"<< /Type /Catalog /Pages 2 0 R >>    << /Type /Pages /Kids [3 0 R] /Count 1 >>"
    head = b"1 0 2 37 "
    packed = zlib.compress(head + objects)
    data = b"%PDF-1.5\n"
    data += b"9 0 obj << /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >> stream\n" % (len(head), len(packed)) + packed + b"\nendstream endobj\n"
    data += b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >> endobj\n"
    data += b"4 0 obj << /Length %d >> stream\n" % len(shown) + shown + b"\nendstream endobj\n"
    data += b"5 0 obj << /Type /Font /Subtype /Type1 /ToUnicode 7 0 R >> endobj 6 0 obj << /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >> endobj\n"
    data += b"7 0 obj << /Length %d >> stream\n" % len(cmap) + cmap + b"\nendstream endobj\ntrailer << /Root 1 0 R >>"
    got = read_pdf(data)
    assert [(b["text"], b["heading"]) for b in got] == [("ABC", 1), ("Plain text with hyphen and (more) words", 0), ("가", 0)]
    with pytest.raises(office.ReadError):
        read_pdf(data.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 8 0 R"))


def test_two_files_of_one_stem_options_and_identity(spark, tmp_path):
    for d in ("x", "y", "out"):
        (tmp_path / d).mkdir()
    (tmp_path / "x/a.csv").write_text("1|2\n3|4\n")
    (tmp_path / "y/a.csv").write_text("5|6\n")
    (tmp_path / "y/b.md").write_text("*as it is*")
    (tmp_path / "y/c.bin").write_text("?")
    found = files.scan(spark, [str(tmp_path / "x"), str(tmp_path / "y")], known_only=True)
    done = convert.save(files.convert(found, "md", delimiter="|"), str(tmp_path / "out"), "md").collect()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a (1).md", "a.md", "b.md"] and len(done) == 3
    assert (tmp_path / "out/b.md").read_text() == "*as it is*" and "| 3 | 4 |" in (tmp_path / "out/a.md").read_text()
    assert "Exchange" not in files.convert(found, "md")._jdf.queryExecution().executedPlan().toString()


def test_public_names(spark):
    import vellumine

    assert all(getattr(vellumine, n) is not None for n in vellumine.__all__)
    able = {r["format"]: (r["reads"], r["writes"]) for r in vellumine.diagnose(spark).collect()}
    assert able["pdf"] == (True, True) and able["hwp"] == (True, False) and able["doc"] == (False, False)


def book(streams):
    """A compound file with one stream in its root."""
    (name, body), = streams.items()
    body = body + b"\0" * max(0, 4096 - len(body))
    n = -(-len(body) // 512)
    fat = [*range(1, n), 0xFFFFFFFE, 0xFFFFFFFE, 0xFFFFFFFD]
    fat += [0xFFFFFFFF] * (-len(fat) % 128)
    raw = lambda s: (s + "\0").encode("utf-16-le")
    entry = lambda s, kind, child, at, size: raw(s).ljust(64, b"\0") + struct.pack("<HBBIII", len(raw(s)), kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, child) + b"\0" * 36 + struct.pack("<IQ", at, size)
    listing = (entry("Root Entry", 5, 1, 0xFFFFFFFE, 0) + entry(name, 2, 0xFFFFFFFF, 0, len(body))).ljust(512, b"\0")
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, 1, n, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", n + 1, *[0xFFFFFFFF] * 108)
    return head + body.ljust(n * 512, b"\0") + listing + struct.pack(f"<{len(fat)}I", *fat)


def test_xls():
    from vellumine.sources.xls import read_xls, rk_value

    rec = lambda n, b: struct.pack("<HH", n, len(b)) + b
    text = lambda t: struct.pack("<HB", len(t), 1) + t.encode("utf-16-le")
    bof, eof = rec(0x809, struct.pack("<HH", 0x600, 5) + b"\0" * 12), rec(0x0A, b"")
    shared = struct.pack("<II", 3, 3) + text("이름") + text("ab")
    split = struct.pack("<HB", 6, 0) + b"xyz"
    head = bof + rec(0x41E, struct.pack("<H", 170) + text("yyyy-mm")) + rec(0xE0, struct.pack("<HH", 0, 0) + b"\0" * 16) + rec(0xE0, struct.pack("<HH", 0, 170) + b"\0" * 16) + rec(0xFC, shared + split) + rec(0x3C, b"\x01" + "가나다".encode("utf-16-le"))
    cells = rec(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + rec(0xFD, struct.pack("<HHHI", 0, 1, 0, 2)) + rec(0x203, struct.pack("<HHHd", 1, 0, 1, 45292.0)) + rec(0x27E, struct.pack("<HHHI", 1, 1, 0, 125 << 2 | 3))
    cells += rec(0xBD, struct.pack("<HHHIHIH", 2, 0, 0, 7 << 2 | 2, 0, 8 << 2 | 2, 1)) + rec(0x205, struct.pack("<HHHBB", 3, 0, 0, 1, 0)) + rec(0x205, struct.pack("<HHHBB", 3, 1, 0, 42, 1))
    cells += rec(0x06, struct.pack("<HHH", 4, 0, 0) + b"\0" * 6 + b"\xff\xff" + b"\0" * 8) + rec(0x207, text("made")) + rec(0xE5, struct.pack("<HHHHH", 1, 3, 3, 0, 1))
    sheet = bof + cells + eof
    bound = lambda at, state, name: rec(0x85, struct.pack("<IBBBB", at, state, 0, len(name), 0) + name)
    size = len(head) + len(bound(0, 0, b"one")) + len(bound(0, 1, b"two")) + len(eof)
    data = book({"Workbook": head + bound(size, 0, b"one") + bound(size, 1, b"two") + eof + sheet})
    assert office.format_of_content(data) == "xls"
    got = read_xls(data)
    assert [b["text"] for b in got] == ["one", "two"]
    assert got[0]["cells"] == [(0, 0, 1, 1, "이름"), (0, 1, 1, 1, "xyz가나다"), (1, 0, 1, 1, "2024-01-01"), (1, 1, 1, 1, "1.25"), (2, 0, 1, 1, "7"), (2, 1, 1, 1, "8"), (3, 0, 1, 2, "TRUE"), (4, 0, 1, 1, "made")]
    assert rk_value(struct.unpack("<I", struct.pack("<d", 1.5)[4:])[0]) == 1.5 and rk_value((-3 << 2 | 2) & 0xFFFFFFFF) == -3
    asked = office.Options(max_rows=2)
    assert len(read_xls(data, asked)[0]["cells"]) == 4 and len(asked.warnings) == 2
    with pytest.raises(office.ReadError):
        read_xls(book({"Workbook": bof + rec(0x2F, b"\0" * 6) + eof}))


def test_properties(spark):
    docx, hwpx = sinks.write_docx(BLOCKS, "A & 제목"), sinks.write_hwpx(BLOCKS, "Title")
    page = '<hs:sec xmlns:hs="s" xmlns:hp="p"><hp:p><hp:run><hp:secPr><hp:pagePr width="59528" height="84188"><hp:margin left="8504" right="8504" top="5668" bottom="4252"/></hp:pagePr></hp:secPr></hp:run></hp:p></hs:sec>'
    z = zipfile.ZipFile(io.BytesIO(hwpx))
    hwpx = archive({n: z.read(n) for n in z.namelist()} | {"Contents/section0.xml": page})
    df = spark.createDataFrame([("a", docx, "docx"), ("b", hwpx, "hwpx"), ("c", b"x", "docx"), ("d", None, None)], "path string, content binary, format string")
    got = {r["path"]: r for r in files.properties(df).collect()}
    assert got["a"]["title"] == "A & 제목" and got["a"]["page_width"] == 595.3 and got["a"]["margin_left"] == 72
    assert got["b"]["title"] == "Title" and got["b"]["page_height"] == 841.88 and got["b"]["margin_bottom"] == 42.52
    assert got["c"]["title"] is None and got["d"]["page_width"] is None


def test_hwp_run_styles():
    shape = lambda marks, size, colour: record(21, 0, b"\0" * 42 + struct.pack("<iI", size, marks) + b"\0\0" + bytes.fromhex(colour) + b"\0" * 20)
    shapes = office.hwp_shapes(shape(0, 1000, "000000") + shape(2 | 1 << 2, 1500, "C81E1E"))
    text = "ab".encode("utf-16-le") + struct.pack("<H7xx", 9)[:16].ljust(16, b"\0") + "한cd".encode("utf-16-le") + b"\r\0"
    section = record(66, 0, b"\0" * 22) + record(67, 1, text) + record(68, 1, struct.pack("<IIII", 10, 1, 0, 0)) + record(66, 0, b"") + record(67, 1, "x".encode("utf-16-le"))
    got = office.hwp_section(section, shapes)
    assert [b["text"] for b in got] == ["ab\t한cd", "x"]
    assert [(r["text"], r["bold"], r["underline"], r["size"], r["colour"]) for r in got[0]["runs"]] == [("ab\t", False, False, 0.0, ""), ("한cd", True, True, 15.0, "C81E1E")]

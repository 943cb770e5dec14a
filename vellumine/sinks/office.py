"""Writers: blocks to the bytes of a file, with the standard library only."""

from __future__ import annotations

import base64
import csv
import io
import json
import re
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape, quoteattr

from vellumine.sinks.pdf import write_pdf
from vellumine.sources.runs import PLAIN, Block, picture_kind, run, runs_of

_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]")


def _xml(text: str) -> str:
    return escape(_ILLEGAL.sub("", text))


def _grid(b: Block) -> list[list[str]]:
    rows, cols = max((c[0] + c[2] for c in b["cells"]), default=0), max((c[1] + c[3] for c in b["cells"]), default=0)
    grid = [[""] * cols for _ in range(rows)]
    for r, c, *_, text in b["cells"]:
        grid[r][c] = text
    return grid


def _archive(entries: list[tuple[str, str | bytes]], stored: tuple[str, ...] = ()) -> bytes:
    """Entries in order; the ``stored`` ones are not compressed. Times are fixed, so equal input gives equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries:
            info = zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED
            z.writestr(info, text)
    return out.getvalue()


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_OOXML, _PACKAGE = "http://schemas.openxmlformats.org", "http://schemas.openxmlformats.org/package/2006"
_PICTURE = f"{_OOXML}/drawingml/2006/picture"


def _relations(pairs: list[tuple[str, str, str]]) -> str:
    mode = lambda t: ' TargetMode="External"' if t == "hyperlink" else ""
    rows = "".join(f'<Relationship Id="{i}" Type="{_OOXML}/officeDocument/2006/relationships/{t}" Target={quoteattr(_ILLEGAL.sub("", x))}{mode(t)}/>' for i, t, x in pairs)
    return f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{rows}</Relationships>'


def _types(parts: list[tuple[str, str]], core: bool = False) -> str:
    rows = "".join(f'<Override PartName="{p}" ContentType="application/vnd.openxmlformats-officedocument.{t}+xml"/>' for p, t in parts)
    properties = '<Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/>' * core
    return f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{"".join(f'<Default Extension="{k}" ContentType="image/{k}"/>' for k in ("png", "jpeg", "gif", "bmp"))}{rows}{properties}</Types>'


def write_docx(blocks: list[Block], title: str = "") -> bytes:
    rels: list[tuple[str, str, str]] = [("rId1", "styles", "styles.xml")]
    media: list[tuple[str, bytes]] = []

    def related(kind: str, target: str) -> str:
        rels.append((f"rId{len(rels) + 1}", kind, target))
        return rels[-1][0]

    def style(r: dict) -> str:
        font = quoteattr(r["font"])
        return "".join(
            (
                f"<w:rFonts w:ascii={font} w:hAnsi={font} w:eastAsia={font} w:cs={font}/>" * bool(r["font"]),
                "<w:b/>" * r["bold"],
                "<w:i/>" * r["italic"],
                "<w:strike/>" * r["strike"],
                f'<w:color w:val="{r["colour"]}"/>' * bool(r["colour"]),
                f'<w:sz w:val="{round(r["size"] * 2)}"/>' * (r["size"] > 0),
                '<w:highlight w:val="yellow"/>' * bool(r["highlight"]),
                '<w:u w:val="single"/>' * r["underline"],
                f'<w:vertAlign w:val="{r["script"]}script"/>' * bool(r["script"]),
            )
        )

    def text_run(r: dict) -> str:
        parts = re.split("([\n\t])", r["text"])
        pr = f"<w:rPr>{style(r)}</w:rPr>" if style(r) else ""
        inner = "".join("<w:br/>" if p == "\n" else "<w:tab/>" if p == "\t" else f'<w:t xml:space="preserve">{_xml(p)}</w:t>' for p in parts if p)
        whole = f"<w:r>{pr}{inner}</w:r>" if r["text"] else ""
        return f'<w:hyperlink r:id="{related("hyperlink", r["href"])}">{whole}</w:hyperlink>' if r["href"] and whole else whole

    def paragraph(b: Block) -> str:
        pr = f'<w:pStyle w:val="Heading{b["heading"]}"/>' if b["heading"] else ""
        pr += f'<w:numPr><w:ilvl w:val="{b["level"]}"/><w:numId w:val="1"/></w:numPr>' if b["list_kind"] != "none" else ""
        jc = {"justify": "both"}.get(b.get("align", "left"), b.get("align", "left"))
        pr += f'<w:jc w:val="{jc}"/>' if jc != "left" else ""
        return f"<w:p><w:pPr>{pr}</w:pPr>{''.join(map(text_run, runs_of(b)))}</w:p>"

    def picture(b: Block) -> str:
        kind, n = picture_kind(b["image"]), len(media) + 1
        media.append((f"word/media/image{n}.{kind}", b["image"]))
        name, fit = quoteattr(_ILLEGAL.sub("", b["text"]) or f"image{n}"), 'cx="2880000" cy="2160000"'
        fill = f'<pic:blipFill><a:blip r:embed="{related("image", f"media/image{n}.{kind}")}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>'
        shape = f'<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext {fit}/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr>'
        data = f'<a:graphicData uri="{_PICTURE}"><pic:pic><pic:nvPicPr><pic:cNvPr id="{n}" name={name}/><pic:cNvPicPr/></pic:nvPicPr>{fill}{shape}</pic:pic></a:graphicData>'
        return f'<w:p><w:r><w:drawing><wp:inline><wp:extent {fit}/><wp:docPr id="{n}" name={name}/><a:graphic>{data}</a:graphic></wp:inline></w:drawing></w:r></w:p>'

    def table(b: Block) -> str:
        at = {(r, c): (rs, cs, t) for r, c, rs, cs, t in b["cells"]}
        under = {(r + i, c): cs for (r, c), (rs, cs, _) in at.items() for i in range(1, rs)}
        rows = max((c[0] + c[2] for c in b["cells"]), default=0)
        out = []
        for r in range(rows):
            line = []
            for c in sorted({k[1] for k in (*at, *under) if k[0] == r}):
                rs, cs, text = at.get((r, c), (1, under.get((r, c), 1), ""))
                merge = '<w:vMerge w:val="restart"/>' if rs > 1 else "<w:vMerge/>" if (r, c) in under else ""
                span = f'<w:gridSpan w:val="{cs}"/>' if cs > 1 else ""
                line.append(f"<w:tc><w:tcPr>{span}{merge}</w:tcPr>" + "".join(f"<w:p>{text_run(run(t))}</w:p>" for t in (text.split("\n") if text else [""])) + "</w:tc>")
            out.append(f"<w:tr>{''.join(line)}</w:tr>")
        return f"<w:tbl>{''.join(out)}</w:tbl>"

    body = []
    for b in blocks:
        if b["kind"] == "paragraph":
            body.append(paragraph(b))
        elif b["kind"] == "table":
            body.append(table(b))
        elif b["kind"] == "page_break":
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        elif b.get("image"):
            body.append(picture(b))
        else:
            body.append(paragraph(b | {"text": f"[그림: {b['text'] or 'image'}]", "heading": 0, "list_kind": "none"}))
    space = f'xmlns:w="{_OOXML}/wordprocessingml/2006/main" xmlns:r="{_OOXML}/officeDocument/2006/relationships" xmlns:wp="{_OOXML}/drawingml/2006/wordprocessingDrawing" xmlns:a="{_OOXML}/drawingml/2006/main" xmlns:pic="{_PICTURE}"'
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{n}"><w:name w:val="heading {n}"/></w:style>' for n in range(1, 10))
    return _archive(
        [
            ("[Content_Types].xml", _types([("/word/document.xml", "wordprocessingml.document.main"), ("/word/styles.xml", "wordprocessingml.styles")], core=True)),
            ("_rels/.rels", _relations([("rId1", "officeDocument", "word/document.xml")]).replace("</Relationships>", f'<Relationship Id="rId2" Type="{_PACKAGE}/relationships/metadata/core-properties" Target="docProps/core.xml"/></Relationships>')),
            ("word/_rels/document.xml.rels", _relations(rels)),
            ("word/document.xml", f"{_HEAD}<w:document {space}><w:body>{''.join(body)}<w:sectPr><w:pgSz w:w=\"11906\" w:h=\"16838\"/><w:pgMar w:top=\"1440\" w:right=\"1440\" w:bottom=\"1440\" w:left=\"1440\" w:header=\"720\" w:footer=\"720\" w:gutter=\"0\"/></w:sectPr></w:body></w:document>"),
            ("docProps/core.xml", f'{_HEAD}<cp:coreProperties xmlns:cp="{_PACKAGE}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{_xml(title[:255])}</dc:title></cp:coreProperties>'),
            ("word/styles.xml", f"{_HEAD}<w:styles {space}>{styles}</w:styles>"),
            *media,
        ]
    )


# Fixed values of column widths: rows looked at, the code point beyond which a character is wide, the least and the most.
WIDTH_ROWS = 400
WIDE_FROM = "\u1100"
COLUMN_WIDTHS = (8, 60)


def _letters(c: int) -> str:
    out = ""
    c += 1
    while c:
        c, k = divmod(c - 1, 26)
        out = chr(65 + k) + out
    return out


def sheets_of(blocks: list[Block], body: str = "본문") -> list[tuple[str, Block]]:
    """The paragraphs as one sheet, then each table as its own; names are unique."""
    lines, tables = [], []
    for b in blocks:
        if b["kind"] == "table":
            tables.append((b["text"] or f"표{len(tables) + 1}", b))
            lines.append(f"[표 {len(tables)}: {tables[-1][0]}]")
        elif b["kind"] == "paragraph":
            lines.append(f"{'#' * b['heading']} {b['text']}".strip() if b["heading"] else b["text"])
        else:
            lines.append("" if b["kind"] == "page_break" else f"[그림: {b['text'] or 'image'}]")
    out = []
    if any(b["kind"] == "paragraph" and b["text"].strip() for b in blocks):
        out.append((body, {"cells": [(r, 0, 1, 1, t) for r, t in enumerate(lines)]}))
    seen: dict[str, int] = {}
    named = []
    for name, b in out + tables or [("Sheet1", {"cells": []})]:
        name = re.sub(r"[\[\]:*?/\\]", "_", name.replace("\n", " ").replace("\r", " ")).strip().strip("'")[:31] or "Sheet"
        seen[name] = n = seen.get(name, 0) + 1
        named.append((name if n == 1 else f"{name[: 31 - len(f'_{n}')]}_{n}", b))
    return named


def column_widths(cells: list[tuple]) -> dict[int, int]:
    """Widths in characters by the first lines of the cells in the first ``WIDTH_ROWS`` rows; East Asian ones count twice."""
    longest: dict[int, int] = {}
    for r, c, *_, text in cells:
        if r < WIDTH_ROWS and text:
            line = text.partition("\n")[0]
            longest[c] = max(longest.get(c, 0), len(line) + sum(x > WIDE_FROM for x in line))
    least, most = COLUMN_WIDTHS
    return {c: min(most, max(least, n + 2)) for c, n in sorted(longest.items()) if n}


def write_xlsx(blocks: list[Block], title: str = "") -> bytes:
    """Sheets with numbers as numbers, merges, column widths, and wrapped cells in thin borders where they hold text."""
    sheets = sheets_of(blocks)
    main = f'xmlns="{_OOXML}/spreadsheetml/2006/main"'
    side = "".join(f'<{k} style="thin"><color rgb="FFD0D0D0"/></{k}>' for k in ("left", "right", "top", "bottom"))
    cell = '<xf numFmtId="0" fontId="0" fillId="0" borderId="{}" xfId="0"{}>{}</xf>'
    plain, wrapped = cell.format(0, "", ""), cell.format(1, ' applyBorder="1" applyAlignment="1"', '<alignment vertical="top" wrapText="1"/>')
    styles = (
        f'{_HEAD}<styleSheet {main}><fonts count="1"><font><sz val="11"/><name val="Calibri"/></font></fonts>'
        '<fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills>'
        f'<borders count="2"><border><left/><right/><top/><bottom/><diagonal/></border><border>{side}<diagonal/></border></borders>'
        '<cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>'
        f'<cellXfs count="2">{plain}{wrapped}</cellXfs></styleSheet>'
    )

    def sheet(b: Block) -> str:
        by_row: dict[int, list[str]] = {}
        for r, c, _, _, text in sorted(b["cells"]):
            ref = f"{_letters(c)}{r + 1}"
            if re.fullmatch(r"-?(0|[1-9][0-9]{0,14})(\.[0-9]{1,10})?", text):
                by_row.setdefault(r, []).append(f'<c r="{ref}" s="1"><v>{text}</v></c>')
            elif text:
                by_row.setdefault(r, []).append(f'<c r="{ref}" s="1" t="inlineStr"><is><t xml:space="preserve">{_xml(text)}</t></is></c>')
        rows = "".join(f'<row r="{r + 1}">{"".join(cs)}</row>' for r, cs in sorted(by_row.items()))
        merged = [f"{_letters(c)}{r + 1}:{_letters(c + cs - 1)}{r + rs}" for r, c, rs, cs, _ in b["cells"] if rs > 1 or cs > 1]
        tail = f'<mergeCells count="{len(merged)}">{"".join(f"<mergeCell ref={chr(34)}{m}{chr(34)}/>" for m in merged)}</mergeCells>' if merged else ""
        widths = "".join(f'<col min="{c + 1}" max="{c + 1}" width="{w}" customWidth="1"/>' for c, w in column_widths(b["cells"]).items())
        return f"{_HEAD}<worksheet {main}>{f'<cols>{widths}</cols>' if widths else ''}<sheetData>{rows}</sheetData>{tail}</worksheet>"

    n = range(1, len(sheets) + 1)
    rel = f'xmlns:r="{_OOXML}/officeDocument/2006/relationships"'
    listed = "".join(f'<sheet name={quoteattr(_ILLEGAL.sub("", name))} sheetId="{i}" r:id="rId{i}"/>' for i, (name, _) in zip(n, sheets, strict=True))
    return _archive(
        [
            ("[Content_Types].xml", _types([("/xl/workbook.xml", "spreadsheetml.sheet.main"), ("/xl/styles.xml", "spreadsheetml.styles"), *((f"/xl/worksheets/sheet{i}.xml", "spreadsheetml.worksheet") for i in n)])),
            ("_rels/.rels", _relations([("rId1", "officeDocument", "xl/workbook.xml")])),
            ("xl/_rels/workbook.xml.rels", _relations([*((f"rId{i}", "worksheet", f"worksheets/sheet{i}.xml") for i in n), (f"rId{len(sheets) + 1}", "styles", "styles.xml")])),
            ("xl/styles.xml", styles),
            ("xl/workbook.xml", f"{_HEAD}<workbook {main} {rel}><sheets>{listed}</sheets></workbook>"),
            *((f"xl/worksheets/sheet{i}.xml", sheet(b)) for i, (_, b) in zip(n, sheets, strict=True)),
        ]
    )


def write_hwpx(blocks: list[Block], title: str = "") -> bytes:
    """The open Hangul package; its media type comes first and uncompressed.

    Run styles and paragraph styles are numbered in the order in which they are first
    seen; number 0 is the plain one. The header holds them, so no id is left dangling.
    """
    plain = {k: v for k, v in PLAIN.items() if k not in ("text", "href", "font", "highlight")}
    chars: dict[tuple, int] = {tuple(plain.values()): 0}
    paras: dict[tuple[str, int], int] = {("left", 0): 0}
    media: list[tuple[str, bytes]] = []

    def text(t: str) -> str:
        return "<hp:t>" + _xml(t).replace("\t", "<hp:tab/>").replace("\n", "<hp:lineBreak/>") + "</hp:t>"

    def text_run(r: dict) -> str:
        n = chars.setdefault(tuple(r[k] for k in plain), len(chars))
        return f'<hp:run charPrIDRef="{n}">{text(r["text"])}</hp:run>'

    def paragraph(inner: str, brk: bool = False, para: int = 0) -> str:
        return f'<hp:p pageBreak="{int(brk)}" paraPrIDRef="{para}" styleIDRef="0">{inner}</hp:p>'

    def table(b: Block) -> str:
        rows: dict[int, list[str]] = {}
        for r, c, rs, cs, t in sorted(b["cells"]):
            inner = "".join(paragraph(text_run(run(x))) for x in t.split("\n"))
            rows.setdefault(r, []).append(f'<hp:tc><hp:subList>{inner}</hp:subList><hp:cellAddr colAddr="{c}" rowAddr="{r}"/><hp:cellSpan colSpan="{cs}" rowSpan="{rs}"/></hp:tc>')
        return '<hp:run charPrIDRef="0"><hp:tbl>' + "".join(f"<hp:tr>{''.join(x)}</hp:tr>" for _, x in sorted(rows.items())) + "</hp:tbl></hp:run>"

    def picture(b: Block) -> str:
        media.append((f"BinData/image{len(media) + 1}.{picture_kind(b['image'])}", b["image"]))
        return f'<hp:run charPrIDRef="0"><hp:pic><hc:img binaryItemIDRef="image{len(media)}"/></hp:pic></hp:run>'

    out, brk = [], False
    for b in blocks:
        if b["kind"] == "page_break":
            brk = True
            continue
        para = 0
        if b["kind"] == "table":
            inner = table(b)
        elif b["kind"] == "paragraph":
            inner = "".join(map(text_run, runs_of(b))) or text_run(run(""))
            para = paras.setdefault((b.get("align") or "left", b["heading"]), len(paras))
        else:
            inner = picture(b) if b.get("image") else text_run(run(f"[그림: {b['text'] or 'image'}]"))
        out.append(paragraph(inner, brk, para))
        brk = False

    def char(values: tuple, n: int) -> str:
        v = dict(zip(plain, values, strict=True))
        marks = "<hh:bold/>" * v["bold"] + "<hh:italic/>" * v["italic"]
        marks += f'<hh:underline type="{"BOTTOM" if v["underline"] else "NONE"}" shape="SOLID"/><hh:strikeout shape="{"SOLID" if v["strike"] else "NONE"}"/>'
        marks += {"super": "<hh:supscript/>", "sub": "<hh:subscript/>"}.get(v["script"], "")
        return f'<hh:charPr id="{n}" height="{round((v["size"] or 10) * 100)}" textColor="#{v["colour"] or "000000"}">{marks}</hh:charPr>'

    def para_style(value: tuple[str, int], n: int) -> str:
        outline = f'<hh:heading type="OUTLINE" idRef="0" level="{value[1] - 1}"/>' if value[1] else '<hh:heading type="NONE" idRef="0" level="0"/>'
        return f'<hh:paraPr id="{n}"><hh:align horizontal="{value[0].upper()}" vertical="BASELINE"/>{outline}</hh:paraPr>'

    hml = "http://www.hancom.co.kr/hwpml/2011"
    space = f'xmlns:hp="{hml}/paragraph" xmlns:hs="{hml}/section" xmlns:hc="{hml}/core"'
    listed = "".join(f'<hh:{k}Properties itemCnt="{len(x)}">{"".join(f(v, n) for v, n in x.items())}</hh:{k}Properties>' for k, x, f in (("char", chars, char), ("para", paras, para_style)))
    header = f'{_HEAD}<hh:head xmlns:hh="{hml}/head"><hh:refList>{listed}<hh:styles itemCnt="1"><hh:style id="0" type="PARA" name="바탕글" paraPrIDRef="0" charPrIDRef="0"/></hh:styles></hh:refList></hh:head>'
    items = "".join(f'<opf:item id={quoteattr(name.rpartition("/")[2].partition(".")[0])} href={quoteattr(name)} media-type="image/{name.rpartition(".")[2]}"/>' for name, _ in media)
    package = f'{_HEAD}<opf:package xmlns:opf="http://www.idpf.org/2007/opf/"><opf:metadata><opf:title>{_xml(title)}</opf:title></opf:metadata><opf:manifest><opf:item id="header" href="Contents/header.xml" media-type="application/xml"/><opf:item id="section0" href="Contents/section0.xml" media-type="application/xml"/>{items}</opf:manifest><opf:spine><opf:itemref idref="section0"/></opf:spine></opf:package>'
    container = f'{_HEAD}<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="Contents/content.hpf" media-type="application/hwpml-package+xml"/></rootfiles></container>'
    return _archive(
        [
            ("mimetype", "application/hwp+zip"),
            ("version.xml", f"{_HEAD}<version/>"),
            ("META-INF/container.xml", container),
            ("Contents/content.hpf", package),
            ("Contents/header.xml", header),
            ("Contents/section0.xml", f"{_HEAD}<hs:sec {space}>{''.join(out)}</hs:sec>"),
            *media,
        ],
        stored=("mimetype",),
    )


def write_odt(blocks: list[Block], title: str = "") -> bytes:
    def text(t: str) -> str:
        t = re.sub("  +", lambda m: f' <text:s text:c="{len(m[0]) - 1}"/>', _xml(t))
        return t.replace("\t", "<text:tab/>").replace("\n", "<text:line-break/>")

    def table(b: Block) -> str:
        at = {(r, c): (rs, cs, t) for r, c, rs, cs, t in b["cells"]}
        rows, cols = len(_grid(b)), max(map(len, _grid(b)), default=0)
        covered = {(r + i, c + k) for (r, c), (rs, cs, _) in at.items() for i in range(rs) for k in range(cs)} - set(at)
        out = []
        for r in range(rows):
            line = []
            for c in range(cols):
                rs, cs, t = at.get((r, c), (1, 1, ""))
                spans = f' table:number-rows-spanned="{rs}" table:number-columns-spanned="{cs}"' if rs > 1 or cs > 1 else ""
                line.append("<table:covered-table-cell/>" if (r, c) in covered else f"<table:table-cell{spans}>{''.join(f'<text:p>{text(x)}</text:p>' for x in t.split(chr(10)))}</table:table-cell>")
            out.append(f"<table:table-row>{''.join(line)}</table:table-row>")
        return f"<table:table table:name={quoteattr(_ILLEGAL.sub('', b['text']))}>{''.join(out)}</table:table>"

    body = []
    for b in blocks:
        if b["kind"] == "table":
            body.append(table(b))
        elif b["kind"] == "paragraph" and b["heading"]:
            body.append(f'<text:h text:outline-level="{b["heading"]}">{text(b["text"])}</text:h>')
        elif b["kind"] == "paragraph":
            p = f"<text:p>{text(b['text'])}</text:p>"
            for _ in range(b["level"] + 1 if b["list_kind"] != "none" else 0):
                p = f"<text:list><text:list-item>{p}</text:list-item></text:list>"
            body.append(p)
        elif b["kind"] == "image":
            body.append(f"<text:p>{text(f'[그림: {b["text"] or "image"}]')}</text:p>")
    odf = "urn:oasis:names:tc:opendocument:xmlns"
    content = f'{_HEAD}<office:document-content xmlns:office="{odf}:office:1.0" xmlns:text="{odf}:text:1.0" xmlns:table="{odf}:table:1.0" office:version="1.2"><office:body><office:text>{"".join(body)}</office:text></office:body></office:document-content>'
    kind = "application/vnd.oasis.opendocument.text"
    manifest = f'{_HEAD}<manifest:manifest xmlns:manifest="{odf}:manifest:1.0" manifest:version="1.2"><manifest:file-entry manifest:full-path="/" manifest:media-type="{kind}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'
    return _archive([("mimetype", kind), ("META-INF/manifest.xml", manifest), ("content.xml", content)], stored=("mimetype",))


def write_txt(blocks: list[Block], title: str = "") -> bytes:
    out = []
    for b in blocks:
        if b["kind"] == "paragraph":
            out.append("  " * b["level"] * (b["list_kind"] != "none") + {"bullet": "- ", "number": "1. "}.get(b["list_kind"], "") + b["text"])
        elif b["kind"] == "table":
            out += [f"[{b['text']}]"] * bool(b["text"]) + ["\t".join(c.replace("\n", " ") for c in row) for row in _grid(b)] + [""]
        else:
            out.append("\f" if b["kind"] == "page_break" else f"[그림: {b['text'] or 'image'}]")
    return ("\n".join(out) + "\n").encode()


def write_md(blocks: list[Block], title: str = "") -> bytes:
    def safe(t: str) -> str:
        return re.sub(r"([\\`*_])", r"\\\1", t.replace("\n", "  \n"))

    def marked(r: dict) -> str:
        if not r["text"].strip():
            return r["text"].replace("\n", "  \n")
        stars = "*" * (2 * r["bold"] + r["italic"])
        t = f"{stars}{safe(r['text'])}{stars}"
        t = f"~~{t}~~" if r["strike"] else t
        return f"[{t}]({r['href']})" if r["href"] else t

    out = [f"# {title}\n"] * bool(title)
    for b in blocks:
        if b["kind"] == "paragraph":
            t, indent = "".join(map(marked, runs_of(b))).strip(), "  " * b["level"]
            if not t:
                out.append("")
            elif b["heading"]:
                out.append(f"\n{'#' * min(6, b['heading'])} {t}\n")
            else:
                out.append({"bullet": f"{indent}- {t}", "number": f"{indent}1. {t}"}.get(b["list_kind"], t + "\n"))
        elif b["kind"] == "table":
            out += [f"\n**{b['text']}**\n"] * bool(b["text"])
            rows = [[c.replace("\n", " ").replace("|", "\\|") for c in row] for row in _grid(b)]
            lines = [f"| {' | '.join(row)} |" for row in rows]
            out.append("\n".join([*lines[:1], *(["|" + "|".join([" --- "] * len(rows[0])) + "|"] if rows else []), *lines[1:]]) + "\n")
        else:
            out.append("\n---\n" if b["kind"] == "page_break" else f"![{b['text'] or 'image'}]({b['text'] or 'image'})\n")
    return ("\n".join(out).replace("\n\n\n", "\n\n") + "\n").encode()


def write_html(blocks: list[Block], title: str = "") -> bytes:
    def safe(t: str) -> str:
        return escape(t, {'"': "&quot;", "'": "&#x27;"}).replace("\n", "<br>").replace("\t", "&emsp;")

    def styled(r: dict) -> str:
        t = safe(r["text"])
        css = ";".join([f"font-size:{r['size']:.1f}pt"] * (r["size"] > 0) + [f"color:#{r['colour']}"] * bool(r["colour"]))
        t = f'<span style="{css}">{t}</span>' if css else t
        for on, tag in ((r["bold"], "strong"), (r["italic"], "em"), (r["underline"], "u"), (r["strike"], "s"), (r["script"] == "super", "sup"), (r["script"] == "sub", "sub")):
            t = f"<{tag}>{t}</{tag}>" if on else t
        return f'<a href="{safe(r["href"])}">{t}</a>' if r["href"] else t

    out, open_list = [], None
    for b in [*blocks, {"kind": "end", "list_kind": "none"}]:
        kind = {"bullet": "ul", "number": "ol"}.get(b["list_kind"]) if b["kind"] == "paragraph" else None
        if kind != open_list:
            out += [f"</{open_list}>"] * bool(open_list) + [f"<{kind}>"] * bool(kind)
            open_list = kind
        if b["kind"] == "paragraph":
            t = "".join(map(styled, runs_of(b)))
            tag = "li" if kind else f"h{min(6, b['heading'])}" if b["heading"] else "p"
            align = f' style="text-align:{b["align"]}"' if b.get("align", "left") != "left" else ""
            out.append(f"<{tag}{align}>{t if t.strip() else '&nbsp;'}</{tag}>")
        elif b["kind"] == "table":
            rows: dict[int, list[str]] = {}
            for r, c, rs, cs, t in sorted(b["cells"]):
                tag = "th" if r == 0 else "td"
                spans = f' colspan="{cs}"' * (cs > 1) + f' rowspan="{rs}"' * (rs > 1)
                rows.setdefault(r, []).append(f"<{tag}{spans}>{safe(t) or '&nbsp;'}</{tag}>")
            caption = f"<caption>{safe(b['text'])}</caption>" * bool(b["text"])
            out.append(f"<table>{caption}{''.join(f'<tr>{chr(10).join(x)}</tr>' for _, x in sorted(rows.items()))}</table>")
        elif b.get("image"):
            out.append(f'<p><img alt="{safe(b["text"])}" src="data:image/{picture_kind(b["image"])};base64,{base64.b64encode(b["image"]).decode()}"></p>')
        elif b["kind"] != "end":
            out.append('<hr class="page-break">' if b["kind"] == "page_break" else f"<p>[그림: {safe(b['text'] or 'image')}]</p>")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{safe(title)}</title></head><body>{chr(10).join(out)}</body></html>'.encode()


def write_csv(blocks: list[Block], title: str = "") -> bytes:
    """The primary sheet: the first, unless it is almost empty and another one holds more. With a byte order mark, lines end in CR LF."""
    sheets = [_grid(b) for _, b in sheets_of(blocks)]
    weights = [sum(len(c.strip()) for row in s for c in row) for s in sheets]
    best = max(range(len(sheets)), key=weights.__getitem__)
    chosen = sheets[best if weights[0] < 50 and weights[best] > weights[0] else 0]
    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n").writerows([re.sub("\r\n?", "\n", c) for c in row] for row in chosen)
    return out.getvalue().encode("utf-8-sig")


def write_json(blocks: list[Block], title: str = "") -> bytes:
    """The blocks with what they hold; empty fields are left out."""
    kept = [{k: v for k, v in b.items() if v and v not in ("none", "left") and k != "image"} for b in blocks]
    kept = [b | {"runs": [{k: v for k, v in r.items() if v} for r in b["runs"]]} if "runs" in b else b for b in kept]
    stats = {"blocks": len(blocks), "paragraphs": sum(b["kind"] == "paragraph" for b in blocks), "tables": sum(b["kind"] == "table" for b in blocks), "characters": sum(len(b["text"]) for b in blocks if b["kind"] == "paragraph")}
    return json.dumps({"title": title, "stats": stats, "blocks": kept}, ensure_ascii=False, indent=2).encode()


WRITERS: dict[str, Callable[[list[Block], str], bytes]] = {"docx": write_docx, "xlsx": write_xlsx, "hwpx": write_hwpx, "txt": write_txt, "md": write_md, "html": write_html, "csv": write_csv, "json": write_json, "odt": write_odt, "pdf": write_pdf}

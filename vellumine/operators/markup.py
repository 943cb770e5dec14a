"""Blocks of HTML, by tokens and windows of a page, and its table grids, by one pass of a task through each page.

For blocks, a page is cut at the tags that part them, each with the text behind it, and windows in page order
tell what is open at each: headings, lists by their depth, and tables by theirs. One exchange by page carries all.
For cells, a task goes through each page, which is one value of a row, and holds what is open. A text belongs to the innermost
open table, and there to the latest row and cell.

Null and empty pages have no blocks. Marks that end nothing count for nothing, what is left open
ends with the page, and cells may come without a row. A tag ends at its first ``>``. Texts of a
table outside its cells are left out, as are comments and what a browser doesn't show.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import html_unescape
from vellumine.shared import cut

# Elements whose content isn't shown, elements that begin a block, the widest span.
QUIET = ("script", "style", "noscript", "svg", "title", "template")
EDGES = tuple("address article aside blockquote body caption dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
HIDDEN = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(rf"<{t}(?:\s[^>]*[^/>])?\s*>.*?(?:</{t}\s*>|\z)" for t in QUIET)
MAY_HIDE = rf"(?i)<(?:!--|{'|'.join(QUIET)})"  # where nothing begins what HIDDEN takes away, which is slow to tell
TOKEN = r"(?s)</?[A-Za-z][^>]*>|<[!?][^>]*>|[^<]+|<"
TAG = r"(?s)^</?([A-Za-z][^\s/>]*)[^>]*>$"
EDGE, TABLE, BREAK = rf"(?i)^</?(?:{'|'.join(EDGES)})[\s/>]", r"(?i)^<table[\s/>]", r"(?i)^</?br[\s/>]"
WIDEST = 1000

# The same rules for a task that goes through a page, and the cells that it hands on at once.
MARK = re.compile(r"([^<]*+)(<(?:(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|[!?][^>]*+>)?|\Z)", re.ASCII)
ROWSPAN, COLSPAN = (re.compile(rf"""\s{name}\s*=\s*["']?\s*\+?0*([0-9]+)""", re.ASCII | re.IGNORECASE) for name in ("rowspan", "colspan"))
SPACE, AROUND_BREAK = re.compile("[ \t\r\n\f]+"), re.compile(" *\x0b *")
KINDS = {t: t if t in ("table", "tr", "td", "th") else "edge" for t in EDGES} | {"br": "br"}
CELL = {"table": "int", "inner": "boolean", "r": "int", "c": "int", "row_span": "int", "col_span": "int", "header": "boolean", "text": "string"}
CELLS = 10_000


def _shown(html: str) -> Column:
    """What is shown of a page."""
    page = F.coalesce(html, F.lit(""))
    seen = F.when(page.rlike(MAY_HIDE), F.regexp_replace(page, HIDDEN, "")).otherwise(page)
    return F.replace(seen, F.lit("\x0b"), F.lit(" "))


def _tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, n, t, raw, tag, ends, mark: the marks that part blocks, each with the text behind it; one without text stands before each table, for its place in what is around it.

    ``raw`` has no other marks: ``&;``, which no text has then, stands for them, and a lone ``<`` is a reference.
    """

    def one(t: Column) -> Column:
        text = F.when(~F.startswith(t, F.lit("<")), F.replace(t, F.lit("&;"), F.lit("&amp;;"))).when(t == "<", "&lt;")
        return text.when(t.rlike(TABLE), F.concat(F.lit("<+>"), t)).when(t.rlike(EDGE), t).when(t.rlike(BREAK), "&;\x0b&;").otherwise("&;")

    flat = F.array_join(F.transform(F.regexp_extract_all(_shown(html), F.lit(TOKEN), F.lit(0)), one), "")
    each = pages.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(flat, F.lit("<[^>]*>[^<]*|[^<]+"), F.lit(0))).alias("n", "x"))
    each = each.select("key", "n", F.regexp_extract("x", "^<[^>]*>", 0).alias("t"), F.regexp_replace("x", "^<[^>]*>", "").alias("raw"))
    return each.withColumns({"tag": F.lower(F.regexp_extract("t", TAG, 1)), "ends": F.startswith("t", F.lit("</")), "mark": F.col("t") == "<+>"})


def _depths(df: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """How many elements of some tags are open after each token."""
    w = Window.partitionBy("key").orderBy("n")
    way = lambda tags: F.when(F.col("tag").isin(*tags), F.when(F.col("ends"), -1).otherwise(1)).otherwise(0)
    df = df.withColumns({k: F.sum(way(tags)).over(w) for k, tags in names.items()})
    return df.withColumns({k: F.col(k) - F.least(F.lit(0), F.min(k).over(w)) for k in names})


def _latest(value: Column, *by: str) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy("key", *by).orderBy("n"))


def scanned(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The tokens with the tables that are open and the heading and list in which they stand."""
    tag, ends, begins = F.col("tag"), F.col("ends"), ~F.col("ends")
    at = _depths(_tokens(pages, key, html), {"depth": ("table",), "lists": ("ul", "ol")})
    level = F.when(tag.rlike("^h[1-6]$"), F.when(ends, 0).otherwise(F.substring(tag, 2, 1).cast("int")))
    at = at.withColumns({"heading": F.coalesce(_latest(level), F.lit(0)), "item": (tag == "li") & begins})
    return at.withColumn("list", F.when(F.col("lists") > 0, _latest(F.when(tag.isin("ul", "ol") & begins, tag), "lists")))


def _plain(raw: Column) -> Column:
    """The text of a block: references resolved, white space as one space, none beside line breaks."""
    known = F.when(F.contains(raw, F.lit("&")), F.array_join(F.transform(F.split(raw, "&;"), html_unescape), "")).otherwise(raw)
    text = F.regexp_replace(known, "[ \t\r\n\f]+", " ")
    return F.trim(F.replace(F.regexp_replace(text, " *\x0b *", "\x0b"), F.lit("\x0b"), F.lit("\n")), F.lit(" \n"))


def html_blocks(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, ord, kind, heading, list_kind, level, text of the blocks outside tables; a table is one block, without text."""
    listed = (F.col("heading") == 0) & ((F.col("lists") > 0) | F.col("item"))
    kind = F.when(listed, F.when(F.col("list") == "ol", "number").otherwise("bullet")).otherwise("none")
    level = F.when(listed, F.greatest(F.col("lists") - 1, F.lit(0))).otherwise(0).cast("int")
    kinds = F.when(F.col("mark"), "table").otherwise("paragraph")
    top = scanned(pages, key, html).where("depth = 0").withColumns({"list_kind": kind, "level": level, "text": _plain(F.col("raw")), "kind": kinds}).where("mark or text <> ''")
    plain = lambda c, other: F.when(F.col("kind") == "paragraph", F.col(c)).otherwise(F.lit(other)).alias(c)
    order = F.row_number().over(Window.partitionBy("key").orderBy("n")) - 1
    return top.select(F.col("key").alias(key), order.alias("ord"), "kind", plain("heading", 0), plain("list_kind", "none"), plain("level", 0), F.when(F.col("kind") == "paragraph", F.col("text")).alias("text"))


def html_cells(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, table, inner, r, c, row_span, col_span, header, text of the cells of all tables.

    ``table`` numbers a page's tables as they begin; ``inner`` is whether it stands in a cell.
    A cell's text is that of its blocks by lines, with a table in it as tabs and lines that hold all its cells. ``header`` is a
    ``th``. Cells take the next column that no span from above holds. A task goes once through each page; the cells are written once.
    """
    held = pages.select(F.col(key).alias("key"), _shown(html).alias("html"))
    names = ", ".join(f"{name} {kind}" for name, kind in CELL.items())
    cells = cut(held.mapInArrow(_cells, f"key {held.schema['key'].dataType.simpleString()}, {names}"), "cells")
    return cells.withColumnRenamed("key", key)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of pages (key, html), in batches of ``CELLS`` and what is left of a page."""
    kinds = [pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
    for batch in batches:
        of, out = [], []

        def taken(keys: pa.Array, of: list[int], out: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(of, pa.int64())), *columns], ["key", *CELL])

        for i in range(batch.num_rows):
            for cell in cells_of(batch["html"][i].as_py()):
                of.append(i)
                out.append(cell)
                if len(out) == CELLS:
                    yield taken(batch["key"], of, out)
                    of, out = [], []
        if out:
            yield taken(batch["key"], of, out)


def _span(pattern: re.Pattern[str], marks: str) -> int:
    given = pattern.search(marks)
    return 1 if given is None else WIDEST if len(given[1]) > 4 else min(max(int(given[1]), 1), WIDEST)


@lru_cache(4096)
def _known(text: str) -> str:
    return unescape(text)


def _block(pieces: list[str]) -> str:
    """The text of a block as ``_plain`` has it; references are resolved in each piece."""
    text = "".join([p if "&" not in p else _known(p) if len(p) < 64 else unescape(p) for p in pieces])
    if text.isprintable() and "  " not in text:  # nothing to fold
        return text.strip(" ")
    return AROUND_BREAK.sub("\n", SPACE.sub(" ", text)).strip(" \n")


class _Table:
    """A table that is open: the row, the next place in it, for each column the first row that is free, and the open cell with its texts."""

    __slots__ = ("number", "inner", "r", "next", "free", "cell", "parts", "lines")

    def __init__(self, number: int, inner: bool, kept: bool) -> None:
        self.number, self.inner, self.r, self.next, self.free = number, inner, -1, 0, []
        self.cell = self.parts = None
        self.lines = {} if kept else None  # texts by row and column, for the cell that the table stands in

    def begin(self, marks: str, header: bool) -> None:
        rs, cs = (_span(ROWSPAN, marks), _span(COLSPAN, marks)) if marks else (1, 1)
        if self.r < 0:
            self.r = 0  # cells before the first row are a row
        free, r, c = self.free, self.r, self.next
        known = len(free)
        while c < known and free[c] > r:
            c += 1
        self.next = after = c + cs
        if after > known:
            free += [0] * (after - known)
        for j in range(c, after):
            if free[j] < r + rs:
                free[j] = r + rs
        self.cell, self.parts = (r, c, rs, cs, header), []

    def ended(self) -> tuple:
        """The open cell as a row."""
        r, c, rs, cs, header = self.cell
        text = self.parts[0] if len(self.parts) == 1 else "\n".join(self.parts)
        self.cell = self.parts = None
        if self.lines is not None:
            self.lines.setdefault(r, {})[c] = text
        return self.number, self.inner, r, c, rs, cs, header, text

    def text(self) -> str:
        rows = self.lines
        line = lambda cells: "\t".join([cells.get(c, "") for c in range(max(cells) + 1)])
        return "\n".join([line(rows[r]) if r in rows else "" for r in range(max(rows, default=-1) + 1)])


def cells_of(page: str) -> Iterator[tuple]:
    """table, inner, r, c, row_span, col_span, header, text of a page without what isn't shown; only what is open is held."""
    tables: list[_Table] = []
    top, begun, pieces = None, 0, []
    for m in MARK.finditer(page):
        before, mark, ends, name, marks = m.groups()
        if top and before and top.cell:
            pieces.append(before)
        if name is None:
            if mark == "<" and top and top.cell:
                pieces.append(mark)
            continue
        kind = KINDS.get(name) or (KINDS.get(name.lower()) if name.isascii() else None)
        if kind is None:
            continue
        if kind == "br":
            if top and top.cell:
                pieces.append("\x0b")
            continue
        if pieces:
            if text := _block(pieces):
                top.parts.append(text)
            pieces = []
        if kind == "table":
            if not ends:
                top = _Table(begun, bool(tables), bool(top and top.cell))
                tables.append(top)
                begun += 1
            elif top:
                yield from _closed(tables)
                top = tables[-1] if tables else None
        elif top and kind != "edge":
            if top.cell:
                yield top.ended()
            if ends:
                continue
            if kind == "tr":
                top.r, top.next = top.r + 1, 0
            else:
                top.begin(marks, kind == "th")
    if pieces and (text := _block(pieces)):
        top.parts.append(text)
    while tables:
        yield from _closed(tables)


def _closed(tables: list[_Table]) -> Iterator[tuple]:
    """Ends the innermost table; its text is part of the cell around it."""
    table = tables.pop()
    if table.cell:
        yield table.ended()
    if table.lines and (text := table.text()):
        tables[-1].parts.append(text)

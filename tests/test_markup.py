"""HTML in windows over tokens against a walk by the standard parser."""

import html
import os
import random
from collections import defaultdict
from html.parser import HTMLParser

from pyspark.sql import functions as F

from vellumine.functions.text import html_unescape
from vellumine.operators import markup

SPECIAL = ["<ul>", "</ul>", "<ol>", "</ol>", "<li>", "</li>", "<h2>", "</h2>", "<H5 id=x>", "</H5>", "<p>", "</p>", "<div class='a'>", "</div>", "<b>", "</b>", "<br>", "<br/>", "<!-- no <p> -->", "<script>var t = '</p>';</script>", "<title>no</title>", "<svg />", "\n \t", "&amp;lt;", "&eacute;", " word ", "x", "\x0b", " "]
TABLES = ["<table>", "</table>", "<TABLE border=1>", "<tr>", "</tr>", "<td>", "<td>", "<th>", "</td>", "</th>", "<td colspan=2>", '<td rowspan="3">', "<td rowspan='0' colspan=2>", "<td colspan=x>", "a", "b &lt; c", "<p>", "</table>"]


class Walk(HTMLParser):
    """Blocks and, for each table, rows of cells, by stacks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.quiet, self.lists, self.heading, self.item, self.buffer, self.blocks, self.tables, self.open = 0, [], 0, False, [], [], [], []

    def flush(self):
        out = "".join(self.buffer)
        self.buffer = []
        for ch in "\t\r\n\f":
            out = out.replace(ch, " ")
        out = "\n".join(" ".join(p for p in x.split(" ") if p) for x in out.split("\x0b")).strip(" \n")
        if not out:
            return
        if self.open:
            t = self.open[-1]
            if t["cell"] is not None:
                t["cell"]["parts"].append(out)
            return
        listed = not self.heading and bool(self.lists or self.item)
        kind = ("number" if self.lists and self.lists[-1] == "ol" else "bullet") if listed else "none"
        self.blocks.append(("paragraph", self.heading, kind, max(len(self.lists) - 1, 0) if listed else 0, out))

    def handle_starttag(self, tag, attrs):
        if tag in markup.QUIET:
            self.quiet += 1
            return
        if tag == "br":
            self.buffer.append("\x0b")
        if tag not in markup.EDGES:
            return
        self.flush()
        if tag == "table":
            t = {"rows": [], "cell": None, "inner": bool(self.open), "number": len(self.tables)}
            self.tables.append(t)
            if not self.open:
                self.blocks.append(("table", 0, "none", 0, None))
            elif self.open[-1]["cell"] is not None:
                self.open[-1]["cell"]["parts"].append(t)
            self.open.append(t)
        elif self.open and tag == "tr":
            self.open[-1]["rows"].append([])
            self.open[-1]["cell"] = None
        elif self.open and tag in ("td", "th"):
            t = self.open[-1]
            if not t["rows"]:
                t["rows"].append([])
            span = lambda k: min(max(int(v), 1), 1000) if (v := dict(attrs).get(k) or "").isdigit() else 1
            t["cell"] = {"parts": [], "rs": span("rowspan"), "cs": span("colspan"), "header": tag == "th"}
            t["rows"][-1].append(t["cell"])
        if tag in ("ul", "ol"):
            self.lists.append(tag)
        if tag[0] == "h" and tag[1:].isdigit():
            self.heading = int(tag[1])
        self.item = tag == "li"

    def handle_startendtag(self, tag, attrs):
        if tag not in markup.QUIET:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in markup.QUIET:
            self.quiet -= 1
            return
        if tag not in markup.EDGES:
            return
        self.flush()
        if tag == "table" and self.open:
            self.open.pop()
        elif tag in ("tr", "td", "th") and self.open:
            self.open[-1]["cell"] = None
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if tag[0] == "h" and tag[1:].isdigit():
            self.heading = 0
        self.item = False

    def handle_data(self, data):
        if not self.quiet:
            self.buffer.append(data.replace("\x0b", " "))


def text_of(t):
    """A table as tabs and lines: each cell at its column."""
    lines = defaultdict(dict)
    for r, c, cell in placed(t):
        parts = [p if isinstance(p, str) else text_of(p) for p in cell["parts"]]
        lines[r][c] = "\n".join(p for p in parts if p)
    return "\n".join("\t".join(lines[r].get(c, "") for c in range(max(lines[r], default=-1) + 1)) if r in lines else "" for r in range(max(lines, default=-1) + 1))


def placed(t):
    taken, out = set(), []
    for r, row in enumerate(t["rows"]):
        c = 0
        for cell in row:
            while (r, c) in taken:
                c += 1
            out.append((r, c, cell))
            for i in range(cell["rs"]):
                taken |= {(r + i, c + j) for j in range(cell["cs"])}
            c += cell["cs"]
    return out


def walk(source):
    w = Walk()
    w.feed(source or "")
    w.close()
    w.flush()
    return w


def made(r, tokens, k):
    return "".join(r.choice(tokens) for _ in range(k))


def test_blocks(spark):
    r = random.Random(5)
    sources = [None, "", "plain", "&", "<", "a < b", "<p", "</p>", "<ul><li>a<ol><li>b</ul>c", "<h1>t</h1><h1>", "x" * 200_000, "<p>y" * 3000]
    sources += [made(r, SPECIAL, r.randrange(40)) for _ in range(250)] + [made(r, SPECIAL + TABLES, r.randrange(40)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(sources)), "page_id int, html string").withColumn("text", F.lit("mine"))
    got = defaultdict(list)
    for x in markup.html_blocks(df).orderBy("page_id", "ord").collect():
        assert x["ord"] == len(got[x["page_id"]])
        got[x["page_id"]].append((x["kind"], x["heading"], x["list_kind"], x["level"], x["text"]))
    for k, s in enumerate(sources):
        if s not in ("<p",):  # the parser and the rule differ on a tag that the page ends in
            assert got.get(k, []) == walk(s).blocks, s[:400] if s else s
    assert markup.html_blocks(df.limit(0)).collect() == []


def test_cells(spark):
    r = random.Random(6)
    sources = [None, "", "<table></table>", "<table>a<tr>b<td>c", "<table><td>a<tr><td>b</table>", "<table><tr><td><table><tr><td><table><tr><td>deep</table></table></table>"]
    sources += [made(r, TABLES, r.randrange(60)) for _ in range(250)]
    df = spark.createDataFrame(list(enumerate(sources)), "page_id int, html string").withColumn("key", F.lit("mine"))
    got = defaultdict(set)
    for x in markup.html_cells(df).collect():
        got[x["page_id"]].add((x["table"], x["inner"], x["r"], x["c"], x["row_span"], x["col_span"], x["header"], x["text"]))
    for k, s in enumerate(sources):
        want = set()
        for t in walk(s).tables:
            for row, c, cell in placed(t):
                parts = [p if isinstance(p, str) else text_of(p) for p in cell["parts"]]
                want.add((t["number"], t["inner"], row, c, cell["rs"], cell["cs"], cell["header"], "\n".join(p for p in parts if p)))
        assert got.get(k, set()) == want, s
    assert markup.html_cells(df.limit(0)).collect() == []


def test_references(spark):
    texts = ["a &amp; b &copy; &middot &#65; &#x41;&#128;&#129; &#0; &#xD800; &#99999999999; & &; &#; &#x; &zz; &nbsp;x &NotEqualTilde;", None, "", "plain", "&amp;copy;", "&#0000000000065;", "&" * 50, "&AMP &quot"]
    for x in spark.createDataFrame([(t,) for t in texts], "t string").select("t", html_unescape(F.col("t")).alias("u")).collect():
        assert x["u"] == (html.unescape(x["t"]) if x["t"] is not None else None)


def test_one_exchange_and_no_python(spark):
    df = spark.createDataFrame([(1, "<p>a")], "page_id int, html string")
    plan = markup.html_blocks(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_references_end_at_marks(spark):
    html = "<p>&am<b>p;</b> a&;b &lt<i>x</i> 1 < 2 &#<!-- c -->65; <td>lone<br>cell<table><tr><td>&<b>amp;</b></table>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [r["text"] for r in markup.html_blocks(pages).orderBy("ord").collect()] == ["&amp; a&;b <x 1 < 2 A", "lone\ncell", None]
    assert [r["text"] for r in markup.html_cells(pages).collect()] == ["&amp;"]


def test_cells_of_flat_tables_write_their_marks_once(spark):
    from vellumine.shared import checkpoint_root

    folder = checkpoint_root(spark).removeprefix("file://") + "/tables"
    written = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = written()
    pages = spark.createDataFrame([(k, "<table><tr><th rowspan=2>a<td>b<tr><td>c</table>") for k in range(3)], "page_id long, html string")
    got = [(r["r"], r["c"], r["text"]) for r in markup.html_cells(pages).where("page_id = 1").orderBy("r", "c").collect()]
    assert got == [(0, 0, "a"), (0, 1, "b"), (1, 1, "c")]
    assert len(written() - before) == 1


def test_cells_are_read_without_windows(spark):
    """One pass of a task: no exchange, and a page whose cells are more than a batch takes."""
    many = "<table>" + "<tr><td rowspan=2>a &amp; <b>b</b><td>c" * 15_000 + "</table>"
    pages = spark.createDataFrame([(1, many), (2, "<table><td>x<script><td>no</script><SCRIPT >\n</table>")], "page_id long, html string")
    scanned = pages.select(F.col("page_id").alias("key"), markup._shown("html").alias("html")).mapInArrow(markup._cells, "key long, " + ", ".join(f"{k} {t}" for k, t in markup.CELL.items()))
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    got = markup.html_cells(pages)
    assert got.columns == ["page_id", "table", "inner", "r", "c", "row_span", "col_span", "header", "text"]
    assert got.groupBy("page_id").count().orderBy("page_id").collect() == [(1, 30_000), (2, 1)]
    assert got.where("page_id = 1 and r = 1").orderBy("c").select("c", "text").collect() == [(1, "a & b"), (2, "c")]

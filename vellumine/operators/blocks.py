"""Operators over blocks and runs.

Blocks are rows (doc_id, ord, kind, text, ...); ``ord`` is the place in the document, and a
document is a partition of every window here. Runs are rows (para, ord, text, style...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import is_blank, strip

# Point size of a heading by its level, body size, and the ratios to the body's
# size from which a paragraph counts as a heading, with its longest text.
HEADING_PT, BODY_PT = {1: 18.0, 2: 15.0, 3: 13.0, 4: 12.0, 5: 11.0}, 10.5
TITLE_MAX = 120


def heading_size(level: Column) -> Column:
    size = F.lit(BODY_PT)
    for n, pt in HEADING_PT.items():
        size = F.when(level == n, pt).otherwise(size)
    return size


def compact(blocks: DataFrame) -> DataFrame:
    """Of blank paragraphs in a row only the first stays; any other block ends the row."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    empty = (F.col("kind") == "paragraph") & is_blank(F.col("text"))
    return blocks.withColumn("_e", empty).withColumn("_p", F.lag("_e", 1, False).over(w)).where(~(F.col("_e") & F.col("_p"))).drop("_e", "_p")


def merge_runs(runs: DataFrame, key: str, style: list[str]) -> DataFrame:
    """Neighbouring runs of one style become one: key, island, style..., text."""
    w = Window.partitionBy(key).orderBy("ord")
    same = F.lit(True)
    for c in style:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    islands = runs.withColumn("_new", F.when(same & ~first, 0).otherwise(1)).withColumn("island", F.sum("_new").over(w))
    return islands.groupBy(key, "island").agg(*(F.min_by(c, "ord").alias(c) for c in style), joined("text", "").alias("text"), F.min("ord").alias("ord"))


def joined(text: str, by: str, order: str = "ord") -> Column:
    """Texts in order, with ``by`` between them; nulls are left out."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda s: s[text]), by)


def list_wrappers(blocks: DataFrame) -> DataFrame:
    """The tags that open and close a list where the list kind changes."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    before, after, own = F.lag("list_kind", 1, "none").over(w), F.lead("list_kind", 1, "none").over(w), F.col("list_kind")
    tag = lambda c: F.when(c == "bullet", "ul").when(c == "number", "ol")
    opens = F.when((own != "none") & (own != before), F.concat(F.lit("<"), tag(own), F.lit(">"))).otherwise("")
    closes = F.when((own != "none") & (own != after), F.concat(F.lit("</"), tag(own), F.lit(">"))).otherwise("")
    return blocks.withColumns({"opens": opens, "closes": closes})


def number_tables(blocks: DataFrame) -> DataFrame:
    """The number of each table in its document, and the line that stands for it in the body sheet."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count_if(F.col("kind") == "table").over(w)
    return blocks.withColumn("table_no", F.when(F.col("kind") == "table", n)).withColumn("line", F.when(F.col("kind") == "table", F.concat(F.lit("[표 "), F.col("table_no").cast("string"), F.lit(": "), "text", F.lit("]"))).otherwise(F.col("text")))


def unique_names(names: DataFrame, key: str, longest: int = 31) -> DataFrame:
    """The n-th of equal names gets ``_n``; the whole stays within ``longest`` characters."""
    w = Window.partitionBy(key, "name").orderBy("ord")
    n = F.row_number().over(w)
    suffix = F.concat(F.lit("_"), n.cast("string"))
    cut = F.when(F.length("name") + F.length(suffix) > longest, F.left("name", longest - F.length(suffix))).otherwise(F.col("name"))
    return names.withColumn("unique_name", F.when(n == 1, F.col("name")).otherwise(F.concat(cut, suffix)))


def stats(blocks: DataFrame) -> DataFrame:
    """Blocks at the top, and paragraphs, tables, images and characters at any depth."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    return blocks.groupBy("doc_id").agg(
        F.count_if(F.col("parent").isNull()).alias("blocks"),
        kind("paragraph").alias("paragraphs"),
        kind("table").alias("tables"),
        kind("image").alias("images"),
        F.coalesce(F.sum(F.when(F.col("kind") == "paragraph", F.length("text"))), F.lit(0)).cast("long").alias("characters"),
    )


def empty_documents(blocks: DataFrame) -> DataFrame:
    """Documents without a non-blank paragraph, table or image at the top."""
    holds = F.col("parent").isNull() & (F.col("kind").isin("table", "image") | ((F.col("kind") == "paragraph") & ~is_blank(F.col("text"))))
    return blocks.groupBy("doc_id").agg(F.bool_or(holds).alias("_h")).where(~F.col("_h")).select("doc_id")


def titles(blocks: DataFrame) -> DataFrame:
    """The first text that isn't blank, stripped, at most 120 characters."""
    text = F.when(~is_blank(F.col("text")), F.left(strip(F.col("text")), F.lit(TITLE_MAX)))
    return blocks.groupBy("doc_id").agg(F.min_by(text, F.when(text.isNotNull(), F.col("ord"))).alias("title"))


def to_text(blocks: DataFrame) -> DataFrame:
    """Documents as text: ``# name`` before a named table, a form feed for a page break."""
    part = F.when(F.col("kind") == "page_break", "\f").when((F.col("kind") == "table") & F.col("name").isNotNull(), F.concat(F.lit("# "), "name", F.lit("\n"), "text")).otherwise(F.col("text"))
    return blocks.withColumn("_part", part).groupBy("doc_id").agg(joined("_part", "\n").alias("text"))


def txt_line(list_kind: Column, level: Column, text: Column) -> Column:
    """A line of a text file: numbered items are always ``1.``."""
    indent = F.repeat(F.lit("  "), level)
    return F.when(list_kind == "bullet", F.concat(indent, F.lit("- "), text)).when(list_kind == "number", F.concat(indent, F.lit("1. "), text)).otherwise(text)


def md_escape(text: Column) -> Column:
    for ch in ("\\", "`", "*", "_"):
        text = F.replace(text, F.lit(ch), F.lit("\\" + ch))
    return text


def md_run(text: Column, bold: Column, italic: Column, strike: Column, href: Column) -> Column:
    """A run in Markdown: escaped, then emphasis, strike and link around it; blank runs stay as they are."""
    broken = F.replace(text, F.lit("\n"), F.lit("  \n"))
    t = md_escape(broken)
    around = lambda m, x: F.concat(F.lit(m), x, F.lit(m))
    t = F.when(bold & italic, around("***", t)).when(bold, around("**", t)).when(italic, around("*", t)).otherwise(t)
    t = F.when(strike, around("~~", t)).otherwise(t)
    t = F.when(href.isNotNull(), F.concat(F.lit("["), t, F.lit("]("), href, F.lit(")"))).otherwise(t)
    return F.when(is_blank(broken), broken).otherwise(t)


def md_paragraph(text: Column, heading: Column, list_kind: Column, level: Column) -> Column:
    t, indent = strip(text), F.repeat(F.lit("  "), level)
    return (
        F.when(t == "", "")
        .when(heading > 0, F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.least(F.lit(6), heading)), F.lit(" "), t, F.lit("\n")))
        .when(list_kind == "bullet", F.concat(indent, F.lit("- "), t))
        .when(list_kind == "number", F.concat(indent, F.lit("1. "), t))
        .otherwise(F.concat(t, F.lit("\n")))
    )


def html_run(text: Column, bold: Column, italic: Column, underline: Column, strike: Column, sup: Column, sub: Column, size: Column, colour: Column, href: Column) -> Column:
    """A run in HTML: style innermost, then strong, em, u, s, sup or sub, and the link around all."""
    from vellumine.functions.colours import rgb_to_hex
    from vellumine.functions.text import html_escape

    t = F.replace(F.replace(html_escape(text), F.lit("\n"), F.lit("<br>")), F.lit("\t"), F.lit("&emsp;"))
    css = F.concat_ws(";", F.when(size > 0, F.concat(F.lit("font-size:"), F.format_string("%.1f", size), F.lit("pt"))), F.concat(F.lit("color:"), rgb_to_hex(colour)))
    t = F.when(css != "", F.concat(F.lit('<span style="'), css, F.lit('">'), t, F.lit("</span>"))).otherwise(t)
    for on, tag in ((bold, "strong"), (italic, "em"), (underline, "u"), (strike, "s"), (sup, "sup"), (sub & ~sup, "sub")):
        t = F.when(on, F.concat(F.lit(f"<{tag}>"), t, F.lit(f"</{tag}>"))).otherwise(t)
    t = F.when(href.isNotNull(), F.concat(F.lit('<a href="'), html_escape(href), F.lit('">'), t, F.lit("</a>"))).otherwise(t)
    return F.when(text == "", "").otherwise(t)


def html_paragraph(inner: Column, heading: Column, align: Column) -> Column:
    style = F.when(align != "left", F.concat(F.lit(' style="text-align:'), align, F.lit('"'))).otherwise("")
    tag = F.when(heading > 0, F.concat(F.lit("h"), F.least(F.lit(6), heading).cast("string"))).otherwise("p")
    return F.when(is_blank(inner), "<p>&nbsp;</p>").otherwise(F.concat(F.lit("<"), tag, style, F.lit(">"), inner, F.lit("</"), tag, F.lit(">")))


def html_pages(blocks: DataFrame) -> DataFrame:
    """doc_id, html: whole pages. Items of one list stand in one ul or ol, page breaks are rules, the title is the first text."""
    from vellumine.functions.text import html_escape

    text = html_escape(F.col("text"))
    block = F.when(F.col("kind") == "page_break", "<hr>").when(F.col("list_kind") != "none", F.concat(F.lit("<li>"), text, F.lit("</li>"))).otherwise(html_paragraph(text, F.col("heading"), F.lit("left")))
    listed = list_wrappers(blocks.withColumn("list_kind", F.when(F.col("kind") == "page_break", "none").otherwise(F.col("list_kind"))))
    body = listed.withColumn("html", F.concat("opens", block, "closes")).groupBy("doc_id").agg(joined("html", "\n").alias("body"))
    head = F.concat(F.lit('<!DOCTYPE html>\n<html>\n<head><meta charset="utf-8"><title>'), html_escape(F.coalesce("title", F.lit(""))), F.lit("</title></head>\n<body>\n"))
    return body.join(titles(blocks), "doc_id").select("doc_id", F.concat(head, "body", F.lit("\n</body>\n</html>\n")).alias("html"))


def heading_by_size(runs: DataFrame, h1: float, h2: float, h3: float) -> DataFrame:
    """doc_id, para, heading: a paragraph's largest size against the document's median, each character one vote."""
    seen = runs.where((F.col("size_pt") > 0) & ~is_blank(F.col("text"))).withColumn("chars", F.length(strip(F.col("text"))))
    body = seen.groupBy("doc_id").agg(F.percentile("size_pt", 0.5, F.col("chars")).alias("body"))
    paras = seen.groupBy("doc_id", "para").agg(F.max("size_pt").alias("size"), F.bool_and("bold").alias("all_bold"), F.length(strip(joined("text", ""))).alias("n"))
    ratio = F.col("size") / F.col("body")
    level = F.when(F.col("n") > TITLE_MAX, 0).when(ratio >= h1, 1).when(ratio >= h2, 2).when((ratio >= h3) & F.col("all_bold"), 3).otherwise(0)
    return paras.join(body, "doc_id").select("doc_id", "para", level.alias("heading"))


def join_lines(lines: DataFrame, key: str, cjk: str) -> DataFrame:
    """Lines of a block as one paragraph: a final hyphen goes, CJK meets CJK without a space."""
    w = Window.partitionBy(key).orderBy("ord")
    after = F.left(F.lead("text").over(w), F.lit(1))
    text = F.col("text")
    part = (
        F.when(after.isNull(), text)
        .when(text.endswith("-"), F.left(text, F.length(text) - 1))
        .when(text.rlike("[  ]$") | (F.right(text, F.lit(1)).rlike(cjk) & after.rlike(cjk)), text)
        .otherwise(F.concat(text, F.lit(" ")))
    )
    return lines.withColumn("_part", part).groupBy(key).agg(joined("_part", "").alias("text"))

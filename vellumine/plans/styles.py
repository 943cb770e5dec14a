"""Styles, parts and layout over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellumine.functions import styles as st
from vellumine.operators import folds
from vellumine.operators import rules as ru
from vellumine.operators.blocks import joined, md_paragraph
from vellumine.plans.documents import BLOCKS, LINES, RUNS, blocks, lines, runs
from vellumine.plans.registry import query
from vellumine.plans.scalars import SPACE
from vellumine.plans.tables import CELLS, RECTS, cells, rects
from vellumine.shared import table
from vellumine.sources import formats as fm
from vellumine.sources.text import md_cells, md_links

_KINDS = ["SOLID", "dash", "3D", "WAVE", "Bottom", "NONE", "DOUBLE_SLIM", "CIRCLE", "what"]
_KIND = f"[{', '.join(repr(k) for k in _KINDS)}][l_partkey % 9 + 1]"
_LINE = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey"


def kinds(spark, sf_dir, **columns):
    rows = table(spark, sf_dir, "lineitem").withColumn("kind", F.array(*map(F.lit, _KINDS))[(F.col("l_partkey") % 9).cast("int")])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(c.alias(n) for n, c in columns.items()))


@query("prj13_line_switches", f"{_LINE}, upper({_KIND}) IN ('BOTTOM', 'CENTER', 'TOP') AS underline, upper({_KIND}) IN ('SOLID', 'DASH', 'DOT', 'DASH_DOT', 'DASH_DOT_DOT', 'LONG_DASH', 'CIRCLE', 'DOUBLE_SLIM', 'SLIM_THICK', 'THICK_SLIM', 'SLIM_THICK_SLIM') AS strike FROM lineitem")
def _(spark, sf_dir):
    return kinds(spark, sf_dir, underline=st.underlined(F.col("kind")), strike=st.struck(F.col("kind")))


@query("prj14_border_kinds", f"{_LINE}, CASE upper({_KIND}) WHEN 'SOLID' THEN 'solid' WHEN '3D' THEN 'solid' WHEN 'DASH' THEN 'dashed' WHEN 'WAVE' THEN 'dashed' WHEN 'CIRCLE' THEN 'dotted' WHEN 'DOUBLE_SLIM' THEN 'double' ELSE 'none' END AS style FROM lineitem")
def _(spark, sf_dir):
    return kinds(spark, sf_dir, style=st.border_style(F.col("kind")))


@query("prj06_border_css", f"{_LINE}, CASE WHEN s <> 'none' AND l_quantity > 1 THEN printf('%.2f', greatest(0.3::DOUBLE, l_quantity / 20)) || 'pt ' || s END AS css FROM (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN 'none' ELSE 'solid' END AS s FROM lineitem)")
def _(spark, sf_dir):
    style, width = F.when(F.col("l_partkey") % 3 == 0, "none").otherwise("solid"), F.col("l_quantity") / 20
    css = F.when((style != "none") & (F.col("l_quantity") > 1), F.concat(F.format_string("%.2f", F.greatest(F.lit(0.3), width)), F.lit("pt "), style))
    return kinds(spark, sf_dir, css=css)


@query("prj16_heading_styles", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN greatest(1, least(9, p_size)) WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN greatest(1, least(9, p_size)) WHEN 4 THEN CASE WHEN p_size > 25 THEN least(9, p_size - 25) ELSE 0 END ELSE 0 END AS heading FROM part")
def _(spark, sf_dir):
    k, size = F.col("p_partkey") % 6, F.col("p_size")
    name = F.when(k == 0, F.concat(F.lit("Heading "), size.cast("string"))).when(k == 1, " 제목 ").when(k == 2, "Subtitle").when(k == 3, F.concat(F.lit("개요 "), size.cast("string"))).otherwise("Body")
    return table(spark, sf_dir, "part").select("p_partkey", st.heading_of_style(name, F.when(k == 4, size - 25).otherwise(0)).alias("heading"))


@query("prj19_section_order", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_custkey AS INTEGER) END AS section, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CASE WHEN o_orderkey % 4 < 3 THEN o_custkey END NULLS FIRST, o_orderkey) AS place FROM orders")
def _(spark, sf_dir):
    name = F.when(F.col("o_orderkey") % 4 < 3, F.concat(F.lit("Contents/section"), F.col("o_custkey").cast("string"), F.lit(".xml"))).otherwise("Contents/header.xml")
    rows = table(spark, sf_dir, "orders").withColumn("section", st.section_index(name))
    return rows.select("o_orderkey", "section", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.asc_nulls_first("section"), "o_orderkey")).cast("long").alias("place"))


@query("prj20_page_ranges", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 1 THEN 0 ELSE greatest(0, o_custkey - 1) END AS lo, CASE o_orderkey % 5 WHEN 0 THEN o_custkey + 9 WHEN 1 THEN o_custkey WHEN 2 THEN 1000000000 WHEN 3 THEN o_custkey END AS hi FROM orders")
def _(spark, sf_dir):
    n, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 5
    t = F.when(k == 0, F.concat(n, F.lit("-"), (F.col("o_custkey") + 9).cast("string"))).when(k == 1, F.concat(F.lit("-"), n)).when(k == 2, F.concat(n, F.lit("-"))).when(k == 3, n).otherwise("x-y")
    t = F.when((k == 3) & (F.col("o_custkey") == 0), "0").otherwise(t)
    r = st.page_range(t)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 3, F.greatest(F.lit(0), r["lo"])).otherwise(r["lo"]).cast("long").alias("lo"), r["hi"].cast("long").alias("hi"))


@query("src54_span_styles", "SELECT event_id, (f & 16) <> 0 OR event_type = 'view' AS bold, (f & 2) <> 0 OR event_type = 'click' AS italic, (f & 1) <> 0 AS superscript, CASE WHEN user_id > 0 THEN ((user_id * 65536 + 7) >> 16) & 255 END AS r FROM (SELECT *, event_id % 32 AS f FROM events)")
def _(spark, sf_dir):
    font = F.when(F.col("event_type") == "view", "Sans-SemiBold").when(F.col("event_type") == "click", "Sans Oblique")
    colour = F.when(F.col("user_id") > 0, F.col("user_id") * 65536 + 7).otherwise(0)
    return table(spark, sf_dir, "events").select("event_id", F.inline(F.array(st.span_style(F.col("event_id") % 32, font, colour))))


@query("src38_hwp_header", "SELECT o_orderkey, '5.' || (o_custkey % 4) || '.' || (o_custkey % 7) || '.0' AS version, (o_orderkey % 8) & 1 <> 0 AS compressed, (o_orderkey % 8) & 2 <> 0 AS encrypted, (o_orderkey % 8) & 4 <> 0 AS distribution FROM orders")
def _(spark, sf_dir):
    byte = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    content = F.unhex(F.concat(F.repeat(F.lit("00"), F.lit(32)), F.lit("00"), byte(F.col("o_custkey") % 7), byte(F.col("o_custkey") % 4), F.lit("05"), byte(F.col("o_orderkey") % 8), F.lit("000000")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(F.array(st.hwp_header(content))))


@query("src45_fixed_offsets", "SELECT o_orderkey, o_custkey AS col, o_orderkey AS width FROM orders")
def _(spark, sf_dir):
    le = lambda c, n: F.concat(*(F.lpad(F.hex(F.shiftright(c, 8 * i).bitwiseAND(255)), 2, "0") for i in range(n)))
    content = F.unhex(F.concat(F.lit("FFFF"), le(F.col("o_custkey"), 8), le(F.col("o_orderkey"), 8), F.lit("AB")))  # fields as wide as the keys
    return table(spark, sf_dir, "orders").select("o_orderkey", st.little_endian(content, 2, 8).alias("col"), st.little_endian(content, 10, 8).alias("width"))


@query("src47_picture_kinds", "SELECT o_orderkey, ['jpeg', 'gif', 'bmp', 'png', 'png'][o_orderkey % 5 + 1] AS kind FROM orders")
def _(spark, sf_dir):
    heads = F.array(*map(F.lit, ("FFD8FFE0", "474946383961", "424D0000", "89504E47", "00")))
    return table(spark, sf_dir, "orders").select("o_orderkey", st.picture_kind(F.unhex(heads[(F.col("o_orderkey") % 5).cast("int")])).alias("kind"))


@query("src48_preview_text", f"SELECT doc_id, ord, line AS text FROM {LINES}")
def _(spark, sf_dir):
    preview = F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-16LE")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(ru.preview_lines(preview)).alias("ord", "text"))


@query("src10_md_cells", "SELECT o_orderkey, [trim(o_orderstatus), '', CAST(o_custkey AS VARCHAR)][i] AS cell, i AS c FROM orders, (VALUES (1), (2), (3)) v(i)")
def _(spark, sf_dir):
    line = F.concat(F.lit(" | "), "o_orderstatus", F.lit(" ||  "), F.col("o_custkey").cast("string"), F.lit(" | "))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(md_cells(line)).alias("c", "cell")).withColumn("c", F.col("c") + 1)


@query("src09_md_scan", "SELECT doc_id, ord, CASE k WHEN 0 THEN CAST(doc_id % 6 + 1 AS INTEGER) ELSE 0 END AS heading, CASE k WHEN 1 THEN 'bullet' WHEN 2 THEN 'number' ELSE 'none' END AS list_kind, CASE k WHEN 1 THEN 1 ELSE 0 END AS level, CASE WHEN line = '' THEN '' ELSE line END AS text FROM (SELECT doc_id, ord, ord % 5 AS k, regexp_replace(line, '[^A-Za-z]', '', 'g') || 'x' AS line FROM " + LINES + ")")
def _(spark, sf_dir):
    """Lines turned to Markdown headings, items and paragraphs, read back."""
    from vellumine.sources.text import md_lines

    word = F.concat(F.regexp_replace("line", "[^A-Za-z]", ""), F.lit("x"))
    k = F.col("ord") % 5
    made = F.when(k == 0, F.concat(F.repeat(F.lit("#"), (F.col("doc_id") % 6 + 1).cast("int")), F.lit(" "), word)).when(k == 1, F.concat(F.lit("  - "), word)).when(k == 2, F.concat(F.lit("3. "), word)).otherwise(word)
    docs = lines(spark, sf_dir).withColumn("m", made).groupBy("doc_id").agg(joined("m", "\n").alias("text"))
    return md_lines(docs).select("doc_id", "ord", "heading", "list_kind", "level", "text")


@query("fn23_md_links", "SELECT page_id, 'to ' || (page_id % 9) AS label, url AS href FROM pages")
def _(spark, sf_dir):
    text = F.concat(F.lit("see [to "), (F.col("page_id") % 9).cast("string"), F.lit("]("), "url", F.lit(") and more"))
    return table(spark, sf_dir, "pages").select("page_id", F.inline(md_links(text)))


@query("fn29_routes", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'doc → docx → xls' ELSE 'doc → xls' END AS route, CASE WHEN o_custkey % 3 = 0 THEN '실패  f' || o_orderkey || '  bad' ELSE '완료  f' || o_orderkey || '  ' || printf('%.2f', o_totalprice) || 's' END AS summary FROM orders")
def _(spark, sf_dir):
    via = F.when(F.col("o_custkey") % 2 == 0, "docx")
    name, error = F.concat(F.lit("f"), F.col("o_orderkey").cast("string")), F.when(F.col("o_custkey") % 3 == 0, "bad")
    return table(spark, sf_dir, "orders").select("o_orderkey", ru.route_text(F.lit("doc"), via, F.lit("xls")).alias("route"), ru.summary_text(name, F.col("o_totalprice"), error).alias("summary"))


@query("fn20_grid_spans", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(greatest(1, coalesce(CASE WHEN l_partkey % 4 > 0 THEN l_linenumber - 3 END, 1)) AS INTEGER) AS span, CASE l_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'continue' ELSE 'restart' END AS state FROM lineitem")
def _(spark, sf_dir):
    span = ru.grid_span(F.when(F.col("l_partkey") % 4 > 0, F.col("l_linenumber") - 3))
    present, value = F.col("l_partkey") % 3 > 0, F.when(F.col("l_partkey") % 3 == 2, "restart")
    return kinds(spark, sf_dir, span=span, state=ru.merge_state(present, value))


@query("fn32_cells_of_text", "SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE 1 END AS blocks FROM orders")
def _(spark, sf_dir):
    """An empty text makes a cell without a block."""
    text = F.when(F.col("o_custkey") % 4 == 0, "").otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(ru.cell_blocks(text)).alias("blocks"))


@query("join02_style_by_position", "WITH d AS (SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos, s_name FROM supplier) SELECT event_id, coalesce(s_name, 'default') AS style FROM events LEFT JOIN d ON d.s_nationkey = events.user_id % 25 AND d.pos = events.event_id % 7")
def _(spark, sf_dir):
    """Nations are documents, their suppliers the list of styles; a position beyond the list has the default."""
    listed = ru.positions(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("doc"), "s_suppkey", F.col("s_name").alias("style")), "doc", "s_suppkey")
    refs = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 25).alias("doc"), (F.col("event_id") % 7).alias("pos"))
    return ru.by_position(refs, listed, "doc", "style", "default").select("event_id", "style")


@query("join04_binary_streams", "SELECT p_partkey, min(name) AS stream FROM (SELECT p_partkey, printf('%04X', p_partkey % 50) AS k FROM part) p JOIN (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'BIN' ELSE 'x1' END || printf('%04X', s_suppkey) || '.png' AS name FROM supplier) s ON contains(upper(s.name), p.k) GROUP BY p_partkey")
def _(spark, sf_dir):
    """The first stream whose name holds the number, wherever in the name."""
    hex4 = lambda c: F.lpad(F.hex(c), 4, "0")
    streams = table(spark, sf_dir, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "BIN").otherwise("x1"), hex4(F.col("s_suppkey")), F.lit(".png")).alias("name"))
    asked = table(spark, sf_dir, "part").select("p_partkey", hex4(F.col("p_partkey") % 50).alias("k"))
    return ru.streams_of(asked, streams, "p_partkey")


@query("join06_style_of_position", f"WITH r AS (SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY user_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM {RUNS}), t AS (SELECT user_id, string_agg(text, '' ORDER BY ord) AS all_text FROM {RUNS} GROUP BY user_id) SELECT user_id, ord, substr(all_text, start + 1, length(text)) AS text FROM r JOIN t USING (user_id)")
def _(spark, sf_dir):
    """Runs cut from a paragraph's text by the places where styles start."""
    r = runs(spark, sf_dir)
    whole = ru.paragraph_text(r, "user_id").withColumnRenamed("text", "all_text")
    return ru.cut_by_starts(ru.starts_of(r, "user_id").drop("text"), whole, "user_id")


@query("join09_font_choice", "SELECT event_id, coalesce(CASE WHEN event_type IN ('view', 'click') THEN 'hangul-' || (user_id % 4) END, CASE WHEN user_id % 2 = 0 THEN 'latin-' || (user_id % 3) END) AS font FROM events")
def _(spark, sf_dir):
    hangul, latin = F.when(F.col("event_type").isin("view", "click"), F.col("user_id") % 4), F.when(F.col("user_id") % 2 == 0, F.col("user_id") % 3)
    return table(spark, sf_dir, "events").select("event_id", ru.font_of_style(hangul, latin).alias("font"))


@query("join13_image_names", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'image' || dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS name FROM lineitem")
def _(spark, sf_dir):
    """Each image of an order once, named by its place; references take its name."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return ru.image_names(lines, "l_orderkey", "l_partkey")


@query("agg11_run_extremes", f"SELECT user_id, para, max(size_pt) AS size, bool_and(bold) AS all_bold FROM {RUNS} GROUP BY user_id, para")
def _(spark, sf_dir):
    return ru.run_extremes(runs(spark, sf_dir), "user_id", "para")


@query("agg21_font_of_language", "SELECT user_id, coalesce(max_by(event_type, event_id) FILTER (event_id % 4 = 0), min_by(event_type, event_id)) AS font FROM events GROUP BY user_id")
def _(spark, sf_dir):
    return ru.font_of_id(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", F.col("event_id") % 4 == 0)


@query("agg22_column_count", f"SELECT table_id, max(c + CASE WHEN c = 3 THEN 1 + r % 2 ELSE 1 END) AS n_cols FROM {CELLS} GROUP BY table_id")
def _(spark, sf_dir):
    span = F.when(F.col("c") == 3, 1 + F.col("r") % 2)
    return ru.column_count(cells(spark, sf_dir).withColumn("col_span", span))


@query("agg25_scan_warning", "SELECT conv_id, sum(length(CASE WHEN conv_id % 3 = 0 THEN '' ELSE text END)) = 0 AS scanned FROM conversations GROUP BY conv_id")
def _(spark, sf_dir):
    text = F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.col("text"))
    return ru.scanned(table(spark, sf_dir, "conversations").withColumn("text", text), "conv_id")


@query("prj01_paragraph_text", f"SELECT user_id, para, string_agg(text, '' ORDER BY ord) AS text FROM {RUNS} GROUP BY user_id, para")
def _(spark, sf_dir):
    return ru.paragraph_text(runs(spark, sf_dir), "user_id", "para")


@query("prj08_placeholders", f"SELECT table_id, r, c, CASE WHEN (r + c) % 3 = 0 THEN '' ELSE text END AS text FROM {CELLS}")
def _(spark, sf_dir):
    return cells(spark, sf_dir).withColumn("text", ru.shown(F.col("text"), (F.col("r") + F.col("c")) % 3 == 0))


@query("prj10_hidden_sheets", "SELECT s_suppkey, s_name, CASE s_suppkey % 4 WHEN 0 THEN 'hidden' WHEN 1 THEN 'veryHidden' ELSE 'visible' END = 'visible' AS kept FROM supplier")
def _(spark, sf_dir):
    """Hidden sheets are left out and warned of: kept says which."""
    state = F.when(F.col("s_suppkey") % 4 == 0, "hidden").when(F.col("s_suppkey") % 4 == 1, "veryHidden").when(F.col("s_suppkey") % 4 == 2, "visible")
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", ru.sheet_visible(state).alias("kept"))


@query("snk04_md_paragraphs", f"SELECT doc_id, ord, CASE WHEN trim(text) = '' THEN '' WHEN heading > 0 THEN chr(10) || repeat('#', least(6, heading)) || ' ' || trim(text) || chr(10) WHEN list_kind = 'bullet' THEN repeat('  ', level) || '- ' || trim(text) WHEN list_kind = 'number' THEN repeat('  ', level) || '1. ' || trim(text) ELSE trim(text) || chr(10) END AS md FROM {BLOCKS}")
def _(spark, sf_dir):
    return blocks(spark, sf_dir).select("doc_id", "ord", md_paragraph(F.col("text"), F.col("heading"), F.col("list_kind"), F.col("level")).alias("md"))


@query("snk07_html_page", f"SELECT doc_id, string_agg(opens || '<li>' || text || '</li>' || closes, '' ORDER BY ord) FILTER (list_kind <> 'none') AS html FROM (SELECT *, CASE WHEN list_kind <> 'none' AND list_kind <> lag(list_kind, 1, 'none') OVER w THEN CASE list_kind WHEN 'bullet' THEN '<ul>' ELSE '<ol>' END ELSE '' END AS opens, CASE WHEN list_kind <> 'none' AND list_kind <> lead(list_kind, 1, 'none') OVER w THEN CASE list_kind WHEN 'bullet' THEN '</ul>' ELSE '</ol>' END ELSE '' END AS closes FROM {BLOCKS} WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) GROUP BY doc_id")
def _(spark, sf_dir):
    from vellumine.operators.blocks import list_wrappers

    b = list_wrappers(blocks(spark, sf_dir)).where("list_kind <> 'none'")
    return b.withColumn("item", F.concat("opens", F.lit("<li>"), "text", F.lit("</li>"), "closes")).groupBy("doc_id").agg(joined("item", "").alias("html"))


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


@query("snk07_whole_pages", f"""WITH b AS (SELECT * REPLACE (CASE WHEN kind = 'page_break' THEN 'none' ELSE list_kind END AS list_kind) FROM {BLOCKS}),
t AS (SELECT doc_id, coalesce(arg_min(left(regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'), 120), ord) FILTER (regexp_matches(text, '[^{SPACE}]')), '') AS title FROM b GROUP BY doc_id),
h AS (SELECT doc_id, ord, CASE WHEN list_kind <> 'none' AND list_kind <> lag(list_kind, 1, 'none') OVER w THEN CASE list_kind WHEN 'bullet' THEN '<ul>' ELSE '<ol>' END ELSE '' END
  || CASE WHEN kind = 'page_break' THEN '<hr>' WHEN list_kind <> 'none' THEN '<li>' || {_ESC.format('text')} || '</li>' WHEN NOT regexp_matches(text, '[^{SPACE}]') THEN '<p>&nbsp;</p>' WHEN heading > 0 THEN '<h' || least(6, heading) || '>' || {_ESC.format('text')} || '</h' || least(6, heading) || '>' ELSE '<p>' || {_ESC.format('text')} || '</p>' END
  || CASE WHEN list_kind <> 'none' AND list_kind <> lead(list_kind, 1, 'none') OVER w THEN CASE list_kind WHEN 'bullet' THEN '</ul>' ELSE '</ol>' END ELSE '' END AS html FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head><meta charset="utf-8"><title>' || {_ESC.format('any_value(title)')} || '</title></head>' || chr(10) || '<body>' || chr(10) || string_agg(html, chr(10) ORDER BY ord) || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) AS html FROM h JOIN t USING (doc_id) GROUP BY doc_id""")
def _(spark, sf_dir):
    from vellumine.operators.blocks import html_pages

    return html_pages(blocks(spark, sf_dir))


@query("fn21_sheet_columns", "SELECT c_custkey, CASE WHEN n > 702 THEN chr(CAST(65 + (n - 703) // 676 AS INTEGER)) ELSE '' END || CASE WHEN n > 26 THEN chr(CAST(65 + (n - 27) // 26 % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) AS letters, CAST(n AS INTEGER) AS number, CASE WHEN w > 0 THEN w * 7 * 72 / 96 END AS pt FROM (SELECT c_custkey, 1 + c_custkey * 37 % 16384 AS n, floor(c_acctbal / 100) AS w FROM customer)")
def _(spark, sf_dir):
    """Columns by their letters, with the widths that the sheet declares, in points; no width where it declares none."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (1 + F.col("c_custkey") * 37 % 16384).cast("int").alias("n"), F.floor(F.col("c_acctbal") / 100).cast("double").alias("w"))
    letters = c.select("c_custkey", "w", ru.column_letters(F.col("n")).alias("letters"))
    return letters.select("c_custkey", "letters", ru.column_number(F.col("letters")).alias("number"), F.when(F.col("w") > 0, F.col("w") * 7 * 72 / 96).alias("pt"))


@query("snk14_sheet_files", "SELECT c_custkey, CASE WHEN n = 1 THEN 'book' || c_nationkey || '.csv' ELSE 'book' || c_nationkey || '_' || c_mktsegment || '.csv' END AS file FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer)")
def _(spark, sf_dir):
    """The primary sheet takes the book's name, the others add their own."""
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    book = F.concat(F.lit("book"), F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").withColumn("n", n).select("c_custkey", ru.sheet_file(book, F.col("c_mktsegment"), F.col("n") == 1).alias("file"))


@query("snk21_properties", "SELECT doc_id, left(text, 255) AS title FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ru.core_property(F.col("text")).alias("title"))


@query("snk30_fallback_pages", f"""SELECT doc_id, n // 50 AS page, string_agg(piece, chr(10) ORDER BY n) AS text FROM (
  SELECT doc_id, piece, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord, k) - 1 AS INTEGER) AS n FROM (SELECT doc_id, ord, k, substr(line, k * 90 + 1, 90) AS piece FROM (SELECT doc_id, ord, translate(line, 'éèêàâäöüßñáíóúç', 'eeeaaaousnaiouc') AS line, unnest(range(0, greatest(1, CAST(ceil(length(line) / 90) AS BIGINT)))) AS k FROM {LINES}))) GROUP BY doc_id, n // 50""")
def _(spark, sf_dir):
    """Documents as plain pages of 50 lines, each wrapped at 90 cells."""
    plain = F.translate("line", "éèêàâäöüßñáíóúç", "eeeaaaousnaiouc")
    pieces = lines(spark, sf_dir).select("doc_id", "ord", F.posexplode(folds.wrap(plain)).alias("k", "piece"))
    at = pieces.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "k")) - 1)
    return at.groupBy("doc_id", ru.plain_page(F.col("n")).alias("page")).agg(joined("piece", "\n", "n").alias("text"))


@query("snk33_verified_outputs", "SELECT o_orderkey, o_custkey % 5 > 0 AND o_custkey % 3 <> 1 AS ok FROM orders")
def _(spark, sf_dir):
    """An output is good if it is not empty and its first bytes are those of its format."""
    content = F.when(F.col("o_custkey") % 5 == 0, "").when(F.col("o_custkey") % 3 == 1, "text").otherwise("%PDF-1.4")
    kind = fm.sniff(F.encode(content, "UTF-8"))
    return table(spark, sf_dir, "orders").select("o_orderkey", ((F.length(content) > 0) & F.coalesce(kind == "pdf", F.lit(False))).alias("ok"))


@query("top01_heaviest", "SELECT l_suppkey, arg_max(l_partkey, (l_extendedprice, -l_partkey)) AS heaviest FROM lineitem GROUP BY l_suppkey")
def _(spark, sf_dir):
    return ru.heaviest(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", "l_extendedprice")


@query("set01_page_items", f"SELECT page, n, 'text' AS kind FROM {RECTS} WHERE n % 50 > 1 UNION ALL SELECT page, n, 'table' AS kind FROM {RECTS} WHERE n % 50 = 1 UNION ALL SELECT page, n, 'image' AS kind FROM {RECTS} WHERE n % 50 = 0")
def _(spark, sf_dir):
    r, k = rects(spark, sf_dir).select("page", "n"), F.col("n") % 50
    return ru.page_items(r.where(k > 1), r.where(k == 1), r.where(k == 0))


@query("set04_members", f"{_LINE} FROM lineitem WHERE upper({_KIND}) IN ('BOTTOM', 'CENTER', 'TOP')")
def _(spark, sf_dir):
    wanted = spark.createDataFrame([(u,) for u in st.UNDERLINE], "kind string")
    rows = kinds(spark, sf_dir, kind=F.upper("kind"))
    return rows.join(F.broadcast(wanted), "kind", "left_semi").drop("kind")


@query("src50_page_merge", f"SELECT page, n, kind, row_number() OVER (PARTITION BY page ORDER BY y0, CASE kind WHEN 'table' THEN 0 WHEN 'text' THEN 1 ELSE 2 END, n) AS place FROM (SELECT page, n, y0, CASE n % 50 WHEN 1 THEN 'table' WHEN 0 THEN 'image' ELSE 'text' END AS kind FROM {RECTS})")
def _(spark, sf_dir):
    k = F.col("n") % 50
    r = rects(spark, sf_dir).withColumn("kind", F.when(k == 1, "table").when(k == 0, "image").otherwise("text"))
    return ru.page_order(r, ru.item_rank(F.col("kind")), F.col("n")).select("page", "n", "kind", "place")


@query("src53_unique_images", "SELECT l_suppkey, l_partkey, 'page' || l_suppkey || '_img' || l_partkey AS name FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)")
def _(spark, sf_dir):
    each = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return each.withColumn("name", ru.page_image(F.col("l_suppkey"), F.col("l_partkey")))


@query("win04_next_character", f"SELECT doc_id, ord, left(lead(line) OVER w, 1) AS after, coalesce(left(lead(line) OVER w, 1) = '漢', false) AS cjk FROM (SELECT doc_id, ord, CASE WHEN ord % 3 = 0 THEN '漢' ELSE '' END || line AS line FROM {LINES}) WINDOW w AS (PARTITION BY doc_id ORDER BY ord)")
def _(spark, sf_dir):
    """Every third line begins with a Hanja."""
    made = lines(spark, sf_dir).withColumn("line", F.concat(F.when(F.col("ord") % 3 == 0, "漢").otherwise(""), "line"))
    return ru.next_character(made, "doc_id").select("doc_id", "ord", "after", "cjk")


@query("fn28_wrap", f"SELECT doc_id, ord, CAST(n AS INTEGER) AS n, substr(line, n * k + 1, k) AS piece FROM (SELECT doc_id, ord, line, k, unnest(range(0, greatest(1, CAST(ceil(length(line) / k) AS BIGINT)))) AS n FROM (SELECT doc_id, ord, CASE WHEN ord % 2 = 1 THEN repeat('漢', CAST(length(line) AS INTEGER)) ELSE line END AS line, CASE WHEN ord % 2 = 1 THEN 45 ELSE 90 END AS k FROM {LINES}))")
def _(spark, sf_dir):
    """Lines of at most 90 cells; wide characters, here every second line's, take two."""
    made = F.when(F.col("ord") % 2 == 1, F.repeat(F.lit("漢"), F.length("line"))).otherwise(F.col("line"))
    return lines(spark, sf_dir).select("doc_id", "ord", F.posexplode(folds.wrap(made)).alias("n", "piece"))
"""Block and run operators over documents shredded into lines.

The driver's documents have no blank runs, lists or tables, so kinds, list kinds,
headings and blanks are derived from the place of a line, in the same way in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.functions.text import CJK
from vellumine.operators import blocks as ops
from vellumine.operators.numbering import first_seen
from vellumine.operators.probes import containing
from vellumine.plans.registry import query
from vellumine.plans.scalars import SPACE
from vellumine.shared import table
from vellumine.sources.text import txt_blocks

LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS ord FROM documents)"
BLOCKS = f"""(SELECT doc_id, ord, CASE WHEN ord % 5 IN (2, 3) THEN '' ELSE line END AS text,
  CASE ord % 11 WHEN 4 THEN 'table' WHEN 6 THEN 'image' WHEN 9 THEN 'page_break' ELSE 'paragraph' END AS kind,
  CASE WHEN ord % 9 IN (0, 1) THEN 'bullet' WHEN ord % 9 = 2 THEN 'number' ELSE 'none' END AS list_kind,
  CASE WHEN ord % 10 = 0 THEN CAST(doc_id % 8 AS INTEGER) ELSE 0 END AS heading, ord % 3 AS level,
  CASE WHEN ord % 13 = 5 THEN 0 END AS parent, CASE WHEN ord % 2 = 0 THEN 'T' || ord END AS name FROM {LINES})"""
BLANK = f"NOT regexp_matches(text, '[^{SPACE}]')"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lambda n: F.col("ord") % n
    return lines(spark, sf_dir).select(
        "doc_id",
        "ord",
        F.when(k(5).isin(2, 3), "").otherwise(F.col("line")).alias("text"),
        F.when(k(11) == 4, "table").when(k(11) == 6, "image").when(k(11) == 9, "page_break").otherwise("paragraph").alias("kind"),
        F.when(k(9).isin(0, 1), "bullet").when(k(9) == 2, "number").otherwise("none").alias("list_kind"),
        F.when(k(10) == 0, (F.col("doc_id") % 8).cast("int")).otherwise(0).alias("heading"),
        k(3).alias("level"),
        F.when(k(13) == 5, 0).alias("parent"),
        F.when(k(2) == 0, F.concat(F.lit("T"), F.col("ord").cast("string"))).alias("name"),
    )


@query("src08_txt_scan", f"SELECT doc_id, ord, line AS text FROM (SELECT *, {BLANK.replace('text', 'line')} AS e, lag({BLANK.replace('text', 'line')}, 1, false) OVER (PARTITION BY doc_id ORDER BY ord) AS p FROM {LINES}) WHERE NOT (e AND p)")
def _(spark, sf_dir):
    return txt_blocks(table(spark, sf_dir, "documents")).select("doc_id", "ord", "text")


@query("win01_compact", f"SELECT doc_id, ord, kind, text FROM (SELECT *, kind = 'paragraph' AND {BLANK} AS e, lag(kind = 'paragraph' AND {BLANK}, 1, false) OVER (PARTITION BY doc_id ORDER BY ord) AS p FROM {BLOCKS}) WHERE NOT (e AND p)")
def _(spark, sf_dir):
    return ops.compact(blocks(spark, sf_dir)).select("doc_id", "ord", "kind", "text")


RUNS = "(SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS ord, event_type AS text, value > 10 AS bold, CASE WHEN event_type IN ('view', 'click') THEN 'sans' END AS font, 8 + user_id % 3 + CASE WHEN value > 30 THEN 6 WHEN value > 15 THEN 3 ELSE 0 END AS size_pt, event_id // 4 AS para FROM events)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("ord"),
        F.col("event_type").alias("text"),
        (F.col("value") > 10).alias("bold"),
        F.when(F.col("event_type").isin("view", "click"), "sans").alias("font"),
        (8 + F.col("user_id") % 3 + F.when(F.col("value") > 30, 6).when(F.col("value") > 15, 3).otherwise(0)).alias("size_pt"),
        F.floor(F.col("event_id") / 4).alias("para"),
    )


@query("agg02_merge_runs", f"""SELECT user_id, island, any_value(bold) AS bold, any_value(font) AS font, string_agg(text, '' ORDER BY ord) AS text FROM (
  SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ord) AS BIGINT) AS island FROM (
    SELECT *, CASE WHEN row_number() OVER w > 1 AND bold IS NOT DISTINCT FROM lag(bold) OVER w AND font IS NOT DISTINCT FROM lag(font) OVER w THEN 0 ELSE 1 END AS n FROM {RUNS} WINDOW w AS (PARTITION BY user_id ORDER BY ord))) GROUP BY user_id, island""")
def _(spark, sf_dir):
    return ops.merge_runs(runs(spark, sf_dir), "user_id", ["bold", "font"]).select("user_id", "island", "bold", "font", "text")


@query("agg10_heading_sizes", f"""WITH s AS (SELECT *, length(text) AS chars FROM {RUNS}),
  m AS (SELECT user_id AS doc_id, median(size_pt) AS body FROM (SELECT user_id, size_pt, unnest(range(chars)) AS i FROM s) GROUP BY user_id),
  p AS (SELECT user_id AS doc_id, para, max(size_pt) AS size, bool_and(bold) AS b, length(string_agg(text, '')) AS n FROM s GROUP BY user_id, para)
  SELECT p.doc_id, para, CASE WHEN n > 120 THEN 0 WHEN size / body >= 1.55 THEN 1 WHEN size / body >= 1.28 THEN 2 WHEN size / body >= 1.12 AND b THEN 3 ELSE 0 END AS heading FROM p JOIN m USING (doc_id)""")
def _(spark, sf_dir):
    return ops.heading_by_size(runs(spark, sf_dir).withColumnRenamed("user_id", "doc_id"), 1.55, 1.28, 1.12)


@query("win05_list_wrappers", f"""SELECT doc_id, ord, CASE WHEN list_kind <> 'none' AND list_kind <> lag(list_kind, 1, 'none') OVER w THEN CASE list_kind WHEN 'bullet' THEN '<ul>' ELSE '<ol>' END ELSE '' END AS opens,
  CASE WHEN list_kind <> 'none' AND list_kind <> lead(list_kind, 1, 'none') OVER w THEN CASE list_kind WHEN 'bullet' THEN '</ul>' ELSE '</ol>' END ELSE '' END AS closes FROM {BLOCKS} WINDOW w AS (PARTITION BY doc_id ORDER BY ord)""")
def _(spark, sf_dir):
    return ops.list_wrappers(blocks(spark, sf_dir)).select("doc_id", "ord", "opens", "closes")


@query("win06_table_numbers", f"SELECT doc_id, ord, CASE WHEN kind = 'table' THEN n END AS table_no, CASE WHEN kind = 'table' THEN '[표 ' || n || ': ' || text || ']' ELSE text END AS line FROM (SELECT *, count(*) FILTER (kind = 'table') OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM {BLOCKS})")
def _(spark, sf_dir):
    return ops.number_tables(blocks(spark, sf_dir)).select("doc_id", "ord", "table_no", "line")


@query("win07_unique_names", "SELECT n_nationkey, ord, CASE WHEN k = 1 THEN name ELSE left(name, least(length(name), 31 - length('_' || k))) || '_' || k END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY n_nationkey, name ORDER BY ord) AS k FROM (SELECT c_nationkey AS n_nationkey, c_custkey AS ord, repeat(c_mktsegment, 1 + c_custkey % 4) AS name FROM customer))")
def _(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("ord"), F.expr("repeat(c_mktsegment, cast(1 + c_custkey % 4 as int))").alias("name"))
    return ops.unique_names(names, "n_nationkey").select("n_nationkey", "ord", "unique_name")


@query("agg01_document_stats", f"SELECT doc_id, count(*) FILTER (parent IS NULL) AS blocks, count(*) FILTER (kind = 'paragraph') AS paragraphs, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind = 'image') AS images, CAST(coalesce(sum(length(text)) FILTER (kind = 'paragraph'), 0) AS BIGINT) AS characters FROM {BLOCKS} GROUP BY doc_id")
def _(spark, sf_dir):
    return ops.stats(blocks(spark, sf_dir))


@query("prj05_empty_documents", f"SELECT doc_id FROM (SELECT doc_id, ord, parent, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS text, CASE WHEN kind IN ('table', 'image') AND doc_id % 2 = 0 THEN 'paragraph' ELSE kind END AS kind FROM {BLOCKS}) GROUP BY doc_id HAVING NOT bool_or(parent IS NULL AND (kind IN ('table', 'image') OR (kind = 'paragraph' AND NOT ({BLANK}))))")
def _(spark, sf_dir):
    b = blocks(spark, sf_dir)
    b = b.withColumn("text", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text"))).withColumn("kind", F.when(F.col("kind").isin("table", "image") & (F.col("doc_id") % 2 == 0), "paragraph").otherwise(F.col("kind")))
    return ops.empty_documents(b)


@query("prj03_top_paragraphs", f"SELECT doc_id, ord, text FROM {BLOCKS} WHERE kind = 'paragraph' AND parent IS NULL")
def _(spark, sf_dir):
    return blocks(spark, sf_dir).where("kind = 'paragraph' and parent is null").select("doc_id", "ord", "text")


@query("prj04_tables_and_images", f"SELECT doc_id, ord, kind FROM {BLOCKS} WHERE kind IN ('table', 'image')")
def _(spark, sf_dir):
    return blocks(spark, sf_dir).where("kind in ('table', 'image')").select("doc_id", "ord", "kind")


@query("prj07_tables_only", f"SELECT doc_id, ord, kind, text FROM (SELECT *, count(*) FILTER (kind = 'table') OVER (PARTITION BY doc_id) AS n FROM {BLOCKS}) WHERE n = 0 OR kind = 'table'")
def _(spark, sf_dir):
    n = F.count_if(F.col("kind") == "table").over(Window.partitionBy("doc_id"))
    return blocks(spark, sf_dir).withColumn("n", n).where("n = 0 or kind = 'table'").select("doc_id", "ord", "kind", "text")


@query("agg20_titles", f"SELECT doc_id, arg_min(left(regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'), 120), ord) FILTER (NOT ({BLANK})) AS title FROM {BLOCKS} GROUP BY doc_id")
def _(spark, sf_dir):
    return ops.titles(blocks(spark, sf_dir))


@query("agg06_to_text", f"SELECT doc_id, string_agg(CASE WHEN kind = 'page_break' THEN chr(12) WHEN kind = 'table' AND name IS NOT NULL THEN '# ' || name || chr(10) || text ELSE text END, chr(10) ORDER BY ord) AS text FROM {BLOCKS} GROUP BY doc_id")
def _(spark, sf_dir):
    return ops.to_text(blocks(spark, sf_dir))


@query("snk01_txt", f"SELECT doc_id, string_agg(CASE list_kind WHEN 'bullet' THEN repeat('  ', level) || '- ' || text WHEN 'number' THEN repeat('  ', level) || '1. ' || text ELSE text END, chr(10) ORDER BY ord) || chr(10) AS txt FROM {BLOCKS} GROUP BY doc_id")
def _(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("line", ops.txt_line(F.col("list_kind"), F.col("level"), F.col("text")))
    return b.groupBy("doc_id").agg(F.concat(ops.joined("line", "\n"), F.lit("\n")).alias("txt"))


_MD = f"CASE WHEN t = '' THEN '' WHEN heading > 0 THEN chr(10) || repeat('#', least(6, heading)) || ' ' || t || chr(10) WHEN list_kind = 'bullet' THEN repeat('  ', level) || '- ' || t WHEN list_kind = 'number' THEN repeat('  ', level) || '1. ' || t ELSE t || chr(10) END"


@query("snk03_markdown", f"SELECT doc_id, replace(string_agg({_MD}, chr(10) ORDER BY ord), chr(10) || chr(10) || chr(10), chr(10) || chr(10)) || chr(10) AS md FROM (SELECT *, regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS t FROM {BLOCKS}) GROUP BY doc_id")
def _(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("line", ops.md_paragraph(F.col("text"), F.col("heading"), F.col("list_kind"), F.col("level")))
    return b.groupBy("doc_id").agg(F.concat(F.replace(ops.joined("line", "\n"), F.lit("\n\n\n"), F.lit("\n\n")), F.lit("\n")).alias("md"))


@query("snk05_md_runs", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '[' || s || '](http://x/' || user_id || ')' ELSE s END AS md FROM (SELECT *, CASE WHEN value > 30 THEN '~~' || e || '~~' ELSE e END AS s FROM (SELECT *, CASE WHEN value > 10 AND user_id % 2 = 0 THEN '***' || t || '***' WHEN value > 10 THEN '**' || t || '**' WHEN user_id % 2 = 0 THEN '*' || t || '*' ELSE t END AS e FROM (SELECT *, replace(replace(replace(replace(replace(props || '_*' || chr(10), chr(10), '  ' || chr(10)), '\\', '\\\\'), '`', '\\`'), '*', '\\*'), '_', '\\_') AS t FROM events)))")
def _(spark, sf_dir):
    text, bold, italic = F.concat("props", F.lit("_*\n")), F.col("value") > 10, F.col("user_id") % 2 == 0
    href = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("http://x/"), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", ops.md_run(text, bold, italic, F.col("value") > 30, href).alias("md"))


@query("snk08_html_blocks", f"SELECT doc_id, ord, CASE WHEN {BLANK} THEN '<p>&nbsp;</p>' ELSE '<' || tag || CASE WHEN ord % 4 = 1 THEN ' style=\"text-align:center\"' ELSE '' END || '>' || text || '</' || tag || '>' END AS html FROM (SELECT *, CASE WHEN heading > 0 THEN 'h' || least(6, heading) ELSE 'p' END AS tag FROM {BLOCKS})")
def _(spark, sf_dir):
    align = F.when(F.col("ord") % 4 == 1, "center").otherwise("left")
    return blocks(spark, sf_dir).select("doc_id", "ord", ops.html_paragraph(F.col("text"), F.col("heading"), align).alias("html"))


@query("snk10_html_runs", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '<a href="http://x/?a=1&amp;b=2">' || u || '</a>' ELSE u END AS html FROM (SELECT *, CASE WHEN value > 30 THEN '<u>' || e || '</u>' ELSE e END AS u FROM (SELECT *, CASE WHEN value > 10 THEN '<strong>' || s || '</strong>' ELSE s END AS e FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN '<span style="font-size:' || (8 + user_id % 5) || '.0pt;color:#0A' || printf('%02X', user_id % 256) || 'FF">' || t || '</span>' ELSE t END AS s FROM (SELECT *, replace(replace(replace(replace(props, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), chr(10), '<br>') AS t FROM events))))""")
def _(spark, sf_dir):
    from vellumine.functions.colours import rgb

    even, no = F.col("user_id") % 2 == 0, F.lit(False)
    size, colour = F.when(even, (8 + F.col("user_id") % 5).cast("double")), F.when(even, rgb(F.lit(10), F.col("user_id") % 256, F.lit(255)))
    href = F.when(F.col("event_id") % 5 == 0, F.lit("http://x/?a=1&b=2"))
    return table(spark, sf_dir, "events").select("event_id", ops.html_run(F.col("props"), F.col("value") > 10, no, F.col("value") > 30, no, no, no, size, colour, href).alias("html"))


@query("win03_style_intervals", f"SELECT user_id, ord, start, lead(start, 1, start + length(text)) OVER (PARTITION BY user_id ORDER BY ord) AS stop FROM (SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY user_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM {RUNS})")
def _(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ord")
    r = runs(spark, sf_dir).withColumn("start", F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return r.withColumn("stop", F.coalesce(F.lead("start").over(w), F.col("start") + F.length("text"))).select("user_id", "ord", "start", "stop")


@query("win13_code_fences", f"SELECT doc_id, ord, f, n % 2 = 1 AND NOT f AS in_code FROM (SELECT *, count(*) FILTER (f) OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM (SELECT doc_id, ord, ord % 6 = 1 AS f FROM {LINES}))")
def _(spark, sf_dir):
    from vellumine.sources.text import in_fence

    r = lines(spark, sf_dir).withColumn("f", F.col("ord") % 6 == 1)
    return r.select("doc_id", "ord", "f", in_fence(F.col("f"), "doc_id", "ord").alias("in_code"))


@query("src52_join_lines", f"""SELECT doc_id, string_agg(CASE WHEN nx IS NULL THEN t WHEN ends_with(t, '-') THEN left(t, length(t) - 1) WHEN ends_with(t, ' ') OR (ord % 3 = 1 AND nx = '漢') THEN t ELSE t || ' ' END, '' ORDER BY ord) AS text FROM (
  SELECT *, left(lead(t) OVER (PARTITION BY doc_id ORDER BY ord), 1) AS nx FROM (SELECT doc_id, ord, CASE ord % 3 WHEN 0 THEN line || '-' WHEN 1 THEN line || '字' ELSE '漢' || line END AS t FROM {LINES})) GROUP BY doc_id""")
def _(spark, sf_dir):
    k = F.col("ord") % 3
    t = F.when(k == 0, F.concat("line", F.lit("-"))).when(k == 1, F.concat("line", F.lit("字"))).otherwise(F.concat(F.lit("漢"), "line"))
    return ops.join_lines(lines(spark, sf_dir).select("doc_id", "ord", t.alias("text")), "doc_id", CJK)


@query("win15_page_breaks", "SELECT conv_id, ord, kind FROM (SELECT conv_id, turn * 2 AS ord, 'page' AS kind FROM conversations UNION ALL SELECT conv_id, turn * 2 - 1 AS ord, 'page_break' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n > 1)")
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    return pages.select("conv_id", (F.col("turn") * 2).alias("ord"), F.lit("page").alias("kind")).unionByName(pages.where("n > 1").select("conv_id", (F.col("turn") * 2 - 1).alias("ord"), F.lit("page_break").alias("kind")))


@query("win10_page_labels", "SELECT conv_id, turn, '- ' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 + 5) || ' -' AS label FROM conversations")
def _(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1 + 5
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("- "), n.cast("string"), F.lit(" -")).alias("label"))


@query("agg13_style_ids", f"WITH s AS (SELECT event_type, value > 10 AS bold, min(event_id) AS seen FROM events GROUP BY ALL) SELECT event_type, bold, row_number() OVER (ORDER BY seen) AS id FROM s")
def _(spark, sf_dir):
    styled = table(spark, sf_dir, "events").select("event_id", F.struct("event_type", (F.col("value") > 10).alias("bold")).alias("style"))
    return first_seen(styled, "style", [F.col("event_id")]).select("style.event_type", "style.bold", (F.col("id") + 1).alias("id"))


@query("agg26_text_quality", "SELECT doc_id, contains(text, 'Licensed') AS hit, CAST(length(regexp_replace(text, '[^\\x{AC00}-\\x{D7A3}]', '', 'g')) AS BIGINT) AS hangul, CAST(length(text) - length(replace(text, chr(65533), '')) AS BIGINT) AS broken FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.contains("text", F.lit("Licensed")).alias("hit"), F.regexp_count("text", F.lit(r"[\x{AC00}-\x{D7A3}]")).cast("long").alias("hangul"), F.regexp_count("text", F.lit("�")).cast("long").alias("broken"))


@query("join14_probes", "SELECT item_id, count(*) AS documents FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def _(spark, sf_dir):
    """Documents that hold the whole text of an item."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("probe"))
    return containing(table(spark, sf_dir, "documents"), items).join(items, "probe").groupBy("item_id").agg(F.count("*").alias("documents"))

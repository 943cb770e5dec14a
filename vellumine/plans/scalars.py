"""Scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions import colours, text, units, values
from vellumine.plans.registry import query
from vellumine.shared import table

SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def lines(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*KEY, *(c.alias(n) for n, c in columns.items()))


@query("fn01_hwp_units", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey / 100.0::DOUBLE AS pt, CAST(round_even(l_quantity * 100, 0) AS BIGINT) AS hwp FROM lineitem")
def _(spark, sf_dir):
    return lines(spark, sf_dir, pt=units.hwp_to_pt(F.col("l_partkey")), hwp=units.pt_to_hwp(F.col("l_quantity")))


@query("fn02_emu_units", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CASE WHEN l_suppkey % 3 > 0 THEN l_partkey END / 12700.0::DOUBLE, 0) AS pt, CAST(round_even(l_quantity * 12700, 0) AS BIGINT) AS emu FROM lineitem")
def _(spark, sf_dir):
    return lines(spark, sf_dir, pt=units.emu_to_pt(F.when(F.col("l_suppkey") % 3 > 0, F.col("l_partkey"))), emu=units.pt_to_emu(F.col("l_quantity")))


@query("fn03_twip_units", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey / 20.0::DOUBLE AS pt, CAST(round_even(l_quantity * 20, 0) AS BIGINT) AS twip FROM lineitem")
def _(spark, sf_dir):
    return lines(spark, sf_dir, pt=units.twip_to_pt(F.col("l_partkey")), twip=units.pt_to_twip(F.col("l_quantity")))


@query("fn04_pixel_units", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 72.0::DOUBLE / 96.0::DOUBLE AS pt, l_quantity * 96.0::DOUBLE / 72.0::DOUBLE AS px FROM lineitem")
def _(spark, sf_dir):
    return lines(spark, sf_dir, pt=units.px_to_pt(F.col("l_quantity")), px=units.pt_to_px(F.col("l_quantity")))


@query("fn05_millimetres", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 25.4::DOUBLE * 72.0::DOUBLE AS pt, l_quantity / 72.0::DOUBLE * 25.4::DOUBLE AS mm FROM lineitem")
def _(spark, sf_dir):
    return lines(spark, sf_dir, pt=units.mm_to_pt(F.col("l_quantity")), mm=units.pt_to_mm(F.col("l_quantity")))


@query(
    "fn06_excel_widths",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 7.0::DOUBLE * 72.0::DOUBLE / 96.0::DOUBLE AS pt, CASE WHEN l_quantity - 25 <= 0 THEN 8.43::DOUBLE ELSE (l_quantity - 25) * 96.0::DOUBLE / 72.0::DOUBLE / 7.0::DOUBLE END AS width, l_quantity AS height FROM lineitem",
)
def _(spark, sf_dir):
    return lines(spark, sf_dir, pt=units.excel_width_to_pt(F.col("l_quantity")), width=units.pt_to_excel_width(F.col("l_quantity") - 25), height=units.excel_height_to_pt(F.col("l_quantity")))


_HEX = "CASE l_linenumber % 4 WHEN 0 THEN '#' || printf('%06X', (l_partkey * 7919) % 16777216) WHEN 1 THEN printf('%06X', (l_partkey * 7919) % 16777216) WHEN 2 THEN 'FF' || printf('%06x', (l_partkey * 7919) % 16777216) ELSE 'x' || l_partkey END"


def _hexed():
    n = F.lpad(F.hex((F.col("l_partkey") * 7919) % 16777216), 6, "0")
    k = F.col("l_linenumber") % 4
    return F.when(k == 0, F.concat(F.lit("#"), n)).when(k == 1, n).when(k == 2, F.concat(F.lit("FF"), F.lower(n))).otherwise(F.concat(F.lit("x"), F.col("l_partkey").cast("string")))


_RGB = "CASE WHEN l_linenumber % 4 < 3 THEN {'r': CAST(((l_partkey * 7919) % 16777216) >> 16 AS INTEGER), 'g': CAST((((l_partkey * 7919) % 16777216) >> 8) & 255 AS INTEGER), 'b': CAST(((l_partkey * 7919) % 16777216) & 255 AS INTEGER)} END"


@query("fn07_hex_to_rgb", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c.r AS r, c.g AS g, c.b AS b FROM (SELECT *, {_RGB} AS c FROM lineitem)")
def _(spark, sf_dir):
    c = colours.hex_to_rgb(_hexed())
    return lines(spark, sf_dir, r=c["r"], g=c["g"], b=c["b"])


@query("fn08_rgb_to_hex", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber > 1 THEN '#' || printf('%02X', least(255, CAST(l_quantity * 6 AS BIGINT))) || printf('%02X', l_partkey % 256) || printf('%02X', greatest(0, l_suppkey - 50)) END AS hex FROM lineitem")
def _(spark, sf_dir):
    c = F.when(F.col("l_linenumber") > 1, colours.rgb(F.col("l_quantity") * 6, F.col("l_partkey") % 256, F.col("l_suppkey") - 50))
    return lines(spark, sf_dir, hex=colours.rgb_to_hex(c))


@query("fn09_hwp_colours", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN n >= 0 THEN CAST(n & 255 AS INTEGER) END AS r, CASE WHEN n >= 0 THEN CAST((n >> 8) & 255 AS INTEGER) END AS g, CASE WHEN n >= 0 THEN CAST((n >> 16) & 255 AS INTEGER) END AS b, CASE WHEN n >= 0 THEN n ELSE 0 END AS back FROM (SELECT *, CASE WHEN l_linenumber = 3 THEN -1 ELSE (l_partkey * 7919) % 16777216 END AS n FROM lineitem)")
def _(spark, sf_dir):
    n = F.when(F.col("l_linenumber") == 3, F.lit(-1)).otherwise((F.col("l_partkey") * 7919) % 16777216)
    c = colours.hwp_to_rgb(n)
    return lines(spark, sf_dir, r=c["r"], g=c["g"], b=c["b"], back=colours.rgb_to_hwp(c))


@query("fn10_black_inherited", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN n <> 0 THEN CAST(n & 255 AS INTEGER) END AS r FROM (SELECT *, CASE WHEN l_linenumber < 4 THEN 0 ELSE l_partkey END AS n FROM lineitem)")
def _(spark, sf_dir):
    n = F.when(F.col("l_linenumber") < 4, F.lit(0)).otherwise(F.col("l_partkey"))
    return lines(spark, sf_dir, r=colours.black_is_inherited(colours.hwp_to_rgb(n))["r"])


@query("fn11_border_widths", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 4 WHEN 0 THEN l_quantity / 25.4::DOUBLE * 72.0::DOUBLE WHEN 1 THEN l_quantity WHEN 2 THEN l_quantity / 25.4::DOUBLE * 72.0::DOUBLE ELSE 0.4::DOUBLE / 25.4::DOUBLE * 72.0::DOUBLE END AS pt FROM lineitem")
def _(spark, sf_dir):
    q, k = F.col("l_quantity").cast("string"), F.col("l_linenumber") % 4
    t = F.when(k == 0, F.concat(q, F.lit(" mm"))).when(k == 1, F.concat(q, F.lit("pt"))).when(k == 2, q).otherwise("none")
    return lines(spark, sf_dir, pt=values.border_width_mm(t))


@query("fn12_lenient_numbers", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE 7.0::DOUBLE END AS f, CASE WHEN l_linenumber % 2 = 0 THEN CAST(trunc(l_extendedprice) AS BIGINT) ELSE 7 END AS i FROM lineitem")
def _(spark, sf_dir):
    t = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), F.col("l_extendedprice").cast("string"))).otherwise("n/a")
    return lines(spark, sf_dir, f=values.to_float(t, 7.0), i=values.to_int(t, 7))


@query(
    "fn13_coerce_values",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_linenumber WHEN 1 THEN 'int' WHEN 2 THEN 'int' WHEN 3 THEN 'float' WHEN 4 THEN 'bool' WHEN 5 THEN NULL WHEN 6 THEN 'text' ELSE 'float' END AS kind,
  CASE l_linenumber WHEN 1 THEN l_partkey * 1000 WHEN 2 THEN -l_partkey END AS l,
  CASE l_linenumber WHEN 3 THEN l_partkey + 0.5::DOUBLE WHEN 7 THEN -(l_partkey + 0.25::DOUBLE) END AS d,
  CASE WHEN l_linenumber = 4 THEN l_partkey % 2 = 0 END AS b,
  CASE WHEN l_linenumber = 6 THEN ' item ' || l_partkey END AS s FROM lineitem""",
)
def _(spark, sf_dir):
    n, k = F.col("l_partkey").cast("string"), F.col("l_linenumber")
    t = F.when(k == 1, F.concat(n, F.lit(",000"))).when(k == 2, F.concat(F.lit(" ("), n, F.lit(")"))).when(k == 3, F.concat(n, F.lit(".5"))).when(k == 4, F.when(F.col("l_partkey") % 2 == 0, "True").otherwise("FALSE")).when(k == 5, "  ").when(k == 6, F.concat(F.lit(" item "), n)).otherwise(F.concat(F.lit("-"), n, F.lit(".25")))
    v = values.coerce(t)
    return lines(spark, sf_dir, kind=v["kind"], l=v["l"], d=v["d"], b=v["b"], s=v["s"])


@query("fn14_show_values", "SELECT event_id, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS whole, CASE WHEN value > 10 THEN 'TRUE' ELSE 'FALSE' END AS truth, CASE WHEN event_id % 2 = 0 THEN strftime(date_trunc('day', ts), '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS moment FROM events")
def _(spark, sf_dir):
    at = F.when(F.col("event_id") % 2 == 0, F.date_trunc("day", "ts")).otherwise(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", values.show_double(F.floor("value").cast("double")).alias("whole"), values.show_bool(F.col("value") > 10).alias("truth"), values.show_timestamp(at).alias("moment"))


@query(
    "fn15_sheet_names",
    f"""SELECT doc_id, left(CASE WHEN b = '' THEN 'Sheet' ELSE b END, 31) AS name FROM (
  SELECT doc_id, regexp_replace(regexp_replace(translate(translate(CASE doc_id % 3 WHEN 0 THEN '''' || text || '''' WHEN 1 THEN '[' || text || ']*?' ELSE '''''' END, '[]:*?/\\', '_______'), chr(10) || chr(13), '  '), '^[{SPACE}]+|[{SPACE}]+$', '', 'g'), '^''+|''+$', '', 'g') AS b FROM documents)""",
)
def _(spark, sf_dir):
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("'"), "text", F.lit("'"))).when(k == 1, F.concat(F.lit("["), "text", F.lit("]*?"))).otherwise("''")
    return table(spark, sf_dir, "documents").select("doc_id", text.sheet_name(raw).alias("name"))


@query("fn16_default_sheet_name", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '표' || c_nationkey ELSE c_mktsegment END AS name FROM customer")
def _(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 2 == 1, F.col("c_mktsegment")).otherwise(F.lit("\u3000 "))
    return table(spark, sf_dir, "customer").select("c_custkey", text.default_sheet_name(raw, F.col("c_nationkey")).alias("name"))


@query("fn17_file_stem", """SELECT page_id, translate(url, '\\/:*?"<>|', '_________') AS stem FROM pages""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.file_stem(F.col("url")).alias("stem"))


@query(
    "fn18_display_width",
    "SELECT doc_id, CAST(length(split_part(t, chr(10), 1)) + length(regexp_replace(split_part(t, chr(10), 1), '[^\\x{1101}-\\x{10FFFF}]', '', 'g')) AS BIGINT) AS width, CAST(length(t) + length(regexp_replace(t, '[^\\x{1101}-\\x{10FFFF}]', '', 'g')) AS BIGINT) AS visual FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '한글 문서 ' || text ELSE text END AS t FROM documents)",
)
def _(spark, sf_dir):
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("한글 문서 "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.display_width(t).alias("width"), text.visual_length(t).alias("visual"))


@query("fn19_fill_colour", "SELECT p_partkey, CASE WHEN p_partkey % 5 < 2 THEN NULL ELSE CAST(p_partkey % 256 AS INTEGER) END AS r FROM part")
def _(spark, sf_dir):
    k = F.col("p_partkey") % 5
    code = F.when(k == 0, "FFFFFFFF").when(k == 1, "auto").otherwise(F.concat(F.lit("FF"), F.lpad(F.hex(F.col("p_partkey") % 256), 2, "0"), F.lit("40C0")))
    return table(spark, sf_dir, "part").select("p_partkey", colours.fill_colour(code)["r"].alias("r"))


@query("fn22_delimiter_unescape", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN chr(9) WHEN 1 THEN chr(9) WHEN 2 THEN ';' ELSE '|' END AS delimiter FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey") % 4
    return table(spark, sf_dir, "customer").select("c_custkey", text.unescape_delimiter(F.when(k == 0, "\\t").when(k == 1, "tab").when(k == 2, "\\;").otherwise("|")).alias("delimiter"))


@query("fn24_html_escape", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


@query("fn25_rect", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(l_quantity, 25) AS x0, l_discount AS y0, greatest(l_quantity, 25) AS x1, l_discount + 1 AS y1 FROM lineitem")
def _(spark, sf_dir):
    q = F.col("l_quantity")
    return lines(spark, sf_dir, x0=F.least(q, F.lit(25.0)), y0=F.col("l_discount"), x1=F.greatest(q, F.lit(25.0)), y1=F.col("l_discount") + 1)


@query("fn26_human_size", "SELECT o_orderkey, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024.0::DOUBLE) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', n / 1048576.0::DOUBLE) || ' MB' ELSE printf('%.1f', n / 1073741824.0::DOUBLE) || ' GB' END AS size FROM (SELECT o_orderkey, (o_orderkey % 7 + 1) * 7 * CAST(pow(10, o_orderkey % 10) AS BIGINT) + 1 AS n FROM orders)")
def _(spark, sf_dir):
    n = (F.col("o_orderkey") % 7 + 1) * 7 * F.pow(F.lit(10), F.col("o_orderkey") % 10).cast("long") + 1
    return table(spark, sf_dir, "orders").select("o_orderkey", text.human_size(n).alias("size"))


@query("fn27_heading_size", "SELECT p_partkey, CASE p_size % 8 WHEN 1 THEN 18.0 WHEN 2 THEN 15.0 WHEN 3 THEN 13.0 WHEN 4 THEN 12.0 WHEN 5 THEN 11.0 ELSE 10.5 END::DOUBLE AS pt FROM part")
def _(spark, sf_dir):
    from vellumine.operators.blocks import heading_size

    return table(spark, sf_dir, "part").select("p_partkey", heading_size(F.col("p_size") % 8).alias("pt"))


@query("fn30_path_list", r"SELECT o_custkey, list_aggregate(regexp_extract_all(paths, '\{[^}]*\}|\S+'), 'count') AS n, regexp_extract_all(paths, '\{[^}]*\}|\S+')[1] AS first FROM (SELECT DISTINCT o_custkey, '{C:/my docs/' || o_custkey || '.hwp} b.docx {c d.pdf}' AS paths FROM orders)")
def _(spark, sf_dir):
    paths = F.regexp_extract_all("paths", F.lit(r"(\{[^}]*\}|\S+)"), 1)
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("{C:/my docs/"), F.col("o_custkey").cast("string"), F.lit(".hwp} b.docx {c d.pdf}")).alias("paths")).distinct()
    return rows.select("o_custkey", F.size(paths).cast("long").alias("n"), paths[0].alias("first"))


@query("agg07_text_score", "SELECT doc_id, round(CASE WHEN length(t) = 0 THEN 0.0 ELSE (2 * length(regexp_replace(t, '[^\\x{AC00}-\\x{D7A3}]', '', 'g')) + length(regexp_replace(t, '[^\\x20-\\x7e]', '', 'g')))::DOUBLE / length(t) * 100 - length(regexp_replace(t, '[^\\x{FFFD}\\x{E000}-\\x{F8FF}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'))::DOUBLE / length(t) * 400 END, 6) AS score FROM (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN '한글' WHEN 1 THEN chr(65533) || chr(57344) ELSE '' END AS t FROM documents)")
def _(spark, sf_dir):
    k = F.col("doc_id") % 3
    t = F.concat("text", F.when(k == 0, "한글").when(k == 1, "\ufffd\ue000").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.text_score(t), 6).alias("score"))


@query("agg09_delimiter", "SELECT doc_id, CASE WHEN g = 0 THEN ',' WHEN a = g THEN ',' WHEN b = g THEN ';' WHEN c = g THEN chr(9) ELSE '|' END AS delimiter FROM (SELECT *, greatest(a, b, c, d) AS g FROM (SELECT doc_id, length(h) - length(replace(h, ',', '')) AS a, length(h) - length(replace(h, ';', '')) AS b, length(h) - length(replace(h, chr(9), '')) AS c, length(h) - length(replace(h, '|', '')) AS d FROM (SELECT doc_id, array_to_string(string_split(text, chr(10))[1:40], chr(10)) AS h FROM documents)))")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.delimiter_by_count(F.col("text")).alias("delimiter"))


@query("prj02_blank", f"SELECT doc_id, NOT regexp_matches(t, '[^{SPACE}]') AS blank FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN chr(160) || chr(12288) || ' ' WHEN 1 THEN '' ELSE text END AS t FROM documents)")
def _(spark, sf_dir):
    k = F.col("doc_id") % 4
    return table(spark, sf_dir, "documents").select("doc_id", text.is_blank(F.when(k == 0, "\u00a0\u3000 ").when(k == 1, "").otherwise(F.col("text"))).alias("blank"))


@query("prj18_cjk", "SELECT doc_id, doc_id % 2 = 0 AS cjk FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.has_cjk(F.concat("text", F.when(F.col("doc_id") % 2 == 0, "漢字").otherwise(""))).alias("cjk"))


@query("src20_xls_values", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN o_orderpriority WHEN 2 THEN strftime(DATE '1899-12-30' + CAST(o_custkey + 1 AS INTEGER), '%Y-%m-%d') WHEN 3 THEN strftime(DATE '1899-12-30' + CAST(o_custkey + 1 AS INTEGER), '%Y-%m-%d') || ' 12:00:00' WHEN 4 THEN CASE WHEN o_custkey % 2 <> 0 THEN 'TRUE' ELSE 'FALSE' END ELSE '#ERROR' END AS value FROM orders")
def _(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    kind = F.when(k == 0, 0).when(k == 1, 1).when(k.isin(2, 3), 3).when(k == 4, 4).otherwise(5)
    number = F.when(k == 4, F.col("o_custkey") % 2).otherwise(F.col("o_custkey") + 1).cast("double") + F.when(k == 3, 0.5).otherwise(0.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", values.xls_value(kind, number, F.col("o_orderpriority")).alias("value"))


@query("snk16_csv_cell", "SELECT doc_id, regexp_replace(replace(text, chr(10), chr(13) || chr(10)), '\\r\\n?', chr(10), 'g') AS cell FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normal_lines(F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("cell"))

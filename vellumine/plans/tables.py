"""Grid operators over grids made of each customer's orders, and rectangles made of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.operators import grids as ops
from vellumine.operators import rules as ru
from vellumine.operators import spatial
from vellumine.plans.registry import query
from vellumine.plans.scalars import SPACE
from vellumine.shared import dealt, table

CELLS = """(SELECT table_id, r, unnest([0, 1, 2, 3]) AS c, unnest([s, k, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE p END, CASE WHEN o_orderkey % 4 = 0 THEN 'a' || chr(10) || 'b|' || k ELSE ' ' END]) AS text FROM (
  SELECT *, o_custkey AS table_id, o_orderstatus AS s, CAST(o_orderkey AS VARCHAR) AS k, o_orderpriority AS p, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS r FROM orders))"""
BLANK = f"NOT regexp_matches(text, '[^{SPACE}]')"
MERGES = "(SELECT table_id, r, CAST(CASE WHEN r % 4 = 0 THEN 0 ELSE 2 END AS INTEGER) AS c, 2 AS row_span, CAST(table_id % 2 + 1 AS INTEGER) AS col_span FROM (SELECT DISTINCT table_id, r FROM " + CELLS + ") WHERE r % 4 IN (0, 2))"

#: Orders of a task, each four cells.
ORDERS = 20_000


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = dealt(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"), "o_custkey", each=ORDERS).withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    key = F.col("o_orderkey")
    texts = F.array("o_orderstatus", key.cast("string"), F.when(key % 3 == 0, "").otherwise(F.col("o_orderpriority")), F.when(key % 4 == 0, F.concat(F.lit("a\nb|"), key.cast("string"))).otherwise(" "))
    return o.select(F.col("o_custkey").alias("table_id"), "r", F.posexplode(texts).alias("c", "text"))


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).where("c = 0 and r % 4 in (0, 2)")
    return rows.select("table_id", "r", F.when(F.col("r") % 4 == 0, 0).otherwise(2).alias("c"), F.lit(2).alias("row_span"), (F.col("table_id") % 2 + 1).cast("int").alias("col_span"))


@query("agg03_extent", f"SELECT table_id, count(DISTINCT r) AS n_rows, max(c) + 1 AS n_cols FROM {CELLS} GROUP BY table_id")
def _(spark, sf_dir):
    return ops.extent(cells(spark, sf_dir))


_COVER = f"(SELECT table_id, r0, c0, r0 + dr AS r, c0 + dc AS c FROM (SELECT table_id, r AS r0, c AS c0, row_span, col_span, unnest([0, 0, 1, 1]) AS dr, unnest([0, 1, 0, 1]) AS dc FROM {MERGES}) WHERE dr < row_span AND dc < col_span AND (dr > 0 OR dc > 0))"


@query("join07_merge_placeholder", f"SELECT table_id, r, c, CASE WHEN EXISTS (SELECT 1 FROM {_COVER} m WHERE m.table_id = x.table_id AND m.r = x.r AND m.c = x.c) THEN '' ELSE text END AS text FROM {CELLS} x")
def _(spark, sf_dir):
    return ops.fill_merges(cells(spark, sf_dir), merges(spark, sf_dir), "placeholder")


@query("join07_merge_duplicate", f"WITH g AS MATERIALIZED {CELLS}, m AS MATERIALIZED (SELECT table_id, r, c, max((r0, c0)) AS a FROM {_COVER} GROUP BY table_id, r, c) SELECT g.table_id, g.r, g.c, coalesce(h.text, g.text) AS text FROM g LEFT JOIN m USING (table_id, r, c) LEFT JOIN g h ON h.table_id = m.table_id AND h.r = m.a[1] AND h.c = m.a[2]")
def _(spark, sf_dir):
    return ops.fill_merges(cells(spark, sf_dir), merges(spark, sf_dir), "duplicate")


@query("join07_covered_cells", f"SELECT table_id, r0, c0, r, c FROM {_COVER}")
def _(spark, sf_dir):
    return ops.covered(merges(spark, sf_dir))


@query("snk02_table_rows", f"SELECT table_id, r, string_agg(replace(text, chr(10), ' '), chr(9) ORDER BY c) AS line FROM {CELLS} GROUP BY table_id, r")
def _(spark, sf_dir):
    return ops.row_texts(cells(spark, sf_dir))


@query("agg05_table_text", f"SELECT table_id, string_agg(line, chr(10) ORDER BY r) AS text FROM (SELECT table_id, r, string_agg(replace(text, chr(10), ' '), chr(9) ORDER BY c) AS line FROM {CELLS} GROUP BY table_id, r) GROUP BY table_id")
def _(spark, sf_dir):
    return ops.table_texts(cells(spark, sf_dir))


@query("snk06_md_tables", f"SELECT table_id, string_agg(line || CASE WHEN r = 0 THEN chr(10) || '| --- | --- | --- | --- |' ELSE '' END, chr(10) ORDER BY r) || chr(10) AS markdown FROM (SELECT table_id, r, '| ' || string_agg(replace(replace(text, chr(10), ' '), '|', '\\|'), ' | ' ORDER BY c) || ' |' AS line FROM {CELLS} GROUP BY table_id, r) GROUP BY table_id")
def _(spark, sf_dir):
    return ops.md_tables(cells(spark, sf_dir))


@query("snk09_html_tables", f"""SELECT table_id, '<table>' || string_agg(line, '' ORDER BY r) || '</table>' AS html FROM (SELECT table_id, r, '<tr>' || coalesce(string_agg('<' || tag || CASE WHEN cs > 1 THEN ' colspan="2"' ELSE '' END || CASE WHEN c = 1 THEN ' rowspan="3"' ELSE '' END || '>' || CASE WHEN text = '' THEN '&nbsp;' ELSE '<p>' || text || '</p>' END || '</' || tag || '>', '' ORDER BY c) FILTER (c <> 3 OR r % 2 = 0), '') || '</tr>' AS line FROM (SELECT *, CASE WHEN r = 0 THEN 'th' ELSE 'td' END AS tag, CASE WHEN c = 2 AND r % 2 = 1 THEN 2 ELSE 1 END AS cs FROM {CELLS}) GROUP BY table_id, r) GROUP BY table_id""")
def _(spark, sf_dir):
    odd = F.col("r") % 2 == 1
    x = cells(spark, sf_dir).withColumns({"col_span": F.when((F.col("c") == 2) & odd, 2).otherwise(1), "row_span": F.when(F.col("c") == 1, 3).otherwise(1), "placeholder": (F.col("c") == 3) & odd})
    return ops.html_tables(x)


_SPARSE = f"(SELECT table_id, r, c, CASE WHEN c = 3 OR r % 3 = 2 THEN ' ' ELSE text END AS text FROM {CELLS})"


def sparse(spark, sf_dir):
    return cells(spark, sf_dir).withColumn("text", F.when((F.col("c") == 3) | (F.col("r") % 3 == 2), " ").otherwise(F.col("text")))


@query("agg14_used_range", f"SELECT x.* FROM {_SPARSE} x JOIN (SELECT table_id, max(r) AS mr, max(c) AS mc FROM {_SPARSE} WHERE NOT ({BLANK}) GROUP BY table_id) b USING (table_id) WHERE r <= mr AND c <= mc")
def _(spark, sf_dir):
    return ops.used_range(sparse(spark, sf_dir))


@query("win14_trim_rows", f"SELECT table_id, r, c, text FROM (SELECT *, max(r) FILTER (NOT ({BLANK})) OVER (PARTITION BY table_id) AS mr FROM {_SPARSE}) WHERE r <= mr")
def _(spark, sf_dir):
    return ops.trim_rows(sparse(spark, sf_dir))


@query("prj09_filled_rows", f"SELECT table_id, r, c, text FROM (SELECT *, bool_or(NOT ({BLANK})) OVER (PARTITION BY table_id, r) AS br, bool_or(NOT ({BLANK})) OVER (PARTITION BY table_id) AS bt FROM {_SPARSE}) WHERE br OR NOT bt")
def _(spark, sf_dir):
    return ops.filled_rows(sparse(spark, sf_dir))


_PREF = f"(SELECT table_id, c, CAST(greatest(1, max(CASE WHEN NOT ({BLANK}) THEN greatest(least(44, list_max(list_transform(string_split(replace(text, chr(10), ' '), ' '), lambda w: length(w)))), least(44, length(text))) END)) AS BIGINT) AS width FROM {CELLS} GROUP BY table_id, c)"


@query("agg15_preferred_widths", f"SELECT table_id, c, width FROM {_PREF}")
def _(spark, sf_dir):
    return ops.preferred_widths(cells(spark, sf_dir))


@query("agg17_widths_in_points", f"SELECT table_id, c, CASE WHEN width > 0 THEN greatest(40.0::DOUBLE, 481.9::DOUBLE - 9.5::DOUBLE * count(*) OVER (PARTITION BY table_id)) * (width::DOUBLE / sum(CASE WHEN width > 0 THEN width END) OVER (PARTITION BY table_id)) ELSE 12.0::DOUBLE END AS pt FROM (SELECT table_id, c, CASE WHEN c = 2 THEN 0 ELSE width END AS width FROM {_PREF})")
def _(spark, sf_dir):
    w = ops.preferred_widths(cells(spark, sf_dir)).withColumn("width", F.when(F.col("c") == 2, 0).otherwise(F.col("width")))
    return ops.widths_in_points(w, 481.9).select("table_id", "c", "pt")


@query("agg16_sheet_widths", f"SELECT table_id, c, CAST(least(60, greatest(8, n + 2)) AS BIGINT) AS width FROM (SELECT table_id, c, max(length(split_part(text, chr(10), 1))) AS n FROM {CELLS} WHERE r < 400 GROUP BY table_id, c) WHERE n > 0")
def _(spark, sf_dir):
    return ops.sheet_widths(cells(spark, sf_dir))


_WEIGHT = f"(SELECT table_id, CAST(sum(length(regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'))) AS BIGINT) AS weight FROM {CELLS} GROUP BY table_id)"


@query("agg12_sheet_weights", f"SELECT table_id, weight FROM {_WEIGHT}")
def _(spark, sf_dir):
    return ops.sheet_weights(cells(spark, sf_dir))


@query("agg12_primary_sheet", f"SELECT book, CASE WHEN fw >= 50 OR hw <= fw THEN f ELSE h END AS sheet FROM (SELECT table_id % 97 AS book, min(table_id) AS f, arg_min(weight, table_id) AS fw, max(weight) AS hw, arg_max(table_id, (weight, -table_id)) AS h FROM (SELECT table_id, CASE WHEN table_id % 5 < 4 THEN weight % 45 ELSE weight END AS weight FROM {_WEIGHT}) GROUP BY book)")
def _(spark, sf_dir):
    w = ops.sheet_weights(cells(spark, sf_dir)).select((F.col("table_id") % 97).alias("book"), F.col("table_id").alias("sheet"), F.when(F.col("table_id") % 5 < 4, F.col("weight") % 45).otherwise(F.col("weight")).alias("weight"))
    return ops.primary_sheet(w)


_SHEETS = f"(SELECT table_id % 97 AS book, table_id AS sheet, CASE WHEN table_id % 5 < 4 THEN weight % 45 ELSE weight END AS weight FROM {_WEIGHT})"


@query("srt06_primary_first", f"""SELECT s.book, s.sheet, row_number() OVER (PARTITION BY s.book ORDER BY CASE WHEN s.sheet = p.sheet THEN 0 ELSE 1 END, s.sheet) AS place FROM {_SHEETS} s JOIN (
  SELECT book, CASE WHEN fw >= 50 OR hw <= fw THEN f ELSE h END AS sheet FROM (SELECT book, min(sheet) AS f, arg_min(weight, sheet) AS fw, max(weight) AS hw, arg_max(sheet, (weight, -sheet)) AS h FROM {_SHEETS} GROUP BY book)) p USING (book)""")
def _(spark, sf_dir):
    """The sheets of a book: the primary one first, the others in their order."""
    w = ops.sheet_weights(cells(spark, sf_dir)).select((F.col("table_id") % 97).alias("book"), F.col("table_id").alias("sheet"), F.when(F.col("table_id") % 5 < 4, F.col("weight") % 45).otherwise(F.col("weight")).alias("weight"))
    return ops.primary_first(w)


@query("prj15_header_guess", f"SELECT table_id, coalesce(bool_or(r = 0 AND NOT ({BLANK})), false) AND NOT coalesce(bool_or(r = 0 AND kind IN ('int', 'float')), false) AND coalesce(bool_or(r = 1 AND kind IN ('int', 'float', 'date')), false) AS header FROM (SELECT *, CASE WHEN c = 1 AND (r > 0 OR table_id % 2 = 0) THEN 'int' ELSE 'text' END AS kind FROM {CELLS}) GROUP BY table_id")
def _(spark, sf_dir):
    kind = F.when((F.col("c") == 1) & ((F.col("r") > 0) | (F.col("table_id") % 2 == 0)), "int").otherwise("text")
    return ops.header_guess(cells(spark, sf_dir).withColumn("kind", kind))


@query("win08_vertical_merges", f"""SELECT table_id, c, anchor AS r, count(*) AS row_span FROM (SELECT table_id, c, r, CASE WHEN state = 'continue' AND coalesce(opened, 'none') <> 'restart' THEN r ELSE anchor END AS anchor FROM (
  SELECT *, max(CASE WHEN state <> 'continue' THEN r END) OVER w AS anchor, last_value(CASE WHEN state <> 'continue' THEN state END IGNORE NULLS) OVER w AS opened FROM (SELECT *, CASE WHEN (r + c) % 4 = 0 THEN 'restart' WHEN (r + c) % 4 IN (1, 2) THEN 'continue' ELSE 'none' END AS state FROM {CELLS}) WINDOW w AS (PARTITION BY table_id, c ORDER BY r))) GROUP BY table_id, c, anchor""")
def _(spark, sf_dir):
    k = (F.col("r") + F.col("c")) % 4
    return ops.vertical_merges(cells(spark, sf_dir).withColumn("state", F.when(k == 0, "restart").when(k.isin(1, 2), "continue")))


@query("agg04_cell_text", f"SELECT table_id, c, string_agg(nullif(text, ''), chr(10) ORDER BY r) AS text FROM {CELLS} GROUP BY table_id, c")
def _(spark, sf_dir):
    from vellumine.operators.blocks import joined

    got = cells(spark, sf_dir).withColumn("text", F.nullif("text", F.lit(""))).groupBy("table_id", "c").agg(joined("text", "\n", "r").alias("text"), F.count("text").alias("n"))
    return got.select("table_id", "c", F.when(F.col("n") > 0, F.col("text")).alias("text"))


@query("lim01_row_cap", f"SELECT table_id, r, c FROM {CELLS} WHERE r < 4")
def _(spark, sf_dir):
    return ru.capped(cells(spark, sf_dir), 4).select("table_id", "r", "c")


@query("win12_sequential_slots", "SELECT o_orderkey, (n - 1) // 7 AS r, (n - 1) % 7 AS c FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)")
def _(spark, sf_dir):
    return ru.slots(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 7).select("o_orderkey", "r", "c")


@query("win11_object_ids", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1000000000 AS object_id FROM orders")
def _(spark, sf_dir):
    return ru.object_ids(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "object_id")


@query("snk13_typed_values", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN nullif(o_orderpriority, '5-LOW') ELSE NULL END AS value FROM orders")
def _(spark, sf_dir):
    from vellumine.functions.values import coerce, pick

    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.col("o_custkey").cast("string")).when((k == 1) & (F.col("o_orderpriority") != "5-LOW"), F.col("o_orderpriority")).otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", pick(text, coerce(text)).alias("value"))


# --- rectangles on pages: suppliers are pages, lines their items

RECTS = "(SELECT l_suppkey AS page, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n, CAST(l_partkey * 7 % 500 AS DOUBLE) AS x0, CAST(l_orderkey * 11 % 700 AS DOUBLE) AS y0, l_quantity + 3 AS w, l_quantity / 2 + 2 AS h FROM lineitem)"


def rects(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.row_number().over(w).cast("long").alias("n"), (F.col("l_partkey") * 7 % 500).cast("double").alias("x0"), (F.col("l_orderkey") * 11 % 700).cast("double").alias("y0"), (F.col("l_quantity") + 3).alias("w"), (F.col("l_quantity") / 2 + 2).alias("h"))


@query("join05_outside_tables", f"""WITH r AS (SELECT page, n, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM {RECTS}), t AS (SELECT page, x0, y0, x0 + 150 AS x1, y0 + 90 AS y1 FROM r WHERE n % 50 = 1)
  SELECT page, n FROM r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page = r.page AND greatest(0.0, least(r.x1, t.x1) - greatest(r.x0, t.x0)) * greatest(0.0, least(r.y1, t.y1) - greatest(r.y0, t.y0)) / greatest(1e-6, (r.x1 - r.x0) * (r.y1 - r.y0)) >= 0.55)""")
def _(spark, sf_dir):
    """Text items that no table of their page covers by 0.55 of their area: compared by cells of the page."""
    box = lambda w, h: ("page", F.col("n").alias("id"), "x0", "y0", (F.col("x0") + w).alias("x1"), (F.col("y0") + h).alias("y1"))
    r = rects(spark, sf_dir)
    return spatial.outside(r.select(*box(F.col("w"), F.col("h"))), r.where("n % 50 = 1").select(*box(F.lit(150), F.lit(90))), 0.55).select("page", F.col("id").alias("n"))


@query("srt01_page_order", f"SELECT page, n, row_number() OVER (PARTITION BY page ORDER BY y0, n % 3, n) AS place FROM {RECTS}")
def _(spark, sf_dir):
    return ru.page_order(rects(spark, sf_dir), F.col("n") % 3, F.col("n")).select("page", "n", "place")


@query("snk27_ghost_fills", f"SELECT page, bool_or(n > 20 AND h >= 2 AND h <= 8 AND w > 20) AS ghost FROM {RECTS} GROUP BY page")
def _(spark, sf_dir):
    """Every twenty fills are a page."""
    ghost = ru.ghost_fill(F.floor((F.col("n") - 1) / 20) + 1, F.col("h"), F.col("w"))
    return rects(spark, sf_dir).groupBy("page").agg(F.bool_or(ghost).alias("ghost"))


@query("agg18_alignment", f"SELECT page, b, CASE WHEN count(*) >= 2 AND max(x0) - min(x0) > 12 AND max(x1) - min(x1) < 3 THEN 'right' WHEN count(*) >= 2 AND max(x0) - min(x0) > 8 AND max(x1) - min(x1) > 8 THEN 'center' ELSE 'left' END AS align FROM (SELECT page, n // 3 AS b, CASE WHEN page % 2 = 0 THEN 300 - w ELSE x0 END AS x0, CASE WHEN page % 2 = 0 THEN 300 ELSE x0 + w END AS x1 FROM {RECTS}) GROUP BY page, b")
def _(spark, sf_dir):
    even = F.col("page") % 2 == 0
    b = rects(spark, sf_dir).select("page", F.floor(F.col("n") / 3).alias("b"), F.when(even, 300 - F.col("w")).otherwise(F.col("x0")).alias("x0"), F.when(even, F.lit(300.0)).otherwise(F.col("x0") + F.col("w")).alias("x1"))
    return ru.alignment(b, "page", "b")


@query("agg19_picture_size", f"SELECT page, n, CASE WHEN w <> 10 THEN w / 100 END AS width, h / 100 AS height FROM {RECTS}")
def _(spark, sf_dir):
    xs, ys = F.array("x0", F.col("x0") + F.when(F.col("w") != 10, F.col("w")).otherwise(0.0)), F.array("y0", F.col("y0") + F.col("h"))
    return rects(spark, sf_dir).select("page", "n", ru.extent_pt(xs).alias("width"), ru.extent_pt(ys).alias("height"))


@query("lim02_page_slice", f"SELECT page, n FROM {RECTS} WHERE page >= 3 AND page < 17")
def _(spark, sf_dir):
    return ru.page_slice(rects(spark, sf_dir), 3, 17).select("page", "n")


@query("set03_first_of_each", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def _(spark, sf_dir):
    return ru.first_of_each(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")
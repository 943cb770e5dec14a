"""Queries over marked-up pages: their blocks, and the grids of tables in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.operators import markup
from vellumine.plans.registry import query
from vellumine.shared import table

_KNOWN = [("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&amp;", "'&'")]
_TEXT = "replace(t, chr(11), ' ')"
for _name, _char in _KNOWN:
    _TEXT = f"replace({_TEXT}, '{_name}', {_char})"
_EDGES = ", ".join(f"'{e}'" for e in markup.EDGES)


@query(
    "src12_html_blocks",
    rf"""WITH t AS (SELECT page_id, unnest(x) AS t, generate_subscripts(x, 1) AS n FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '{markup.HIDDEN}', '', 'g'), '{markup.TOKEN}') AS x FROM pages)),
g AS (SELECT *, lower(regexp_extract(t, '{markup.TAG}', 1)) AS tag, starts_with(t, '</') AS ends FROM t WHERE NOT regexp_matches(t, '^<[!?]')),
a AS (SELECT *, tag IN ({_EDGES}) AS edge, sum(CASE WHEN tag IN ('ul', 'ol') THEN CASE WHEN ends THEN -1 ELSE 1 END ELSE 0 END) OVER w AS s,
  last_value(CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN CASE WHEN ends THEN 0 ELSE CAST(tag[2] AS INTEGER) END END IGNORE NULLS) OVER w AS heading FROM g WINDOW w AS (PARTITION BY page_id ORDER BY n)),
b AS (SELECT *, sum(CAST(edge AS INTEGER)) OVER w AS block, s - least(0, min(s) OVER w) AS lists, last_value(CASE WHEN edge THEN tag = 'li' AND NOT ends END IGNORE NULLS) OVER w AS item FROM a WINDOW w AS (PARTITION BY page_id ORDER BY n)),
l AS (SELECT *, last_value(CASE WHEN tag IN ('ul', 'ol') AND NOT ends THEN tag END IGNORE NULLS) OVER (PARTITION BY page_id, lists ORDER BY n) AS kind FROM b),
x AS (SELECT page_id, min(n) AS n, coalesce(min(heading), 0) AS heading, min(lists) AS lists, bool_or(coalesce(item, false)) AS item, min(CASE WHEN lists > 0 THEN kind END) AS kind,
  trim(replace(regexp_replace(regexp_replace(string_agg(CASE WHEN tag = 'br' THEN chr(11) ELSE {_TEXT} END, '' ORDER BY n), '[ \t\r\n\f]+', ' ', 'g'), ' *\x0b *', chr(11), 'g'), chr(11), chr(10)), ' ' || chr(10)) AS text
  FROM l WHERE tag IN ('', 'br') GROUP BY page_id, block)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INTEGER) AS ord, 'paragraph' AS kind, heading, CASE WHEN heading > 0 OR NOT (lists > 0 OR item) THEN 'none' WHEN kind = 'ol' THEN 'number' ELSE 'bullet' END AS list_kind,
  CAST(CASE WHEN heading > 0 THEN 0 ELSE greatest(lists - 1, 0) END AS INTEGER) AS level, text FROM x WHERE text <> ''""",
)
def _(spark, sf_dir):
    """The blocks of whole pages in their order."""
    return markup.html_blocks(table(spark, sf_dir, "pages"))


_LINES = """x AS (SELECT l_orderkey AS k, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey AS part, l_suppkey AS supp, 's' || l_suppkey AS mode, l_returnflag AS flag, l_linestatus AS status, CAST(l_quantity AS INTEGER) AS q,
  count(*) FILTER (l_suppkey % 4 = 0) OVER w AS number FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, CAST(l_quantity AS INTEGER) ROWS UNBOUNDED PRECEDING))"""


@query(
    "src14_html_grids",
    f"""WITH {_LINES}
SELECT k AS l_orderkey, CAST(0 AS INTEGER) AS "table", false AS "inner", CAST(r AS INTEGER) AS r, 0 AS c, CAST(n AS INTEGER) AS row_span, 1 AS col_span, true AS header, '#' || k AS text FROM x WHERE r = 0
UNION ALL SELECT k, 0, false, r, 1, 1, 1, false, CAST(part AS VARCHAR) FROM x
UNION ALL SELECT k, 0, false, r, 2, 1, CASE WHEN part % 3 = 0 THEN 2 ELSE 1 END, false, mode FROM x
UNION ALL SELECT k, 0, false, r, 3, 1, 1, false, status FROM x WHERE part % 3 <> 0
UNION ALL SELECT k, 0, false, r, 4, 1, 1, false, CASE WHEN supp % 4 = 0 THEN flag || chr(10) || q || chr(9) || status || chr(10) || 'end' ELSE flag || ' & ' || status || chr(10) || '<' || q || '>' END FROM x
UNION ALL SELECT k, number, true, 0, 0, 1, 1, false, CAST(q AS VARCHAR) FROM x WHERE supp % 4 = 0
UNION ALL SELECT k, number, true, 0, 1, 1, 1, false, status FROM x WHERE supp % 4 = 0""",
)
def _(spark, sf_dir):
    """Orders as pages with a table: a cell that spans all rows, cells that span columns, marks left open, tables in cells."""
    part, flag, status, q = F.col("l_partkey"), F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity").cast("int")
    mode = F.concat(F.when(part % 3 == 0, '<td colspan="2">s').otherwise("<td>s"), F.col("l_suppkey").cast("string"), F.when(part % 3 == 0, "</td>").otherwise(F.concat(F.lit("<td>"), status)))
    nested = F.concat(F.lit("<td><p>"), flag, F.lit("<table><tr><td>"), q.cast("string"), F.lit("<td>"), status, F.lit("</table>end</td>"))
    plain = F.concat(F.lit("<td><p>"), flag, F.lit(" &amp; <b>"), status, F.lit("</b>\n<p>&lt;"), q.cast("string"), F.lit("&gt;</td>"))
    line = F.concat(F.lit("<td>"), part.cast("string"), mode, F.when(F.col("l_suppkey") % 4 == 0, nested).otherwise(plain), F.lit("</tr>"))
    of = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", q.alias("q"), line.alias("line")).alias("x"))
    rows = of.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    head = F.concat(F.lit("<tr><th rowspan="), F.size("xs").cast("string"), F.lit(">#"), F.col("l_orderkey").cast("string"), F.lit("</th>"))
    html = F.concat(F.lit("<body><h2>Order</h2><table><tbody>"), head, F.array_join("xs.line", "\n<tr>"), F.lit("</table>"))
    return markup.html_cells(rows.select("l_orderkey", html.alias("html")), key="l_orderkey")

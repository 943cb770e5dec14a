"""Queries over what nests, spans, touches or is counted across a whole table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellumine.operators import folds, numbering, probes, spatial, trees
from vellumine.plans.registry import query
from vellumine.plans.tables import CELLS, RECTS, cells, rects
from vellumine.shared import dealt, table

# --- a tree for each customer: order n hangs in order n / 4 if that is a table, in cells (0,0), (0,0), (0,1) and (1,0)

_TREE = """o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS id, o_orderkey, o_orderpriority FROM orders),
b AS (SELECT doc_id, id, CASE WHEN id >= 4 AND (id // 4) % 4 IN (1, 2) THEN id // 4 END AS parent, CASE WHEN id % 4 = 3 THEN 1 ELSE 0 END AS r, CASE WHEN id % 4 = 2 THEN 1 ELSE 0 END AS c, id AS ord,
  CASE WHEN id % 4 IN (1, 2) THEN 'table' WHEN o_orderkey % 7 = 0 THEN 'image' ELSE 'paragraph' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS text FROM o),
p AS (SELECT *, 0 AS depth, [id] AS path FROM b WHERE parent IS NULL UNION ALL SELECT b.*, p.depth + 1, list_append(p.path, b.id) FROM b JOIN p ON b.doc_id = p.doc_id AND b.parent = p.id AND p.kind = 'table')"""
_DEEPEST = 8  # customers of the tables have under 4 ** 8 orders


def _fold(pad: bool) -> str:
    """Cells (c1..) and tables (t1..) from the deepest level up."""
    out = [f"t{_DEEPEST + 1} AS (SELECT doc_id, id, '' AS text FROM b WHERE false)"]
    for d in range(_DEEPEST, 0, -1):
        filler = "|| repeat(chr(9), CAST(max(max(c)) OVER (PARTITION BY doc_id, id) - max(c) AS BIGINT))" if pad else ""
        out += [
            f"c{d} AS (SELECT p.doc_id, p.parent AS id, p.r, p.c, coalesce(string_agg(nullif(CASE p.kind WHEN 'table' THEN coalesce(t.text, '') WHEN 'paragraph' THEN p.text END, ''), chr(10) ORDER BY p.ord), '') AS text FROM p LEFT JOIN t{d + 1} t ON t.doc_id = p.doc_id AND t.id = p.id WHERE depth = {d} GROUP BY ALL)",
            f"t{d} AS (SELECT doc_id, id, string_agg(line, chr(10) ORDER BY r) AS text FROM (SELECT doc_id, id, r, string_agg(text, chr(9) ORDER BY c) {filler} AS line FROM c{d} GROUP BY doc_id, id, r) GROUP BY doc_id, id)",
        ]
    return f"WITH RECURSIVE {_TREE},\n" + ",\n".join(out)


def tree(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("id", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long") - 1)
    up, k = F.floor(F.col("id") / 4), F.col("id") % 4
    kind = F.when(k.isin(1, 2), "table").when(F.col("o_orderkey") % 7 == 0, "image").otherwise("paragraph")
    return o.select(
        F.col("o_custkey").alias("doc_id"),
        "id",
        F.when((F.col("id") >= 4) & (up % 4).isin(1, 2), up).alias("parent"),
        F.when(k == 3, 1).otherwise(0).alias("r"),
        F.when(k == 2, 1).otherwise(0).alias("c"),
        F.col("id").alias("ord"),
        kind.alias("kind"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("text"),
    )


@query("prj04_nested_blocks", f"WITH RECURSIVE {_TREE} SELECT doc_id, id, kind, CAST(depth AS INTEGER) AS depth, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS place FROM p WHERE kind IN ('table', 'image')")
def _(spark, sf_dir):
    """Tables and images at any depth, in the order of a walk through everything: cells by row and column, parts of a cell in their order."""
    at = trees.placed(tree(spark, sf_dir)).where("kind in ('table', 'image')")
    return at.select("doc_id", "id", "kind", "depth", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")).cast("long").alias("place"))


@query("agg04_nested_cells", _fold(False) + "\n" + "\nUNION ALL ".join(f"SELECT doc_id, id, r, c, text FROM c{d}" for d in range(1, _DEEPEST + 1)))
def _(spark, sf_dir):
    return trees.nested_texts(tree(spark, sf_dir))[0]


_BARE = " UNION ALL SELECT doc_id, id, '' AS text FROM p WHERE kind = 'table' AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = p.doc_id AND b.parent = p.id)"


@query("agg05_nested_tables", _fold(True) + "\n" + "\nUNION ALL ".join(f"SELECT doc_id, id, text FROM t{d}" for d in range(1, _DEEPEST + 1)) + _BARE)
def _(spark, sf_dir):
    """Tables as text, their rows as wide as the table; tables in cells are text of the cell."""
    return trees.nested_texts(tree(spark, sf_dir), pad=True)[1]


# --- probes


@query("join14_name_probes", "SELECT probe, count(*) AS parts FROM (SELECT DISTINCT p_brand AS probe FROM part UNION SELECT DISTINCT right(p_type, 5) FROM part) x JOIN part p ON contains(p.p_name || ' ' || p.p_type || ' ' || p.p_brand, x.probe) GROUP BY probe")
def _(spark, sf_dir):
    """Short probes: brands and ends of types in the names, types and brands of parts."""
    p = table(spark, sf_dir, "part")
    asked = p.select(F.col("p_brand").alias("probe")).unionByName(p.select(F.right("p_type", F.lit(5)).alias("probe"))).distinct()
    return probes.containing(p.select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text")), asked).groupBy("probe").agg(F.count("*").alias("parts"))


# --- ruling lines: every fiftieth item of a page draws a grid, the others are its words

_DRAWN = f"""r AS (SELECT page, n, x0, y0, w, h FROM {RECTS}),
g AS (SELECT page, n, x0, y0, 2 + n // 50 % 3 AS rows FROM r WHERE n % 50 = 1),
l AS (SELECT page, n * 20 + k AS id, x0, y0 + 20 * k AS y0, x0 + 120 AS x1, y0 + 20 * k AS y1, true AS flat FROM (SELECT *, unnest(range(0, rows + 1)) AS k FROM g)
  UNION ALL SELECT page, n * 20 + 10 + k, x0 + 60 * k, y0, x0 + 60 * k, y0 + 20 * rows, false FROM (SELECT *, unnest([0, 1, 2]) AS k FROM g)),
e AS (SELECT a.page, a.id AS a, b.id AS b FROM l a JOIN l b ON a.page = b.page AND a.flat AND NOT b.flat AND a.x0 - 3 <= b.x0 AND b.x0 <= a.x1 + 3 AND b.y0 - 3 <= a.y0 AND a.y0 <= b.y1 + 3),
s AS (SELECT page, a, b FROM e UNION ALL SELECT page, b, a FROM e),
q AS (SELECT page, id, id AS root FROM l UNION SELECT s.page, s.a, q.root FROM s JOIN q ON q.page = s.page AND q.id = s.b),
k AS (SELECT l.*, m.root FROM l JOIN (SELECT page, id, min(root) AS root FROM q GROUP BY page, id) m USING (page, id)),
v AS (SELECT page, root, flat, v FROM (SELECT *, v - lag(v) OVER (PARTITION BY page, root, flat ORDER BY v) AS gap FROM (SELECT DISTINCT page, root, flat, CASE WHEN flat THEN y0 ELSE x0 END AS v FROM k)) WHERE gap IS NULL OR gap > 3),
t AS (SELECT page, root, list(v ORDER BY v) FILTER (NOT flat) AS xs, list(v ORDER BY v) FILTER (flat) AS ys FROM v GROUP BY page, root)"""


def drawn(spark, sf_dir):
    r = rects(spark, sf_dir)
    g = r.where("n % 50 = 1").select("page", "n", "x0", "y0", (2 + F.floor(F.col("n") / 50) % 3).alias("rows"))
    k = F.col("k")
    flat = g.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), "rows"))).select("page", (F.col("n") * 20 + k).alias("id"), "x0", (F.col("y0") + 20 * k).alias("y0"), (F.col("x0") + 120).alias("x1"), (F.col("y0") + 20 * k).alias("y1"))
    steep = g.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("page", (F.col("n") * 20 + 10 + k).alias("id"), (F.col("x0") + 60 * k).alias("x0"), "y0", (F.col("x0") + 60 * k).alias("x1"), (F.col("y0") + 20 * F.col("rows")).alias("y1"))
    words = r.where("n % 50 <> 1").select("page", F.col("n").alias("id"), "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"), F.concat(F.lit("w"), F.col("n").cast("string")).alias("text"))
    return flat.unionByName(steep), words


@query("src51_ruled_grids", f"WITH RECURSIVE {_DRAWN} SELECT page, root AS \"table\", CAST(len(ys) - 1 AS INTEGER) AS n_rows, CAST(len(xs) - 1 AS INTEGER) AS n_cols, xs[1] AS x0, ys[1] AS y0 FROM t WHERE len(xs) > 1 AND len(ys) > 1")
def _(spark, sf_dir):
    """Grids that ruling lines draw; grids that touch are one."""
    grids = spatial.ruled_tables(drawn(spark, sf_dir)[0])
    return grids.select("page", "table", (F.size("ys") - 1).alias("n_rows"), (F.size("xs") - 1).alias("n_cols"), "x0", "y0")


@query(
    "src51_table_cells",
    f"""WITH RECURSIVE {_DRAWN}, w AS (SELECT page, n, x0 + w / 2 AS x, y0 + h / 2 AS y FROM r WHERE n % 50 <> 1)
SELECT page, "table", r, c, string_agg('w' || n, ' ' ORDER BY y, x, n) AS text FROM (
  SELECT w.page, root AS "table", n, x, y, CAST(least(len(list_filter(ys, lambda e: e <= y)), len(ys) - 1) - 1 AS INTEGER) AS r, CAST(least(len(list_filter(xs, lambda e: e <= x)), len(xs) - 1) - 1 AS INTEGER) AS c
  FROM t JOIN w ON w.page = t.page AND xs[1] <= x AND x <= xs[-1] AND ys[1] <= y AND y <= ys[-1] WHERE len(xs) > 1 AND len(ys) > 1) GROUP BY page, "table", r, c""",
)
def _(spark, sf_dir):
    """The words in the cells of ruled grids."""
    ruling, words = drawn(spark, sf_dir)
    return spatial.table_cells(spatial.ruled_tables(ruling), words)


# --- numbers across a whole table


@query("agg13_first_seen_ids", "SELECT o_custkey, o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS id FROM orders GROUP BY o_custkey, o_orderpriority")
def _(spark, sf_dir):
    """Ids of styles, here customers' priorities, in the order in which they are first seen."""
    found = numbering.first_seen(table(spark, sf_dir, "orders").withColumn("style", F.struct("o_custkey", "o_orderpriority")), "style", [F.col("o_orderkey")])
    return found.select("style.o_custkey", "style.o_orderpriority", "id")


@query("win11_job_object_ids", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) + 1000000000 AS object_id FROM lineitem")
def _(spark, sf_dir):
    """Object ids that count through a whole job, not within a document."""
    at = numbering.numbered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), [F.col("l_orderkey").asc(), F.col("l_linenumber").asc()], "n")
    return at.select("l_orderkey", "l_linenumber", (F.col("n") + 1_000_000_001).alias("object_id"))


@query(
    "set02_sheet_concat",
    f"""WITH x AS (SELECT table_id, -2 AS r, '' AS line FROM {CELLS} WHERE table_id > (SELECT min(o_custkey) FROM orders) GROUP BY table_id
  UNION ALL SELECT DISTINCT table_id, -1, '# S' || table_id FROM {CELLS}
  UNION ALL SELECT table_id, r, string_agg(text, chr(9) ORDER BY c) FROM {CELLS} GROUP BY table_id, r)
SELECT row_number() OVER (ORDER BY table_id, r) - 1 AS "row", table_id, line FROM x""",
)
def _(spark, sf_dir):
    """All sheets in one: a blank row between them, a row with the name, and their rows, numbered through."""
    own = cells(spark, sf_dir)
    rows = own.groupBy("table_id", "r").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c", "text"))), lambda x: x["text"]), "\t").alias("line"))
    sheets = own.select("table_id").distinct()
    first = sheets.agg(F.min("table_id")).first()[0]
    named = sheets.select("table_id", F.lit(-1).alias("r"), F.concat(F.lit("# S"), F.col("table_id").cast("string")).alias("line"))
    blank = sheets.where(F.col("table_id") > F.lit(first)).select("table_id", F.lit(-2).alias("r"), F.lit("").alias("line"))
    every = rows.unionByName(named).unionByName(blank)
    return numbering.numbered(every, [F.col("table_id").asc(), F.col("r").asc()], "row").select("row", "table_id", "line")


@query("win09_free_numbers", "WITH t AS (SELECT DISTINCT c_mktsegment AS name, c_custkey AS n FROM customer WHERE c_custkey % 50 <> length(c_mktsegment)), k AS (SELECT name, n, row_number() OVER (PARTITION BY name ORDER BY n) AS k FROM (SELECT name, row_number() OVER (PARTITION BY name ORDER BY n) + CASE WHEN n % 50 > 25 THEN n // 50 ELSE 0 END AS n FROM t)) SELECT name, coalesce(min(k) FILTER (n <> k), count(*) + 1) AS free FROM (SELECT name, n, row_number() OVER (PARTITION BY name ORDER BY n) AS k FROM (SELECT DISTINCT name, n FROM k)) GROUP BY name")
def _(spark, sf_dir):
    """The least free number of a name, however many are taken."""
    c = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 50 != F.length("c_mktsegment"))
    k = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey"))
    taken = c.select(F.col("c_mktsegment").alias("name"), (k + F.when(F.col("c_custkey") % 50 > 25, F.floor(F.col("c_custkey") / 50)).otherwise(0)).cast("long").alias("n"))
    return numbering.least_free(taken, "name", "n")


# --- folds


@query("join07_spanned_slots")
def _(spark, sf_dir):
    """Lines of orders as cells of rows of a supplier's table, with spans both ways; each takes the next column that is free."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("table_id"), F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    x = dealt(lines, "table_id", each=folds.CELLS)
    n = F.row_number().over(Window.partitionBy("table_id").orderBy("order", "line", "part")) - 1
    made = x.withColumn("n", n).select("table_id", F.floor(F.col("n") / 3).cast("int").alias("r"), (F.col("n") % 3).alias("k"), F.when(F.col("part") % 4 == 0, F.col("line") % 4 + 1).otherwise(1).cast("int").alias("row_span"), (F.col("part") % 3 % 2 + 1).cast("int").alias("col_span"))
    return folds.spanned_slots(made, counted=lines)


@query(
    "src13_inline_runs",
    r"""WITH t AS (SELECT page_id, unnest(x) AS t, generate_subscripts(x, 1) AS n FROM (SELECT page_id, regexp_extract_all(html, '(?s)<[^>]*>|[^<]+|<') AS x FROM pages)),
s AS (SELECT page_id, n, t, regexp_extract(t, '(?s)^</?([A-Za-z][A-Za-z0-9]*)[^>]*>$', 1) AS tag, CASE WHEN starts_with(t, '</') THEN -1 ELSE 1 END AS way FROM t),
d AS (SELECT *, sum(CASE WHEN lower(tag) IN ('b', 'strong') THEN way ELSE 0 END) OVER w AS b, sum(CASE WHEN lower(tag) IN ('i', 'em') THEN way ELSE 0 END) OVER w AS i FROM s WINDOW w AS (PARTITION BY page_id ORDER BY n)),
m AS (SELECT *, b - least(0, min(b) OVER w) AS bold, i - least(0, min(i) OVER w) AS italic FROM d WINDOW w AS (PARTITION BY page_id ORDER BY n))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS n, CASE WHEN lower(tag) = 'br' THEN chr(10) ELSE t END AS text, bold > 0 AS bold, italic > 0 AS italic FROM m
WHERE lower(tag) = 'br' OR (tag = '' AND NOT regexp_matches(t, '(?s)^<[!/?].*>$'))""",
)
def _(spark, sf_dir):
    """The runs of pages with the styles that hold for them."""
    runs = table(spark, sf_dir, "pages").select("page_id", F.posexplode(folds.inline_runs(F.col("html"))).alias("n", "r"))
    return runs.select("page_id", F.col("n").cast("long").alias("n"), "r.text", "r.bold", "r.italic")

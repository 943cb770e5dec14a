"""Formats, engines, routes, archives and batch reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.operators import requests as rq
from vellumine.operators.numbering import least_free
from vellumine.plans.registry import query
from vellumine.shared import table
from vellumine.sources import formats as fm

_VALUES = ", ".join(f"('{f}', [{', '.join(repr(e) for e in es)}], '{fam}', {str(r).lower()}, {str(w).lower()})" for f, es, fam, r, w in fm.FORMATS)
FORMATS = f"(SELECT * FROM (VALUES {_VALUES}) v(format, ext, family, can_read, can_write))"
_CAPS = ", ".join(f"('{e}', {p}, '{r}', '{w}')" for e, p, r, w in fm.ENGINES)
CAPS = f"(SELECT engine, priority, src, dst FROM (SELECT engine, priority, src, unnest(string_split(w, ' ')) AS dst FROM (SELECT engine, priority, unnest(string_split(r, ' ')) AS src, w FROM (VALUES {_CAPS}) v(engine, priority, r, w))) WHERE src <> dst)"
FILES = "(SELECT o_orderkey, ['.PDF', 'docx', '.Hwp', 'XLSM', '.tsv', '.htm', '.exe', '.json', ''][o_orderkey % 9 + 1] AS ext, CASE o_custkey % 6 WHEN 0 THEN '%PDF-1.7' WHEN 1 THEN '{\\rtf1' WHEN 2 THEN 'PK' || chr(3) || chr(4) || 'xx' WHEN 3 THEN 'plain' WHEN 4 THEN '%PD' ELSE '' END AS head FROM orders)"


def files(spark, sf_dir, *more):
    exts = F.array(*map(F.lit, (".PDF", "docx", ".Hwp", "XLSM", ".tsv", ".htm", ".exe", ".json", "")))
    k = F.col("o_custkey") % 6
    head = F.when(k == 0, "%PDF-1.7").when(k == 1, "{\\rtf1").when(k == 2, "PK\x03\x04xx").when(k == 3, "plain").when(k == 4, "%PD").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", exts[(F.col("o_orderkey") % 9).cast("int")].alias("ext"), head.alias("head"), *more)


_BY_EXT = f"(SELECT f.*, x.format AS by_ext, x.family AS ext_family FROM {FILES} f LEFT JOIN (SELECT format, family, unnest(ext) AS e FROM {FORMATS}) x ON x.e = lower(ltrim(f.ext, '.')))"
_SNIFF = "CASE WHEN starts_with(head, '%PDF-') THEN 'pdf' WHEN starts_with(head, '{\\rt') THEN 'rtf' WHEN starts_with(head, 'PK' || chr(3) || chr(4)) THEN 'zip' END"


@query("src02_known_extension", f"SELECT o_orderkey, by_ext IS NOT NULL AS known FROM {_BY_EXT}")
def _(spark, sf_dir):
    return files(spark, sf_dir).select("o_orderkey", fm.format_of_ext(F.col("ext")).isNotNull().alias("known"))


@query("src03_format_of_extension", f"SELECT o_orderkey, by_ext AS format FROM {_BY_EXT}")
def _(spark, sf_dir):
    return files(spark, sf_dir).select("o_orderkey", fm.format_of_ext(F.col("ext")).alias("format"))


@query("src04_sniff", f"SELECT o_orderkey, {_SNIFF} AS kind FROM {FILES}")
def _(spark, sf_dir):
    return files(spark, sf_dir).select("o_orderkey", fm.sniff(F.encode("head", "UTF-8")).alias("kind"))


@query("src07_resolve_format", f"SELECT o_orderkey, CASE WHEN c IS NULL THEN by_ext WHEN ext_family = cf AND by_ext IN ('xlsx', 'csv', 'md', 'html', 'txt') THEN by_ext WHEN cf IS NULL THEN by_ext ELSE c END AS format FROM (SELECT *, CASE c WHEN 'pdf' THEN 'fixed' WHEN 'rtf' THEN 'document' WHEN 'xls' THEN 'spreadsheet' END AS cf FROM (SELECT *, CASE {_SNIFF} WHEN 'zip' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'xls' ELSE 'pptx' END ELSE {_SNIFF} END AS c FROM {_BY_EXT}))")
def _(spark, sf_dir):
    s = fm.sniff(F.encode("head", "UTF-8"))
    content = F.when(s == "zip", F.when(F.col("o_orderkey") % 2 == 0, "xls").otherwise("pptx")).otherwise(s)
    return files(spark, sf_dir).select("o_orderkey", fm.resolve(fm.format_of_ext(F.col("ext")), content).alias("format"))


@query("prj12_readable_writable", f"SELECT f.o_orderkey, f.by_ext AS format, coalesce(x.can_read, false) AS can_read, coalesce(x.can_write, false) AS can_write FROM {_BY_EXT} f LEFT JOIN {FORMATS} x ON x.format = f.by_ext")
def _(spark, sf_dir):
    known = files(spark, sf_dir).select("o_orderkey", fm.format_of_ext(F.col("ext")).alias("format"))
    return rq.with_abilities(known, fm.formats(spark))


_NAMES = [f for f, *_ in fm.FORMATS] + ["exe"]
REQUESTS = f"(SELECT o_orderkey, o_custkey, o_orderstatus, {_NAMES}[o_orderkey % {len(_NAMES)} + 1] AS src, {_NAMES}[o_custkey % {len(_NAMES)} + 1] AS dst FROM orders)"


def requests(spark, sf_dir):
    """Each order asks for a conversion from one format to another, known or not."""
    names = F.array(*map(F.lit, _NAMES))
    at = lambda c: F.element_at(names, (F.col(c) % len(_NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", at("o_orderkey").alias("src"), at("o_custkey").alias("dst"))


@query("join10_direct_engine", f"SELECT o_orderkey, r.src, r.dst, engine FROM {REQUESTS} r LEFT JOIN (SELECT src, dst, arg_min(engine, (priority, engine)) AS engine FROM {CAPS} GROUP BY src, dst) e ON e.src = r.src AND e.dst = r.dst")
def _(spark, sf_dir):
    asked = requests(spark, sf_dir).select("o_orderkey", "src", "dst")
    return rq.with_engine(asked, fm.direct(fm.engine_table(spark)))


_STEPS = f"(SELECT DISTINCT src, dst FROM {CAPS} WHERE engine IN ('native', 'word', 'excel'))"
_ROUTES = f"""WITH RECURSIVE s AS {_STEPS}, b(mid, rank) AS (VALUES ('docx', 1), ('xlsx', 2), ('html', 3), ('csv', 4), ('odt', 5)),
  w AS (SELECT src, dst, [src, dst] AS path, 1 AS hops, CAST([] AS BIGINT[]) AS ord FROM s
    UNION ALL SELECT w.src, s.dst, list_append(w.path, s.dst), w.hops + 1, list_append(w.ord, CAST(b.rank AS BIGINT)) FROM w JOIN b ON b.mid = w.dst JOIN s ON s.src = w.dst WHERE w.hops < 3 AND NOT list_contains(w.path, s.dst)),
  best AS (SELECT src, dst, hops, path, row_number() OVER (PARTITION BY src, dst ORDER BY hops, ord, path) AS n FROM w)"""


@query("join11_routes", f"{_ROUTES} SELECT o_orderkey, r.src, r.dst, CAST(hops AS BIGINT) AS hops, array_to_string(path, '>') AS route FROM {REQUESTS} r LEFT JOIN best ON best.src = r.src AND best.dst = r.dst AND n = 1")
def _(spark, sf_dir):
    asked = requests(spark, sf_dir).select("o_orderkey", "src", "dst")
    return rq.with_route(asked, fm.routes(fm.engine_table(spark, ("native", "word", "excel"))))


@query("join12_targets", f"{_ROUTES} SELECT o_orderkey, f.by_ext AS format, targets FROM {_BY_EXT} f LEFT JOIN (SELECT src, string_agg(dst, ',' ORDER BY dst) AS targets FROM best JOIN {FORMATS} x ON x.format = dst WHERE n = 1 AND can_write GROUP BY src) t ON t.src = f.by_ext")
def _(spark, sf_dir):
    known = files(spark, sf_dir).select("o_orderkey", fm.format_of_ext(F.col("ext")).alias("format"))
    return rq.with_targets(known, fm.routes(fm.engine_table(spark, ("native", "word", "excel"))), fm.formats(spark))


@query("srt04_engine_order", f"SELECT o_orderkey, string_agg(engine, '>' ORDER BY priority, engine) AS engines FROM {REQUESTS} r LEFT JOIN {CAPS} c ON c.src = r.src AND c.dst = r.dst GROUP BY o_orderkey")
def _(spark, sf_dir):
    """All engines that can do what an order asks for, the first choice first."""
    return rq.with_engines(requests(spark, sf_dir), fm.engine_table(spark)).select("o_orderkey", "engines")


_ALLOWED = "o_custkey % 2 = 0 AS external, CASE o_custkey % 5 WHEN 1 THEN 'native' WHEN 2 THEN 'word' WHEN 4 THEN 'excel' END AS forced"


@query("prj11_usable_engines", f"SELECT o_orderkey, string_agg(engine, '>' ORDER BY priority, engine) FILTER (CASE WHEN forced IS NULL THEN engine = 'native' OR external ELSE engine = forced END) AS usable FROM (SELECT *, {_ALLOWED} FROM {REQUESTS}) r LEFT JOIN {CAPS} c ON c.src = r.src AND c.dst = r.dst GROUP BY o_orderkey")
def _(spark, sf_dir):
    """Half of the orders allow external engines, some force one."""
    k = F.col("o_custkey") % 5
    forced = F.when(k == 1, "native").when(k == 2, "word").when(k == 4, "excel")
    asked = requests(spark, sf_dir).withColumns({"external": F.col("o_custkey") % 2 == 0, "forced": forced})
    return rq.with_usable_engines(asked, fm.engine_table(spark)).select("o_orderkey", "usable")


@query("agg24_pair_grid", f"SELECT src, count(*) FILTER (dst = 'pdf') AS pdf, count(*) FILTER (dst = 'docx') AS docx, count(*) FILTER (dst = 'xlsx') AS xlsx, count(*) FILTER (dst = 'csv') AS csv, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus = 'O') AS failed FROM {REQUESTS} GROUP BY src")
def _(spark, sf_dir):
    return rq.pair_grid(requests(spark, sf_dir), ["pdf", "docx", "xlsx", "csv"], {"ok": "F", "failed": "O"}, "o_orderstatus")


@query("srt05_sorted_formats", f"SELECT customer, string_agg(DISTINCT by_ext, ',' ORDER BY by_ext) AS formats FROM (SELECT f.*, o.o_custkey AS customer FROM {_BY_EXT} f JOIN orders o ON o.o_orderkey = f.o_orderkey) GROUP BY customer")
def _(spark, sf_dir):
    """The formats of each customer's files."""
    known = files(spark, sf_dir, F.col("o_custkey").alias("customer")).select("customer", fm.format_of_ext(F.col("ext")).alias("format"))
    return rq.sorted_formats(known, "customer")


_ERRORS = "(SELECT l_orderkey, string_agg('  ' || error, chr(10) ORDER BY n) FILTER (n <= 4) AS errors FROM (SELECT l_orderkey, 'supplier ' || l_suppkey || ': ' || l_returnflag AS error, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_returnflag) AS n FROM lineitem WHERE l_returnflag <> 'N') GROUP BY l_orderkey)"


@query("fn31_failed_requests", f"SELECT o_orderkey, upper(src) || ' → ' || upper(dst) || ' 변환에 실패했습니다.' || CASE WHEN errors IS NULL THEN '' ELSE chr(10) || '시도한 방법:' || chr(10) || errors END || CASE WHEN dst = 'hwp' THEN chr(10) || '참고: .hwp 대신 .hwpx로 저장하세요.' WHEN dst IN ('doc', 'xls') OR (src = 'doc' AND o_custkey % 2 = 1) THEN chr(10) || 'LibreOffice를 설치하세요.' ELSE '' END AS report FROM {REQUESTS} LEFT JOIN {_ERRORS} ON l_orderkey = o_orderkey")
def _(spark, sf_dir):
    """Every order as a failed request; its returned lines are the attempts, and even customers have external engines."""
    error = F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string"), F.lit(": "), "l_returnflag")
    tried = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_suppkey", "l_returnflag", error.alias("error")).alias("e"))
    tried = tried.groupBy("o_orderkey").agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["error"]).alias("errors"))
    report = rq.failure_text(F.col("src"), F.col("dst"), F.col("errors"), F.col("o_custkey") % 2 == 0)
    return requests(spark, sf_dir).join(tried, "o_orderkey", "left").select("o_orderkey", report.alias("report"))


_ENTRIES = "(SELECT o_custkey AS archive, ['word/document.xml', '../evil', 'C:\\x', 'xl/vbaProject.bin', 'a/..b/c', '/root'][CASE WHEN o_custkey % 4 = 0 THEN o_orderkey % 6 + 1 ELSE 1 + 3 * (o_orderkey % 2) END] AS name, CAST(o_totalprice AS BIGINT) * (o_custkey % 50) AS size, CAST(o_totalprice AS BIGINT) // (1 + o_custkey % 7) AS packed FROM orders)"


def entries(spark, sf_dir):
    names = F.array(*map(F.lit, ("word/document.xml", "../evil", "C:\\x", "xl/vbaProject.bin", "a/..b/c", "/root")))
    at = F.when(F.col("o_custkey") % 4 == 0, F.col("o_orderkey") % 6 + 1).otherwise(1 + 3 * (F.col("o_orderkey") % 2)).cast("int")
    price = F.rint("o_totalprice").cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("archive"), F.element_at(names, at).alias("name"), (price * (F.col("o_custkey") % 50)).alias("size"), F.floor(price / (1 + F.col("o_custkey") % 7)).alias("packed"))


_UNSAFE = "(starts_with(replace(name, '\\', '/'), '/') OR substr(name, 2, 1) = ':' OR regexp_matches(replace(name, '\\', '/'), '(^|/)\\.\\.(/|$)'))"


@query("src59_unsafe_paths", f"SELECT archive, name, count(*) AS n, any_value({_UNSAFE}) AS unsafe FROM {_ENTRIES} GROUP BY archive, name")
def _(spark, sf_dir):
    return entries(spark, sf_dir).groupBy("archive", "name").agg(F.count("*").alias("n"), F.first(fm.unsafe_path(F.col("name"))).alias("unsafe"))


@query("src58_archive_audit", f"SELECT archive, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes, NOT bool_or({_UNSAFE} OR size > 536870912 OR (packed > 0 AND size / packed > 200 AND size > 8388608)) AND count(*) <= 20000 AND sum(size) <= 2147483648 AS safe, bool_or(contains(lower(name), 'vbaproject.bin') OR contains(lower(name), 'macros/') OR contains(lower(name), 'scripts/')) AS macros FROM {_ENTRIES} GROUP BY archive")
def _(spark, sf_dir):
    return fm.audit(entries(spark, sf_dir))


@query("agg23_batch_report", "SELECT o_orderpriority AS batch, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderstatus = 'P') AS warned, CASE WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN 1 ELSE 0 END AS exit_code FROM orders GROUP BY o_orderpriority")
def _(spark, sf_dir):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("batch")).agg(n("F").alias("ok"), n("O").alias("failed"), n("P").alias("warned"), F.when(n("O") > 0, 1).otherwise(0).alias("exit_code"))


@query("snk32_numbered_names", "WITH t AS (SELECT DISTINCT c_mktsegment AS name, c_nationkey + 1 AS n FROM customer WHERE c_custkey % 2 = 0), w AS (SELECT DISTINCT c_mktsegment AS name FROM customer) SELECT name, CAST(min(n) AS BIGINT) AS free FROM (SELECT name, 1 AS n FROM w UNION ALL SELECT name, n + 1 FROM t) x WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.name = x.name AND t.n = x.n) GROUP BY name")
def _(spark, sf_dir):
    """The first free number of each name, whatever is taken."""
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "name")
    return least_free(c.select("name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey") + 1).cast("long").alias("n")), "name", "n")


@query("join01_style_lookup", "SELECT e.event_id, coalesce(s.pt, 10.5::DOUBLE) AS pt, coalesce(s.bold, false) AS bold FROM events e LEFT JOIN (SELECT p_partkey AS id, p_size / 2::DOUBLE AS pt, p_size > 25 AS bold FROM part WHERE p_partkey % 3 > 0) s ON s.id = e.user_id")
def _(spark, sf_dir):
    styles = table(spark, sf_dir, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("user_id"), (F.col("p_size") / 2).alias("pt"), (F.col("p_size") > 25).alias("bold"))
    return table(spark, sf_dir, "events").join(styles, "user_id", "left").select("event_id", F.coalesce("pt", F.lit(10.5)).alias("pt"), F.coalesce("bold", F.lit(False)).alias("bold"))


@query("join03_picture_cascade", "SELECT o_orderkey, arg_min(found, rank) AS found, count(found) = 0 AS warning FROM (SELECT o_orderkey, rank, s_name AS found FROM (SELECT o_orderkey, unnest([1, 2, 3]) AS rank, unnest([o_custkey, o_custkey % 100, o_orderkey % 90 + 500]) AS ref FROM orders) c LEFT JOIN supplier ON s_suppkey = ref AND s_suppkey % 2 = 0) GROUP BY o_orderkey")
def _(spark, sf_dir):
    """References in order of preference; the first that resolves counts, none is a warning."""
    refs = F.array(*(F.struct(F.lit(i).alias("rank"), r.cast("long").alias("ref")) for i, r in enumerate((F.col("o_custkey"), F.col("o_custkey") % 100, F.col("o_orderkey") % 90 + 500), 1)))
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.inline(refs))
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("ref"), F.col("s_name").alias("found"))
    return asked.join(known, "ref", "left").groupBy("o_orderkey").agg(F.min_by("found", F.when(F.col("found").isNotNull(), F.col("rank"))).alias("found"), (F.count("found") == 0).alias("warning"))

"""Queries over files that Spark derives from the tables: written, committed and read as data sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellumine.plans.registry import query
from vellumine.shared import checkpoint_root, table
from vellumine.sinks.committed import write_files
from vellumine.sources.files import contents
from vellumine.sources.formats import sniff
from vellumine.sources.lines import read_lines


def name_of(path: str):
    return F.regexp_extract(path, "([^/]*)$", 1)


def folder(spark) -> str:
    return f"{checkpoint_root(spark)}/files/{uuid.uuid4().hex}"


@query("src55_lines_source", "SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS ord, unnest(string_split(text, chr(10))) AS text FROM documents WHERE lang = 'en'")
def _(spark, sf_dir):
    """Every line of the documents, stored as text in a folder for each language and read back from one of them, which the path's filter chooses."""
    at = folder(spark)
    lines = table(spark, sf_dir, "documents").select("lang", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line"))
    lines.select("lang", F.concat_ws("\t", "doc_id", "ord", "line").alias("value")).write.partitionBy("lang").text(at)
    got = read_lines(spark, at, columns="path string, text string", encoding="utf-8", format="txt", range_bytes=4 << 20, pushdown=True).where(F.contains("path", F.lit("/lang=en/")))
    parts = F.split("text", "\t", 3)
    return got.where("text <> ''").select(parts[0].cast("long").alias("doc_id"), parts[1].cast("int").alias("ord"), parts[2].alias("text"))


@query("src56_delimited_source", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority || ';\"' || o_orderstatus AS note FROM orders")
def _(spark, sf_dir):
    """Orders stored as delimited text, with delimiters and quotes within values; the delimiter is told by each file's head."""
    at = folder(spark)
    note = F.concat("o_orderpriority", F.lit(';"'), "o_orderstatus")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", note).write.option("sep", ";").option("escape", '"').csv(at)
    cell = lambda k: F.col("cells")[k]
    got = read_lines(spark, at, columns="cells array<string>", encoding="utf-8").where(F.size("cells") > 1)
    return got.select(cell(0).cast("long").alias("o_orderkey"), cell(1).cast("long").alias("o_custkey"), cell(2).alias("o_orderstatus"), cell(3).alias("note"))


_CONV = "(SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE string_split(text, chr(10))[1] END AS line FROM conversations)"


@query(
    "snk31_committed_files",
    f"""SELECT name, CAST(place AS BIGINT) AS "at", text FROM (
  SELECT 'c' || conv_id || '.txt' AS name, line AS text, turn, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
         line = '' AND coalesce(lag(line) OVER (PARTITION BY conv_id ORDER BY turn) = '', false) AS again FROM {_CONV}) WHERE NOT again""",
)
def _(spark, sf_dir):
    """Each conversation as a file of its turns' first lines, committed together and read back as lines; of blank lines in a row the first stays."""
    at = folder(spark)
    line = F.when(F.col("turn") % 3 == 2, "").otherwise(F.split("text", "\n", 2)[0])
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    files = turns.select(F.concat(F.lit("c"), "conv_id", F.lit(".txt")).alias("name"), F.encode(F.array_join("lines.line", "\n"), "UTF-8").alias("content"), F.col("conv_id").cast("string").alias("source"))
    write_files(files, at)
    got = read_lines(spark, at, columns="path string, at long, text string", encoding="utf-8")
    return got.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "at", "text")


@query("snk33_verified_files", """SELECT name, CASE WHEN k % 5 = 0 THEN false WHEN k % 3 = 2 THEN k % 7 NOT IN (1, 2) WHEN k % 7 = 3 THEN false WHEN k % 7 IN (1, 2) THEN k % 7 - 1 = k % 3 ELSE true END AS ok FROM (SELECT 'p' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.rtf' ELSE '.txt' END AS name, p_partkey AS k FROM part)""")
def _(spark, sf_dir):
    """Files of parts, committed and opened again: good if they aren't empty and their first bytes don't speak against their names."""
    at, k = folder(spark), F.col("p_partkey")
    ext = F.when(k % 3 == 0, "pdf").when(k % 3 == 1, "rtf").otherwise("txt")
    magic = F.when(k % 7 == 1, "%PDF-1.4 ").when(k % 7 == 2, "{\\rtf1 ").when((k % 7 == 3) | (ext == "txt"), "").when(ext == "pdf", "%PDF-1.7 ").otherwise("{\\rtf1 ")
    content = F.when(k % 5 == 0, "").otherwise(F.concat(magic, "p_name"))
    report = f"{folder(spark)}-report"
    write_files(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), k.cast("string"), F.lit("."), ext).alias("name"), F.encode(content, "UTF-8").alias("content"), k.cast("string").alias("source")), at, report=report)
    opened = contents(spark.read.schema("saved string").json(report), path="saved").withColumn("name", name_of("path"))
    said, named = sniff(F.col("content")), F.regexp_extract("name", r"\.([^.]*)$", 1)
    fits = F.when(named == "txt", said.isNull()).otherwise(F.coalesce(said == named, F.lit(False)))
    return opened.select("name", (F.coalesce(F.col("length") > 0, F.lit(False)) & fits).alias("ok"))

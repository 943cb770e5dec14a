"""Files written from the driver's tables and read back."""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.plans.documents import LINES
from vellumine.plans.registry import query
from vellumine.plans.tables import CELLS, cells
from vellumine.shared import dealt, table
from vellumine.sources import files
from vellumine.sources.office import encoding_of
from vellumine.sources.text import delimiter

#: Files of a task: what they cost in Python isn't told by their bytes.
FILES = 250


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, blocks: a paragraph for each line, every tenth a heading."""
    made = F.transform(
        F.split("text", "\n", -1),
        lambda t, i: F.struct(F.lit("paragraph").alias("kind"), t.alias("text"), F.when(i % 10 == 3, (F.col("doc_id") % 6 + 1).cast("int")).otherwise(0).alias("heading"), F.lit("none").alias("list_kind"), F.lit(0).alias("level"), F.array().cast("array<struct<r:int,c:int,row_span:int,col_span:int,text:string>>").alias("cells")),
    )
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", each=FILES).select("doc_id", made.alias("blocks"))


def grid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_id, blocks: one table with the cells of a customer's orders."""
    c = F.struct("r", "c", F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), "text")
    rows = cells(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit(" "))).groupBy("table_id").agg(F.sort_array(F.collect_list(c)).alias("cells"))
    return rows.select("table_id", F.array(F.struct(F.lit("table").alias("kind"), F.lit("grid").alias("text"), F.lit(0).alias("heading"), F.lit("none").alias("list_kind"), F.lit(0).alias("level"), "cells")).alias("blocks"))


def back(documents: DataFrame, target: str, key: str) -> DataFrame:
    return files.read(files.write(documents, target, key=key).withColumn("format", F.lit(target)), key=key, content="output")


_PARAGRAPHS = f"SELECT doc_id, ord, line AS text, CASE WHEN ord % 10 = 3 THEN CAST(doc_id % 6 + 1 AS INTEGER) ELSE 0 END AS heading FROM {LINES}"


@query("src22_docx_round_trip", _PARAGRAPHS)
def _(spark, sf_dir):
    return files.blocks_of(back(line_blocks(spark, sf_dir), "docx", "doc_id"), key="doc_id").select("doc_id", "ord", "text", "heading")


@query("src29_hwpx_round_trip", f"SELECT doc_id, ord, line AS text FROM {LINES}")
def _(spark, sf_dir):
    return files.blocks_of(back(line_blocks(spark, sf_dir), "hwpx", "doc_id"), key="doc_id").select("doc_id", "ord", "text")


_FILLED = f"SELECT table_id, r, c, replace(text, chr(10), ' ') AS text FROM {CELLS} WHERE text <> ''"


@query("src17_xlsx_round_trip", _FILLED)
def _(spark, sf_dir):
    return files.cells_of(back(grid_blocks(spark, sf_dir), "xlsx", "table_id"), key="table_id").select("table_id", "r", "c", "text")


@query("src21_csv_round_trip", _FILLED)
def _(spark, sf_dir):
    got = files.cells_of(back(grid_blocks(spark, sf_dir), "csv", "table_id"), key="table_id")
    return got.where("text <> ''").select("table_id", "r", "c", "text")


@query("src26_docx_tables", f"SELECT table_id, r, c, replace(text, chr(10), ' ') AS text FROM {CELLS}")
def _(spark, sf_dir):
    return files.cells_of(back(grid_blocks(spark, sf_dir), "docx", "table_id"), key="table_id").select("table_id", "r", "c", "text")


@query("src14_html_tables", f"SELECT table_id, r, c, trim(regexp_replace(replace(text, chr(10), ' '), ' +', ' ', 'g')) AS text FROM {CELLS} WHERE trim(text) <> ''")
def _(spark, sf_dir):
    got = files.cells_of(back(grid_blocks(spark, sf_dir), "html", "table_id"), key="table_id")
    return got.where(F.trim(F.replace("text", F.lit(" "), F.lit(" "))) != "").select("table_id", "r", "c", "text")


@query("src11_html_scan")
def _(spark, sf_dir):
    pages = dealt(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", each=FILES)
    asked = pages.select("page_id", F.encode("html", "UTF-8").alias("content"), F.lit("html").alias("format"))
    return files.blocks_of(files.read(asked, key="page_id"), key="page_id")


@query("snk11_json_dump")
def _(spark, sf_dir):
    return files.write(line_blocks(spark, sf_dir), "json", key="doc_id").select("doc_id", F.decode("output", "UTF-8").alias("json"))


_HANGUL = "".join(chr(0xAC00 + 28 * k) for k in range(26))


@query("agg08_encodings", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'utf-8-sig' WHEN 1 THEN 'utf-16' ELSE CASE WHEN regexp_matches(text, '[a-z]') THEN 'cp949' ELSE 'utf-8-sig' END END AS encoding FROM documents")
def _(spark, sf_dir):
    """Each text's own bytes: with the byte order mark of its encoding, or its small letters as Hangul in the Korean code page, which no mark tells."""
    @F.pandas_udf("string")
    def guess(ids: pd.Series, texts: pd.Series) -> pd.Series:
        made = [("\ufeff" + t).encode("utf-8") if i % 3 == 0 else t.encode("utf-16") if i % 3 == 1 else t.encode("cp949", "ignore") for i, t in zip(ids, texts, strict=True)]
        return pd.Series([encoding_of(x) for x in made])

    text = F.when(F.col("doc_id") % 3 == 2, F.translate("text", string.ascii_lowercase, _HANGUL)).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", guess("doc_id", text).alias("encoding"))


@query("agg09_sniffed_delimiter", "SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 THEN chr(9) ELSE [',', ';', chr(9), '|'][l_orderkey % 4 + 1] END AS delimiter FROM lineitem GROUP BY l_orderkey")
def _(spark, sf_dir):
    """The lines of each order as delimited text whose quoted field holds more of the other delimiters; a fifth are .tsv."""
    by = F.element_at(F.array(*map(F.lit, (",", ";", "\t", "|"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    quoted = F.concat(F.lit('"'), "l_returnflag", F.lit(', x, y; z; u|v|w, t"'))
    line = F.concat_ws("\x00", F.col("l_linenumber").cast("string"), quoted, F.col("l_partkey").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", F.replace(line, F.lit("\x00"), by).alias("line")).alias("e"))
    texts = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["line"]), "\n").alias("text"))
    extension = F.when(F.col("l_orderkey") % 5 == 0, "tsv").otherwise("csv")
    return texts.select("l_orderkey", delimiter(F.col("text"), extension).alias("delimiter"))

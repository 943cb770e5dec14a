"""Text and Markdown as blocks."""

from __future__ import annotations

import csv

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import normal_lines, strip
from vellumine.operators.blocks import compact


def txt_blocks(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """doc_id, ord, kind, text: a paragraph for each line, blank runs compacted."""
    lines = docs.select("doc_id", F.posexplode(F.split(normal_lines(F.col(text)), "\n", -1)).alias("ord", "text"))
    return compact(lines.withColumn("kind", F.lit("paragraph")))


def in_fence(fence: Column, key: str, order: str) -> Column:
    """Whether a line stands between two fences; the fences themselves don't."""
    n = F.count_if(fence).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return (n % 2 == 1) & ~fence


# The line forms of Markdown that are read.
HEADING, BULLET, NUMBER = r"^(#{1,6})\s+(.*)$", r"^(\s*)[-*+]\s+(.*)$", r"^(\s*)\d+[.)]\s+(.*)$"
RULE = r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$"
LINK, STRONG = r"\[([^\]]*)\]\(([^)]*)\)", r"\*\*(.+?)\*\*"


def md_lines(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """doc_id, ord, kind, heading, list_kind, level, text of the lines of Markdown.

    Kinds are code, table (header, rule and body lines of a pipe table) and paragraph;
    fences are left out.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    rows = docs.select("doc_id", F.posexplode(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)).alias("ord", "line"))
    rows = rows.withColumn("_f", F.startswith(strip(F.col("line")), F.lit("```")))
    rows = rows.withColumn("_code", in_fence(F.col("_f"), "doc_id", "ord")).where("not _f")
    piped = F.contains("line", F.lit("|")) & (strip(F.col("line")) != "") & ~F.col("_code")
    rows = rows.withColumn("_pipe", piped).withColumn("_rule", piped & F.col("line").rlike(RULE))
    head = F.col("_pipe") & F.coalesce(F.lead("_rule").over(w), F.lit(False))
    rows = rows.withColumn("_head", head)
    # a run of piped lines is a table from its first header on
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_pipe"), 0).otherwise(1)).over(w))
    seen = F.max(F.col("_head").cast("int")).over(Window.partitionBy("doc_id", "_run").orderBy("ord")) == 1
    in_table = F.col("_pipe") & seen
    level = lambda p: F.floor(F.length(F.regexp_extract("line", p, 1)) / 2).cast("int")
    heading = F.when(F.col("line").rlike(HEADING), F.length(F.regexp_extract("line", HEADING, 1))).otherwise(0)
    plain = ~F.col("_code") & ~in_table
    kind = F.when(F.col("_code"), "code").when(in_table & F.col("_rule"), "rule").when(in_table, "table").otherwise("paragraph")
    bullet, number = F.col("line").rlike(BULLET), F.col("line").rlike(NUMBER)
    is_heading = heading > 0
    return rows.select(
        "doc_id",
        "ord",
        kind.alias("kind"),
        F.when(plain, heading).otherwise(0).alias("heading"),
        F.when(plain & ~is_heading & bullet, "bullet").when(plain & ~is_heading & number, "number").otherwise("none").alias("list_kind"),
        F.when(plain & ~is_heading & bullet, level(BULLET)).when(plain & ~is_heading & number, level(NUMBER)).otherwise(0).alias("level"),
        F.when(plain & is_heading, F.regexp_extract("line", HEADING, 2)).when(plain & bullet, F.regexp_extract("line", BULLET, 2)).when(plain & number, F.regexp_extract("line", NUMBER, 2)).otherwise(F.col("line")).alias("text"),
    )


def md_cells(line: Column) -> Column:
    """The cells of a pipe row: outer pipes go, escaped ones split too."""
    inner = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|", -1), lambda c: strip(c))


def md_links(text: Column) -> Column:
    """The links of a paragraph: ARRAY of label and target."""
    return F.transform(F.regexp_extract_all(text, F.lit("(" + LINK + ")"), 1), lambda m: F.struct(F.regexp_extract(m, LINK, 1).alias("label"), F.regexp_extract(m, LINK, 2).alias("href")))


# The delimiters that are told apart, and how many lines tell them.
DELIMITERS, TELLING_LINES = ",;\t|", 40


def delimiter_of(text: str, extension: str = "") -> str:
    """A tab in .tsv; else as the sniffer says of the first lines; else the most frequent one; else a comma."""
    if extension.lower() == "tsv":
        return "\t"
    head = "\n".join(text.splitlines()[:TELLING_LINES])
    try:
        return csv.Sniffer().sniff(head, DELIMITERS).delimiter
    except csv.Error:
        return max(DELIMITERS, key=head.count) if any(map(head.count, DELIMITERS)) else ","


def delimiter(text: Column, extension: Column) -> Column:
    """``delimiter_of`` for each row; only the first lines leave the JVM. A null text or extension is an empty one."""
    @F.pandas_udf("string")
    def told(heads: pd.Series, extensions: pd.Series) -> pd.Series:
        return pd.Series([delimiter_of(h, e) for h, e in zip(heads, extensions, strict=True)], dtype="object")

    none = F.lit("")
    return told(F.substring_index(F.coalesce(text, none), "\n", TELLING_LINES), F.coalesce(extension, none))

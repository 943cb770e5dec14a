"""Formats, engines and routes as small tables, and the recognition of a file's format.

These tables are constants of the program, so broadcasting them is bounded.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats with their extensions, family, and whether they can be read and written.
FORMATS = [
    ("pdf", ["pdf"], "fixed", True, True),
    ("docx", ["docx"], "document", True, True),
    ("doc", ["doc"], "document", True, True),
    ("hwpx", ["hwpx"], "document", True, True),
    ("hwp", ["hwp"], "document", True, False),
    ("xlsx", ["xlsx", "xlsm"], "spreadsheet", True, True),
    ("xls", ["xls"], "spreadsheet", True, True),
    ("csv", ["csv", "tsv"], "spreadsheet", True, True),
    ("txt", ["txt"], "text", True, True),
    ("md", ["md", "markdown"], "text", True, True),
    ("html", ["html", "htm"], "text", True, True),
    ("rtf", ["rtf"], "document", True, False),
    ("odt", ["odt"], "document", True, True),
    ("json", ["json"], "text", False, True),
]
# Engines with their priority, and what each reads and writes.
ENGINES = [
    ("native", 10, "pdf docx hwpx hwp xlsx xls csv txt md html rtf odt", "pdf docx hwpx xlsx csv txt md html json"),
    ("libreoffice", 50, "doc docx odt rtf txt html hwp hwpx xls xlsx csv ods pdf", "pdf docx doc odt rtf txt html xlsx xls csv ods"),
    ("word", 70, "doc docx rtf txt html odt", "docx doc pdf rtf txt html odt"),
    ("excel", 70, "xls xlsx csv", "xlsx xls csv pdf html"),
]
# Formats that a route may pass through, in order of preference, and the longest route.
BRIDGES, MAX_HOPS = ("docx", "xlsx", "html", "csv", "odt"), 3
# Extensions that are more telling than the content of the same family.
TELLING = ("xlsx", "csv", "md", "html", "txt")
# First bytes of files.
MAGIC = {"pdf": "255044462D", "rtf": "7B5C7274", "cfb": "D0CF11E0A1B11AE1", "zip": "504B0304"}


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "format string, ext array<string>, family string, can_read boolean, can_write boolean")


def extensions(spark: SparkSession) -> DataFrame:
    return formats(spark).select("format", "family", F.explode("ext").alias("ext"))


def format_of_ext(ext: Column) -> Column:
    """Case does not matter, nor a leading dot."""
    known = F.create_map(*(F.lit(x) for x in chain.from_iterable((e, f) for f, es, *_ in FORMATS for e in es)))
    return F.try_element_at(known, F.lower(F.regexp_replace(ext, r"^\.", "")))


def family_of(fmt: Column) -> Column:
    known = F.create_map(*(F.lit(x) for x in chain.from_iterable((f, fam) for f, _, fam, *_ in FORMATS)))
    return F.try_element_at(known, fmt)


def sniff(content: Column) -> Column:
    """By the first bytes; null where they say nothing."""
    head, kind = F.hex(F.substring(content, 1, 8)), F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        kind = F.when(F.startswith(head, F.lit(magic)), name).otherwise(kind)
    return kind


def resolve(by_ext: Column, by_content: Column) -> Column:
    """The content decides, unless it says nothing, is unknown, or the extension is telling within its family."""
    same_family = family_of(by_ext) == family_of(by_content)
    return F.when(by_content.isNull(), by_ext).when(same_family & by_ext.isin(*TELLING), by_ext).when(family_of(by_content).isNull(), by_ext).otherwise(by_content)


def engine_table(spark: SparkSession, names: tuple[str, ...] = ("native", "libreoffice", "word", "excel")) -> DataFrame:
    """engine, priority, src, dst: every direct conversion."""
    rows = [(e, p, s, d) for e, p, r, w in ENGINES if e in names for s in r.split() for d in w.split() if s != d]
    return spark.createDataFrame(rows, "engine string, priority int, src string, dst string")


def direct(engines: DataFrame) -> DataFrame:
    """src, dst, engine: the engine of the least priority number."""
    return engines.groupBy("src", "dst").agg(F.min(F.struct("priority", "engine")).alias("e")).select("src", "dst", "e.engine")


def routes(engines: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """src, dst, hops, path: the shortest route, bridges in order of preference on ties.

    Routes grow hop by hop through bridges; what is reached in fewer hops stays.
    """
    steps = direct(engines).select("src", "dst")
    rank = F.array_position(F.array(*map(F.lit, BRIDGES)), F.col("dst"))
    found = steps.select("src", "dst", F.array("src", "dst").alias("path"), F.lit(1).alias("hops"), F.array().cast("array<bigint>").alias("order"))
    front = found
    for hops in range(2, max_hops + 1):
        via = front.where(F.col("dst").isin(*BRIDGES)).withColumn("order", F.concat("order", F.array(rank)))
        grown = via.alias("a").join(steps.alias("b"), (F.col("a.dst") == F.col("b.src")) & ~F.array_contains(F.col("a.path"), F.col("b.dst")))
        front = grown.select("a.src", "b.dst", F.concat("a.path", F.array("b.dst")).alias("path"), F.lit(hops).alias("hops"), "a.order")
        found = found.unionByName(front)
    best = found.groupBy("src", "dst").agg(F.min(F.struct("hops", "order", "path")).alias("m"))
    return best.select("src", "dst", "m.hops", "m.path")


# Limits of an archive, and parts of names that announce macros.
MAX_ENTRIES, MAX_ENTRY, MAX_RATIO, RATIO_FROM, MAX_TOTAL = 20_000, 512 << 20, 200, 8 << 20, 2 << 30
MACROS = ("vbaproject.bin", "macros/", "scripts/")


def unsafe_path(name: Column) -> Column:
    """Absolute, on a drive, or climbing with ``..``."""
    n = F.replace(name, F.lit("\\"), F.lit("/"))
    return F.startswith(n, F.lit("/")) | (F.substring(n, 2, 1) == ":") | n.rlike(r"(^|/)\.\.(/|$)")


def audit(entries: DataFrame) -> DataFrame:
    """archive, entries, bytes, safe, macros of archive entries (archive, name, size, packed)."""
    squeezed = (F.col("packed") > 0) & (F.col("size") / F.col("packed") > MAX_RATIO) & (F.col("size") > RATIO_FROM)
    bad = unsafe_path(F.col("name")) | (F.col("size") > MAX_ENTRY) | squeezed
    macros = F.lit(False)
    for m in MACROS:
        macros = macros | F.contains(F.lower("name"), F.lit(m))
    got = entries.groupBy("archive").agg(F.count("*").alias("entries"), F.sum("size").cast("long").alias("bytes"), F.bool_or(bad).alias("bad"), F.bool_or(macros).alias("macros"))
    return got.select("archive", "entries", "bytes", (~F.col("bad") & (F.col("entries") <= MAX_ENTRIES) & (F.col("bytes") <= MAX_TOTAL)).alias("safe"), "macros")

"""Blocks nested in cells of tables, to any depth.

Blocks are rows (doc_id, id, parent, r, c, ord, kind, text): parent is the id of the table in whose
cell (r, c) a block stands, null on top. Going down, each level is joined to the tables of the one
above; going up, the texts of a level's tables are folded from those of the level below. A
round reads one level, so work is the blocks once and the depth in rounds. Blocks that hang on
nothing (a parent that is missing, no table, or a cycle) are no part of a document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.shared import cut, tasks

#: Rows of a task, of both sides of a join together.
ROWS = 25_000


def paired(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Tables that were cut, joined; beyond ``ROWS`` for each shuffle partition by sorting, in tasks that don't grow with them."""
    spark = left.sparkSession
    n = tasks(spark, left.count() + right.count(), ROWS)
    if n <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return left.join(right, on, how)
    return left.repartition(n, *on).join(right.repartition(n, *on).hint("merge"), on, how)


def placed(blocks: DataFrame) -> DataFrame:
    """``blocks`` with depth and path: places from the outermost table inwards, whose order is that of a walk through everything."""
    step = F.array(F.struct(F.coalesce("r", F.lit(0)).cast("int").alias("r"), F.coalesce("c", F.lit(0)).cast("int").alias("c"), F.col("ord").cast("long").alias("ord")))
    top = F.array(F.struct(F.lit(0).alias("r"), F.lit(0).alias("c"), F.col("ord").cast("long").alias("ord")))
    levels = [cut(blocks.where("parent is null").withColumns({"depth": F.lit(0), "path": top}), "level")]
    inner = cut(blocks.where("parent is not null"), "inner")
    while not levels[-1].isEmpty():
        above = levels[-1].where("kind = 'table'").select("doc_id", F.col("id").alias("parent"), F.col("depth").alias("above"), F.col("path").alias("outer"))
        below = paired(inner, above, ["doc_id", "parent"])
        levels.append(cut(below.select(*blocks.columns, (F.col("above") + 1).alias("depth"), F.concat("outer", step).alias("path")), "level"))
    return reduce(DataFrame.unionByName, levels)


def placed_texts(at: str, text: Column, size: Column, sep: str) -> Column:
    """Texts at their places, joined; places that nothing holds are empty."""
    held = F.map_from_entries(F.collect_list(F.struct(at, text)))
    return F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.coalesce(F.try_element_at(held, k), F.lit(""))), sep)


def nested_texts(blocks: DataFrame, *, sep: str = "\t", pad: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cells (doc_id, id, r, c, text) and tables (doc_id, id, text) of every depth.

    A cell's text is that of its parts that aren't empty, by lines; a table's is a line for each row.
    With ``pad`` all rows are as wide as the table.
    """
    at = cut(placed(blocks), "placed")
    deepest = at.agg(F.max("depth")).first()[0] or 0
    cells, tables, below = [], [], None
    for depth in range(deepest, 0, -1):
        level = at.where(F.col("depth") == depth)
        level = paired(level, below, ["doc_id", "id"], "left") if below is not None else level.withColumn("inside", F.lit(None).cast("string"))
        text = F.when(F.col("kind") == "table", F.col("inside")).when(F.col("kind") == "paragraph", F.col("text"))
        parts = F.array_sort(F.collect_list(F.when(text != "", F.struct("ord", text.alias("text")))))
        cell = level.groupBy("doc_id", F.col("parent").alias("id"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
        cells.append(cut(cell, "cells"))
        wide = cells[-1]
        if pad:
            wide = wide.join(wide.groupBy("doc_id", "id").agg((F.max("c") + 1).alias("width")), ["doc_id", "id"])
        rows = wide.groupBy("doc_id", "id", "r").agg(placed_texts("c", F.col("text"), F.max("width") if pad else F.max("c") + 1, sep).alias("line"))
        tables.append(cut(rows.groupBy("doc_id", "id").agg(placed_texts("r", F.col("line"), F.max("r") + 1, "\n").alias("text")), "tables"))
        below = tables[-1].withColumnRenamed("text", "inside")
    bare = at.where("kind = 'table'").select("doc_id", "id")
    filled = reduce(DataFrame.unionByName, tables) if tables else bare.limit(0).withColumn("text", F.lit(""))
    none = bare.join(filled.select("doc_id", "id"), ["doc_id", "id"], "left_anti").withColumn("text", F.lit(""))
    every = reduce(DataFrame.unionByName, cells) if cells else at.limit(0).select("doc_id", "id", F.col("r").cast("int"), F.col("c").cast("int"), "text")
    return every, filled.unionByName(none)

"""Rectangles and ruling lines on pages: pairs that meet, by a grid of cells.

A rectangle (x0, y0, x1, y1) is dealt to the cells of its page that it touches; rectangles of
one cell are compared. A pair that shares several cells counts in the one that holds the
upper left corner of what both cover, so that it is found once, without a distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.operators.grids import overlap_share
from vellumine.shared import cut

CELL, TOLERANCE = 100.0, 3.0


def _cell(x: Column, cell: float) -> Column:
    return F.floor(x / cell)


def _dealt(rects: DataFrame, name: str, cell: float) -> DataFrame:
    box = F.struct("x0", "y0", "x1", "y1").alias(name)
    wide = rects.select("page", F.col("id").alias(f"{name}_id"), box, F.explode(F.sequence(_cell(F.col("x0"), cell), _cell(F.col("x1"), cell))).alias("cx"))
    return wide.select("*", F.explode(F.sequence(_cell(F.col(name)["y0"], cell), _cell(F.col(name)["y1"], cell))).alias("cy"))


def meeting(a: DataFrame, b: DataFrame, *, cell: float = CELL) -> DataFrame:
    """page, a_id, a, b_id, b of rectangles (page, id, x0, y0, x1, y1) that have a point in common."""
    left, top = F.greatest(F.col("a.x0"), F.col("b.x0")), F.greatest(F.col("a.y0"), F.col("b.y0"))
    met = (left <= F.least(F.col("a.x1"), F.col("b.x1"))) & (top <= F.least(F.col("a.y1"), F.col("b.y1")))
    here = (_cell(left, cell) == F.col("cx")) & (_cell(top, cell) == F.col("cy"))
    return _dealt(a, "a", cell).join(_dealt(b, "b", cell), ["page", "cx", "cy"]).where(met & here).select("page", "a_id", "a", "b_id", "b")


def outside(items: DataFrame, tables: DataFrame, share: float, *, cell: float = CELL) -> DataFrame:
    """``items`` that no table of their page covers by ``share`` of their area."""
    covered = meeting(items, tables, cell=cell).where(overlap_share(F.col("a"), F.col("b")) >= share).select("page", F.col("a_id").alias("id")).distinct()
    return items.join(covered, ["page", "id"], "left_anti")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """page, id, root (the least id that a node is linked to). Each round takes the least root of the neighbours, then the root's root.

    Tables that were cut count by their compressed files, so these joins are told not to broadcast them.
    """
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = cut(edges.select("page", ends.alias("e")).select("page", "e.a", "e.b").distinct(), "edges")
    roots = cut(nodes.select("page", "id", F.col("id").alias("root")), "roots")
    while True:
        near = both.join(roots.hint("merge"), (roots["page"] == both["page"]) & (roots["id"] == both["b"])).select(both["page"], F.col("a").alias("id"), F.col("root").alias("near"))
        least = near.groupBy("page", "id").agg(F.min("near").alias("near"))
        took = roots.join(least.hint("merge"), ["page", "id"], "left").select("page", "id", F.col("root").alias("was"), F.least("root", "near").alias("up"))
        hop = roots.select("page", F.col("id").alias("up"), F.col("root").alias("far"))
        new = cut(took.join(hop.hint("merge"), ["page", "up"], "left").select("page", "id", "was", F.least("up", "far").alias("root")), "roots")
        if new.where("root <> was").isEmpty():
            return new.select("page", "id", "root")
        roots = new.select("page", "id", "root")


def ruled_tables(lines: DataFrame, *, tolerance: float = TOLERANCE) -> DataFrame:
    """page, table, xs, ys, x0, y0, x1, y1: grids of ruling lines (page, id, x0, y0, x1, y1).

    Horizontal and vertical lines that meet within ``tolerance`` belong together; edges within
    it are one. A grid has two edges each way at least; ``table`` is the least id of its lines.
    """
    spread = lambda level: lines.where(level).select("page", "id", *(F.col(c) - tolerance / 2 for c in ("x0", "y0")), *(F.col(c) + tolerance / 2 for c in ("x1", "y1"))).toDF("page", "id", "x0", "y0", "x1", "y1")
    lines = cut(lines, "lines")  # read for both ways, as nodes and for the edges
    flat, steep = F.col("y1") - F.col("y0") <= tolerance, F.col("x1") - F.col("x0") <= tolerance
    met = meeting(spread(flat & ~steep), spread(steep & ~flat)).select("page", F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    belongs = components(met, lines.where(flat != steep))
    mine = lines.join(belongs.hint("merge"), ["page", "id"])
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    edges = mine.select("page", F.col("root").alias("table"), F.when(flat, "y").otherwise("x").alias("way"), F.when(flat, middle("y0", "y1")).otherwise(middle("x0", "x1")).alias("v")).distinct()
    w = Window.partitionBy("page", "table", "way").orderBy("v")
    first = edges.withColumn("before", F.lag("v").over(w)).where((F.col("before").isNull()) | (F.col("v") - F.col("before") > tolerance))
    grids = first.groupBy("page", "table").agg(*(F.sort_array(F.collect_list(F.when(F.col("way") == k, F.col("v")))).alias(f"{k}s") for k in "xy"))
    end = lambda c, k: F.element_at(c, k)
    return grids.where((F.size("xs") > 1) & (F.size("ys") > 1)).select("*", end("xs", 1).alias("x0"), end("ys", 1).alias("y0"), end("xs", -1).alias("x1"), end("ys", -1).alias("y1"))


def table_cells(grids: DataFrame, words: DataFrame) -> DataFrame:
    """page, table, r, c, text: words (page, id, x0, y0, x1, y1, text) whose centre lies in a cell, from top to bottom, then left to right; grids without text are left out."""
    grids = cut(grids, "grids")  # read twice
    centre = lambda a, b: (F.col(a) + F.col(b)) / 2
    points = words.select("page", "id", centre("x0", "x1").alias("x0"), centre("y0", "y1").alias("y0"), centre("x0", "x1").alias("x1"), centre("y0", "y1").alias("y1"))
    boxes = grids.select("page", F.col("table").alias("id"), "x0", "y0", "x1", "y1")
    held = meeting(points, boxes).select("page", F.col("a_id").alias("id"), F.col("b_id").alias("table"), F.col("a.x0").alias("x"), F.col("a.y0").alias("y"))
    at = held.join(grids.select("page", "table", "xs", "ys").hint("merge"), ["page", "table"]).join(words.select("page", "id", "text").hint("merge"), ["page", "id"])
    place = lambda edges, v: F.least(F.size(F.filter(edges, lambda e: e <= v)), F.size(edges) - 1) - 1
    parts = F.array_sort(F.collect_list(F.struct("y", "x", "id", "text")))
    cells = at.groupBy("page", "table", place(F.col("ys"), F.col("y")).alias("r"), place(F.col("xs"), F.col("x")).alias("c")).agg(F.trim(F.array_join(F.transform(parts, lambda p: p["text"]), " ")).alias("text"))
    return cells.where("text <> ''")

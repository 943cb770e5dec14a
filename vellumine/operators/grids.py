"""Operators over table grids: rows (table_id, r, c, text) and merges (table_id, r, c, row_span, col_span)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import display_width, is_blank, strip, visual_length
from vellumine.operators.blocks import joined

# Most preferred characters of a column, cell padding, narrowest column and content, sheet widths.
PREFER_MAX, CELL_PAD, COLUMN_MIN, CONTENT_MIN = 44, 9.5, 12.0, 40.0
SHEET_MIN, SHEET_MAX, SHEET_ROWS = 8, 60, 400
PRIMARY_LEAST = 50


def extent(cells: DataFrame) -> DataFrame:
    return cells.groupBy("table_id").agg(F.count_distinct("r").alias("n_rows"), (F.max("c") + 1).alias("n_cols"))


def covered(merges: DataFrame) -> DataFrame:
    """Each cell that a merge covers, with its anchor; the anchor itself is left out."""
    area = merges.select("table_id", F.col("r").alias("r0"), F.col("c").alias("c0"), F.explode(F.sequence("r", F.col("r") + F.col("row_span") - 1)).alias("r"), "col_span")
    area = area.select("table_id", "r0", "c0", "r", F.explode(F.sequence("c0", F.col("c0") + F.col("col_span") - 1)).alias("c"))
    return area.where((F.col("r") != F.col("r0")) | (F.col("c") != F.col("c0")))


def fill_merges(cells: DataFrame, merges: DataFrame, policy: str) -> DataFrame:
    """Covered cells become empty (``placeholder``) or take the anchor's text (``duplicate``).

    Where merges overlap, the one whose anchor comes last in reading order counts.
    """
    over = covered(merges).groupBy("table_id", "r", "c").agg(F.max(F.struct("r0", "c0")).alias("a"))
    if policy == "placeholder":
        return cells.join(over, ["table_id", "r", "c"], "left").select("table_id", "r", "c", F.when(F.col("a").isNotNull(), "").otherwise(F.col("text")).alias("text"))
    anchors = cells.select("table_id", F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("text").alias("held"))
    over = over.select("table_id", "r", "c", "a.r0", "a.c0").join(anchors, ["table_id", "r0", "c0"])
    return cells.join(over, ["table_id", "r", "c"], "left").select("table_id", "r", "c", F.coalesce("held", "text").alias("text"))


def row_texts(cells: DataFrame, by: str = "\t") -> DataFrame:
    """A row's cells joined, line feeds as spaces."""
    flat = cells.withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    return flat.groupBy("table_id", "r").agg(joined("text", by, "c").alias("line"))


def table_texts(cells: DataFrame, by: str = "\t") -> DataFrame:
    return row_texts(cells, by).groupBy("table_id").agg(joined("line", "\n", "r").alias("text"))


def md_tables(cells: DataFrame) -> DataFrame:
    """Tables in Markdown; the first row is always the header."""
    flat = cells.withColumn("text", F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")))
    lines = flat.groupBy("table_id", "r").agg(F.concat(F.lit("| "), joined("text", " | ", "c"), F.lit(" |")).alias("line"), F.count("*").cast("int").alias("n"))
    first = F.row_number().over(Window.partitionBy("table_id").orderBy("r")) == 1
    rule = F.concat(F.lit("\n|"), F.array_join(F.array_repeat(F.lit(" --- "), F.col("n")), "|"), F.lit("|"))
    return lines.withColumn("line", F.when(first, F.concat("line", rule)).otherwise(F.col("line"))).groupBy("table_id").agg(F.concat(joined("line", "\n", "r"), F.lit("\n")).alias("markdown"))


def html_tables(cells: DataFrame) -> DataFrame:
    """Tables in HTML: placeholders are skipped, the first row has header cells. cells also has row_span, col_span, placeholder."""
    from vellumine.functions.text import html_escape

    tag = F.when(F.col("r") == 0, "th").otherwise("td")
    span = lambda name, c: F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")
    inner = F.when(F.col("text") == "", "&nbsp;").otherwise(F.concat(F.lit("<p>"), html_escape(F.col("text")), F.lit("</p>")))
    cell = F.concat(F.lit("<"), tag, span("colspan", "col_span"), span("rowspan", "row_span"), F.lit(">"), inner, F.lit("</"), tag, F.lit(">"))
    rows = cells.withColumn("cell", F.when(~F.col("placeholder"), cell)).groupBy("table_id", "r").agg(F.concat(F.lit("<tr>"), joined("cell", "", "c"), F.lit("</tr>")).alias("row"))
    return rows.groupBy("table_id").agg(F.concat(F.lit("<table>"), joined("row", "", "r"), F.lit("</table>")).alias("html"))


def used_range(cells: DataFrame) -> DataFrame:
    """Cells up to the last row and the last column that hold something."""
    box = cells.where(~is_blank(F.col("text"))).groupBy("table_id").agg(F.max("r").alias("_r"), F.max("c").alias("_c"))
    return cells.join(box, "table_id").where((F.col("r") <= F.col("_r")) & (F.col("c") <= F.col("_c"))).drop("_r", "_c")


def trim_rows(cells: DataFrame) -> DataFrame:
    """Blank rows at the end go."""
    last = F.max(F.when(~is_blank(F.col("text")), F.col("r"))).over(Window.partitionBy("table_id"))
    return cells.withColumn("_last", last).where(F.col("r") <= F.col("_last")).drop("_last")


def filled_rows(cells: DataFrame) -> DataFrame:
    """Rows with no text go, unless that leaves nothing of the table."""
    at = cells.withColumn("_r", F.bool_or(~is_blank(F.col("text"))).over(Window.partitionBy("table_id", "r")))  # first: its order serves the other window too
    return at.withColumn("_t", F.bool_or("_r").over(Window.partitionBy("table_id"))).where(F.col("_r") | ~F.col("_t")).drop("_r", "_t")


def preferred_widths(cells: DataFrame) -> DataFrame:
    """Characters that a column prefers: its longest word or text, at most 44; blank cells don't count."""
    words = F.transform(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), lambda w: visual_length(w))
    most = lambda x: F.least(x, F.lit(PREFER_MAX))
    full = F.when(~is_blank(F.col("text")), F.greatest(most(F.array_max(words)), most(visual_length(F.col("text")))))
    return cells.groupBy("table_id", "c").agg(F.greatest(F.lit(1), F.max(full)).cast("long").alias("width"))


def widths_in_points(widths: DataFrame, usable: float) -> DataFrame:
    """Column widths as shares of the usable width, less padding; a column without a width gets 12 points."""
    w = Window.partitionBy("table_id")
    content = F.greatest(F.lit(CONTENT_MIN), F.lit(usable) - F.lit(CELL_PAD) * F.count("*").over(w))
    total = F.sum(F.when(F.col("width") > 0, F.col("width"))).over(w)
    return widths.withColumn("pt", F.when(F.col("width") > 0, content * (F.col("width") / total)).otherwise(COLUMN_MIN))


def sheet_widths(cells: DataFrame) -> DataFrame:
    """Sheet column widths by the first lines of the first 400 rows, from 8 to 60."""
    longest = F.max(display_width(F.col("text")))
    widths = cells.where(F.col("r") < SHEET_ROWS).groupBy("table_id", "c").agg(longest.alias("n"))
    return widths.where("n > 0").select("table_id", "c", F.least(F.lit(SHEET_MAX), F.greatest(F.lit(SHEET_MIN), F.col("n") + 2)).cast("long").alias("width"))


def primary_sheet(weights: DataFrame) -> DataFrame:
    """book, sheet: the first sheet, unless it holds under 50 characters and another holds more."""
    first = F.min_by("weight", "sheet")
    heaviest = F.max(F.struct("weight", (-F.col("sheet")).alias("back")))
    best = weights.groupBy("book").agg(F.min("sheet").alias("f"), first.alias("fw"), heaviest.alias("h"))
    return best.select("book", F.when((F.col("fw") >= PRIMARY_LEAST) | (F.col("h.weight") <= F.col("fw")), F.col("f")).otherwise(-F.col("h.back")).alias("sheet"))


def primary_first(weights: DataFrame) -> DataFrame:
    """book, sheet, place (from 1): the primary sheet, then the others as they stand."""
    at = weights.join(primary_sheet(weights).withColumnRenamed("sheet", "primary"), "book")
    place = F.row_number().over(Window.partitionBy("book").orderBy(F.col("sheet") != F.col("primary"), "sheet"))
    return at.select("book", "sheet", place.cast("long").alias("place"))


def sheet_weights(cells: DataFrame) -> DataFrame:
    return cells.groupBy("table_id").agg(F.sum(F.length(strip(F.col("text")))).cast("long").alias("weight"))


def header_guess(cells: DataFrame) -> DataFrame:
    """table_id, header: no number in the first row, some text there, and a number or date in the second."""
    number = F.col("kind").isin("int", "float")
    return cells.groupBy("table_id").agg(
        (
            F.coalesce(F.bool_or((F.col("r") == 0) & ~is_blank(F.col("text"))), F.lit(False))
            & ~F.coalesce(F.bool_or((F.col("r") == 0) & number), F.lit(False))
            & F.coalesce(F.bool_or((F.col("r") == 1) & (number | (F.col("kind") == "date"))), F.lit(False))
        ).alias("header")
    )


def vertical_merges(cells: DataFrame) -> DataFrame:
    """table_id, c, r, row_span of cells from vMerge states: ``restart`` opens, ``continue`` extends, anything else closes."""
    w = Window.partitionBy("table_id", "c").orderBy("r")
    head = cells.withColumn("anchor", F.last(F.when(~F.col("state").eqNullSafe("continue"), F.col("r")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    opened = F.last(F.when(~F.col("state").eqNullSafe("continue"), F.coalesce("state", F.lit("none"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    spans = head.withColumn("_o", opened).withColumn("anchor", F.when((F.col("_o") == "restart") | ~F.col("state").eqNullSafe("continue"), F.col("anchor")).otherwise(F.col("r")))
    return spans.groupBy("table_id", "c", F.col("anchor").alias("r")).agg(F.count("*").alias("row_span"))


def overlap_share(own: Column, other: Column) -> Column:
    """The share of a rectangle (x0, y0, x1, y1) that another one covers."""
    area = F.greatest(F.lit(1e-6), (own["x1"] - own["x0"]) * (own["y1"] - own["y0"]))
    side = lambda a, b: F.greatest(F.lit(0.0), F.least(own[b], other[b]) - F.greatest(own[a], other[a]))
    return side("x0", "x1") * side("y0", "y1") / area

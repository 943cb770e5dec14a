"""Rules that go through a text or a table in order: texts as folds of array functions, cells of tables row by row as a task reads them. No cap."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.operators.numbering import running_max
from vellumine.shared import cut, tasks

# Cells of a line, the last narrow character, tags of inline styles.
LINE_CELLS, LAST_NARROW = 90, "ᄀ"
STYLE_TAGS = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "u": "underline", "s": "strike", "strike": "strike", "del": "strike", "code": "code", "kbd": "code", "samp": "code"}
STYLES = ("bold", "italic", "underline", "strike", "code")

#: Cells of a task, and rows between the places where a table of more cells may be cut.
CELLS, PIECE_ROWS = 500_000, 50_000


def wrap(text: Column, width: int = LINE_CELLS) -> Column:
    """Pieces of at most ``width`` cells; characters beyond U+1100 take two.

    Wide ones are followed by a mark, so that a piece is the longest match that no mark follows. Text
    that holds the mark itself is folded.
    """
    if width < 2:
        return wrap_by_fold(text, width)
    text, mark = F.coalesce(text, F.lit("")), "\uffff"
    marked = F.regexp_replace(text, f"([^\\x00-{LAST_NARROW}])", f"$1{mark}")
    pieces = F.regexp_extract_all(marked, F.lit(f"(?s).{{1,{width}}}(?!{mark})|\\A\\z"), F.lit(0))
    return F.when(F.contains(text, F.lit(mark)), wrap_by_fold(text, width)).otherwise(F.transform(pieces, lambda p: F.replace(p, F.lit(mark), F.lit(""))))


def wrap_by_fold(text: Column, width: int) -> Column:
    """The same of any text: the fold keeps where pieces begin."""
    text = F.coalesce(text, F.lit(""))
    characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.array(F.lit(0)).alias("starts"))

    def step(s: Column, ch: Column) -> Column:
        w = F.when(ch > LAST_NARROW, 2).otherwise(1)
        full = s["used"] + w > width
        return F.struct((s["n"] + 1).alias("n"), F.when(full, w).otherwise(s["used"] + w).alias("used"), F.when(full, F.concat(s["starts"], F.array(s["n"]))).otherwise(s["starts"]).alias("starts"))

    starts = F.aggregate(characters, start, step, lambda s: s["starts"])
    once = F.array(F.struct(text.alias("text"), starts.alias("starts")))  # a lambda's variable is computed once, an expression in it for each piece
    return F.flatten(F.transform(once, lambda x: F.transform(x["starts"], lambda at, k: F.substring(x["text"], at + 1, F.coalesce(F.get(x["starts"], k + 1), F.length(x["text"])) - at))))


def spanned_slots(cells: DataFrame, *, counted: DataFrame | None = None) -> DataFrame:
    """table_id, r, k, c: the column of the k-th cell of each row, beside cells that reach down from above.

    Cells are (table_id, r, k, row_span, col_span); those without a row are left out. A task goes once
    through its tables in order and keeps, for each column, the first row that is free. A table of
    over ``CELLS`` cells is cut at rows into which no cell reaches, so that tasks share it. ``counted``
    is a DataFrame with the same table_id as often, if there is one that is cheaper to count.
    """
    span = lambda name: F.greatest(name, F.lit(1)).cast("int")
    spans = cells.where("r is not null").select("table_id", "r", "k", span("row_span").alias("rs"), span("col_span").alias("cs"))
    held = cut((cells if counted is None else counted).groupBy("table_id").count(), "held")
    long, of = held.where(F.col("count") > CELLS).select("table_id"), ["table_id"]
    if not long.isEmpty():
        same = spans["table_id"].eqNullSafe(long["table_id"])
        whole = spans.join(F.broadcast(long), same, "left_anti").withColumn("piece", F.lit(None).cast("long"))
        of = ["table_id", "piece"]
        every = whole.unionByName(_pieces(cut(spans.join(F.broadcast(long), same, "left_semi"), "spans")))
        spans = every.repartition(tasks(cells.sparkSession, held.agg(F.sum("count")).first()[0], CELLS), *of)
    order = ["r", "k", "rs", "cs"]
    first = F.row_number().over(Window.partitionBy(*of).orderBy(*order)) == 1
    sorted_ = spans.withColumn("first", first).sortWithinPartitions(*of, *order)  # the window's own order
    kinds = dict(cells.dtypes)
    return sorted_.mapInArrow(_placed, f"table_id {kinds['table_id']}, r {kinds['r']}, k {kinds['k']}, c int")


def _pieces(spans: DataFrame) -> DataFrame:
    """``spans`` with the first row of the piece in which they stand: of each ``PIECE_ROWS`` rows the first into which no cell reaches, if there is one."""
    rows = spans.groupBy("table_id", "r").agg(F.max(F.col("r").cast("long") + F.col("rs")).alias("end"))
    reached = running_max(rows, F.col("end"), [F.col("r").asc()], "reach", per=["table_id"])
    head = F.when(F.col("reach").isNull() | (F.col("reach") <= F.col("r")), F.col("r").cast("long"))
    least = F.min("head").over(Window.partitionBy("table_id", F.floor(F.col("r") / PIECE_ROWS)))
    begun = reached.withColumn("head", head).withColumn("start", F.when(F.col("r") == least, least))
    at = running_max(begun.select("table_id", "r", "start"), F.col("start"), [F.col("r").asc()], "piece", per=["table_id"], before=False)
    same = spans["table_id"].eqNullSafe(at["table_id"]) & (spans["r"] == at["r"])
    return spans.join(at, same).select(*(spans[c] for c in spans.columns), at["piece"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells in the order of their tables, rows and places, with their columns; ``first`` begins a table or a piece."""
    free: list[int] = []
    row, c = None, 0
    for batch in batches:
        out = []
        for first, r, rs, cs in zip(*(batch[name].to_numpy(zero_copy_only=False).tolist() for name in ("first", "r", "rs", "cs")), strict=True):
            if first:
                free, row = [], None
            if r != row:
                row, c = r, 0
            known, end = len(free), r + rs
            while c < known and free[c] > r:
                c += 1
            out.append(c)
            after = c + cs
            for j in range(c, min(after, known)):
                if free[j] < end:
                    free[j] = end
            if after > known:
                free += [end] * (after - max(c, known))
            c = after
        yield pa.RecordBatch.from_arrays([batch["table_id"], batch["r"], batch["k"], pa.array(out, pa.int32())], ["table_id", "r", "k", "c"])


def inline_runs(html: Column) -> Column:
    """The runs of marked-up text: ARRAY of text, bold, italic, underline, strike, code, href.

    The fold counts what is open of each style and stacks the targets of links, so styles combine
    at any depth; an end tag without a start counts for nothing. A line break is a run of its own.
    """
    tokens = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?s)<[^>]*>|[^<]+|<"), F.lit(0))
    name = lambda t: F.lower(F.regexp_extract(t, r"(?s)^</?([A-Za-z][A-Za-z0-9]*)[^>]*>$", 1))
    kind = "array<struct<text:string,bold:boolean,italic:boolean,underline:boolean,strike:boolean,code:boolean,href:string>>"
    start = F.struct(*(F.lit(0).alias(s) for s in STYLES), F.array().cast("array<string>").alias("links"), F.array().cast(kind).alias("out"))

    def step(s: Column, t: Column) -> Column:
        tag, closes = name(t), F.startswith(t, F.lit("</"))
        counts = []
        for style in STYLES:
            mine = tag.isin(*(k for k, v in STYLE_TAGS.items() if v == style))
            counts.append(F.when(mine & closes, F.greatest(s[style] - 1, F.lit(0))).when(mine, s[style] + 1).otherwise(s[style]).alias(style))
        target = F.regexp_extract(t, r"""(?is)\bhref\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'>]+))""", 1)
        target = F.regexp_replace(target, r"""^["']|["']$""", "")
        links = F.when((tag == "a") & closes, F.slice(s["links"], 1, F.greatest(F.size(s["links"]) - 1, F.lit(0)))).when(tag == "a", F.concat(s["links"], F.array(target))).otherwise(s["links"])
        text = F.when(tag == "br", F.lit("\n")).when((tag == "") & ~F.rlike(t, F.lit(r"(?s)^<[!/?].*>$")), t)
        href = F.nullif(F.element_at(F.concat(F.array(F.lit("")), s["links"]), -1), F.lit(""))
        new = F.array(F.struct(text.alias("text"), *((s[k] > 0).alias(k) for k in STYLES), href.alias("href")))
        return F.struct(*counts, links.alias("links"), F.when(text.isNotNull(), F.concat(s["out"], new.cast(kind))).otherwise(s["out"]).alias("out"))

    return F.aggregate(tokens, start, step, lambda s: s["out"])

"""Rules of readers and writers over rows: styles and fonts, names, pages and their items, engines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import CJK, is_blank, normal_lines
from vellumine.operators.blocks import joined

# The longest core property, lines of a plain page, cells of a plain line, and the first object number.
PROPERTY_MAX, PAGE_LINES, FIRST_OBJECT = 255, 50, 1_000_000_001
# A fill that a typesetter leaves at a page's head: its height, least width, first page.
GHOST_LOW, GHOST_HIGH, GHOST_WIDE, GHOST_PAGE = 2, 8, 20, 2
# How far line edges of a block may spread.
RIGHT_LEFT, RIGHT_RIGHT, CENTRE = 12, 3, 8


# --- cells


def grid_span(value: Column) -> Column:
    """Columns that a cell takes: at least one, also where nothing is said."""
    return F.greatest(F.lit(1), F.coalesce(value, F.lit(1))).cast("int")


def merge_state(present: Column, value: Column) -> Column:
    """Of a vertical merge: null without one, and ``continue`` where it has no value."""
    return F.when(present, F.coalesce(value, F.lit("continue")))


def cell_blocks(text: Column) -> Column:
    """The texts of a new cell's blocks: none for an empty text."""
    return F.filter(F.array(text), lambda t: t != "")


def shown(text: Column, placeholder: Column) -> Column:
    """What a cell shows: nothing where it only holds the place of a merged one."""
    return F.when(placeholder, "").otherwise(text)


def column_count(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """key, n_cols: the farthest column that a cell reaches, from c and col_span."""
    return cells.groupBy(key).agg(F.max(F.col("c") + F.greatest(F.coalesce("col_span", F.lit(1)), F.lit(1))).alias("n_cols"))


def slots(rows: DataFrame, key: str, order: str, columns: int) -> DataFrame:
    """``rows`` with r and c: places in the order of cells, for cells without an address."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long") - 1
    return rows.withColumns({"r": F.floor(n / columns), "c": n % columns})


# --- styles and fonts


def positions(rows: DataFrame, key: str, order: str, name: str = "pos") -> DataFrame:
    """``rows`` with their place, from 0, in the list of their document."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long") - 1)


def by_position(refs: DataFrame, listed: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """``refs`` (key, pos) with the value that stands at their place; beyond the list the default."""
    found = refs.join(listed.select(key, "pos", value), [key, "pos"], "left")
    return found.withColumn(value, F.coalesce(value, F.lit(default)))


def cut_by_starts(runs: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """key, ord, text: pieces of each text of ``whole`` (key, all_text) from a start to the next, or to its end."""
    stop = F.lead("start").over(Window.partitionBy(key).orderBy("ord"))
    placed = runs.withColumn("stop", stop).join(whole, key)
    size = F.coalesce("stop", F.length("all_text")) - F.col("start")
    return placed.select(key, "ord", F.substring("all_text", F.col("start") + 1, size).alias("text"))


def starts_of(runs: DataFrame, key: str) -> DataFrame:
    """``runs`` (key, ord, text) with the place where each starts."""
    before = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("start", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("int"))


def font_of_style(hangul: Column, latin: Column) -> Column:
    """The Hangul font, else the Latin one."""
    return F.coalesce(F.concat(F.lit("hangul-"), hangul.cast("string")), F.concat(F.lit("latin-"), latin.cast("string")))


def font_of_id(fonts: DataFrame, key: str, name: str, order: str, hangul: Column) -> DataFrame:
    """key, font: the last entry for Hangul, else the first of any language."""
    return fonts.groupBy(key).agg(F.coalesce(F.max_by(name, F.when(hangul, F.col(order))), F.min_by(name, order)).alias("font"))


def run_extremes(runs: DataFrame, *keys: str) -> DataFrame:
    """keys, size (the largest), all_bold (of runs that aren't blank)."""
    return runs.groupBy(*keys).agg(F.max("size_pt").alias("size"), F.bool_and(F.when(~is_blank(F.col("text")), F.col("bold"))).alias("all_bold"))


# --- parts and their names


def streams_of(asked: DataFrame, streams: DataFrame, *keys: str) -> DataFrame:
    """keys, stream: the first stream whose name holds the number ``k``, four hexadecimal digits.

    Names are taken apart into all pieces of four characters, so containment is an equi-join.
    """
    piece = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - 3, F.lit(1))), lambda i: F.upper(F.substring("name", i, 4)))))
    return asked.join(streams.select("name", piece.alias("k")), "k").groupBy(*keys).agg(F.min("name").alias("stream"))


def image_names(images: DataFrame, key: str, image: str) -> DataFrame:
    """``images`` with name: each image of a document once, by its place among them; references share it."""
    n = F.dense_rank().over(Window.partitionBy(key).orderBy(image))
    return images.withColumn("name", F.concat(F.lit("image"), n.cast("string")))


def page_image(page: Column, number: Column) -> Column:
    return F.concat(F.lit("page"), page.cast("string"), F.lit("_img"), number.cast("string"))


def sheet_file(book: Column, sheet: Column, primary: Column) -> Column:
    """The primary sheet takes the book's name, others add their own."""
    return F.concat(book, F.when(primary, F.lit(".csv")).otherwise(F.concat(F.lit("_"), sheet, F.lit(".csv"))))


def column_number(letters: Column) -> Column:
    """The number of a sheet's column from its letters: A is 1, AA is 27."""
    digits = F.transform(F.regexp_extract_all(F.upper(letters), F.lit("[A-Z]"), F.lit(0)), lambda c: F.ascii(c) - 64)
    return F.aggregate(digits, F.lit(0), lambda n, d: n * 26 + d)


def column_letters(number: Column) -> Column:
    """The letters of a sheet's column, up to three."""
    n = number.cast("int")
    letter = lambda k: F.char(65 + k % 26)
    two, three = F.floor((n - 1) / 26).cast("int"), F.floor((n - 27) / 676).cast("int")
    return F.concat(F.when(n > 702, letter(three - 1)).otherwise(""), F.when(n > 26, letter(two - 1)).otherwise(""), letter(n - 1))


def sheet_visible(state: Column) -> Column:
    return F.coalesce(state, F.lit("visible")) == "visible"


def core_property(text: Column) -> Column:
    return F.left(text, F.lit(PROPERTY_MAX))


def object_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long")
    return rows.withColumn("object_id", n + (FIRST_OBJECT - 1))


def preview_lines(content: Column) -> Column:
    """The preview stream of a binary document, UTF-16, as lines."""
    return F.split(normal_lines(F.decode(content, "UTF-16LE")), "\n", -1)


# --- pages


def page_items(texts: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """The items of pages with their kind."""
    kinds = (("text", texts), ("table", tables), ("image", images))
    text, table, image = (d.withColumn("kind", F.lit(k)) for k, d in kinds)
    return text.unionByName(table).unionByName(image)


def page_order(items: DataFrame, *ties: Column) -> DataFrame:
    """``items`` with place: from the top of the page, then by ``ties``."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("y0", *ties)).cast("long"))


def item_rank(kind: Column) -> Column:
    """Tables before text before images of one height."""
    return F.when(kind == "table", 0).when(kind == "text", 1).otherwise(2)


def page_slice(rows: DataFrame, low: int, high: int, page: str = "page") -> DataFrame:
    return rows.where((F.col(page) >= max(0, low)) & (F.col(page) < max(low, high)))


def plain_page(place: Column, lines: int = PAGE_LINES) -> Column:
    return F.floor(place / lines).cast("int")


def scanned(pages: DataFrame, key: str) -> DataFrame:
    """key, scanned: whether no page of a document holds a character."""
    return pages.groupBy(key).agg((F.sum(F.length("text")) == 0).alias("scanned"))


def ghost_fill(page: Column, height: Column, width: Column) -> Column:
    return (page >= GHOST_PAGE) & height.between(GHOST_LOW, GHOST_HIGH) & (width > GHOST_WIDE)


def alignment(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, align: from the spread of the lines' left and right edges."""
    left, right, two = F.max("x0") - F.min("x0"), F.max("x1") - F.min("x1"), F.count("*") >= 2
    return lines.groupBy(*keys).agg(F.when(two & (left > RIGHT_LEFT) & (right < RIGHT_RIGHT), "right").when(two & (left > CENTRE) & (right > CENTRE), "center").otherwise("left").alias("align"))


def extent_pt(corners: Column) -> Column:
    """The extent of corners in hundredths of a point; no extent is unknown."""
    return F.nullif((F.array_max(corners) - F.array_min(corners)) / 100, F.lit(0.0))


def next_character(lines: DataFrame, key: str, text: str = "line") -> DataFrame:
    """``lines`` with after (the first character of the next line) and cjk (whether it is East Asian)."""
    after = F.left(F.lead(text).over(Window.partitionBy(key).orderBy("ord")), F.lit(1))
    return lines.withColumn("after", after).withColumn("cjk", F.coalesce(F.col("after").rlike(CJK), F.lit(False)))


# --- sets and reports


def first_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def capped(rows: DataFrame, limit: int, row: str = "r") -> DataFrame:
    """The rows of a sheet up to its cap."""
    return rows.where(F.col(row) < limit)


def heaviest(rows: DataFrame, key: str, item: str, weight: str, name: str = "heaviest") -> DataFrame:
    """key, name: the item of the greatest weight, the smallest item on ties."""
    return rows.groupBy(key).agg((-F.max(F.struct(weight, (-F.col(item)).alias("_k")))["_k"]).alias(name))


def usable(engine: Column, external: Column, forced: Column) -> Column:
    """Whether an engine may be used: the forced one alone; without one the built-in one always, others if they are allowed."""
    return F.coalesce(engine == forced, (engine == "native") | F.coalesce(external, F.lit(False)))


def route_text(src: Column, via: Column, dst: Column) -> Column:
    return F.concat_ws(" → ", src, via, dst)


def summary_text(name: Column, seconds: Column, error: Column) -> Column:
    done = F.concat(F.lit("완료  "), name, F.lit("  "), F.format_string("%.2f", seconds), F.lit("s"))
    return F.when(error.isNotNull(), F.concat(F.lit("실패  "), name, F.lit("  "), error)).otherwise(done)


def paragraph_text(runs: DataFrame, *keys: str) -> DataFrame:
    return runs.groupBy(*keys).agg(joined("text", "").alias("text"))

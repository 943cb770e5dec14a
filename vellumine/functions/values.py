"""Cell values: coercion of text, display of typed values, lenient numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions.text import strip

# Kinds of a cell in the older binary workbook.
XLS_ERROR = "#ERROR"


def coerce(text: Column) -> Column:
    """STRUCT(kind, l, d, b, s): empty is null; true and false; parentheses make negative; thousands commas go."""
    v = strip(text)
    low = F.lower(v)
    neg = v.rlike(r"^\(.*\)$")
    body = F.replace(F.when(neg, F.substring(v, 2, F.greatest(F.length(v) - 2, F.lit(0)))).otherwise(v), F.lit(","), F.lit(""))
    whole = body.rlike(r"^[+-]?[0-9]+$")
    number = body.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    sign = F.when(neg, -1).otherwise(1)
    big, as_double = body.try_cast("long"), body.try_cast("double")
    kind = F.when(v == "", F.lit(None)).when(low.isin("true", "false"), "bool").when(whole & big.isNotNull(), "int").when(number, "float").otherwise("text")
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "int", big * sign).alias("l"),
        F.when(kind == "float", as_double * sign).alias("d"),
        F.when(kind == "bool", low == "true").alias("b"),
        F.when(kind == "text", text).alias("s"),
    )


def show_double(value: Column) -> Column:
    """Integral values below 1e15 without a fraction; others rounded to ten decimals."""
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("long").cast("string")).otherwise(F.round(value, 10).cast("string"))


def show_bool(value: Column) -> Column:
    return F.when(value, "TRUE").when(~value, "FALSE").otherwise("")


def show_timestamp(value: Column) -> Column:
    """The date alone where the time is midnight to the second."""
    midnight = (F.hour(value) == 0) & (F.minute(value) == 0) & (F.second(value) == 0)
    return F.coalesce(F.when(midnight, F.date_format(value, "yyyy-MM-dd")).otherwise(F.date_format(value, "yyyy-MM-dd HH:mm:ss")), F.lit(""))


def to_float(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(strip(text).try_cast("double"), F.lit(default))


def to_int(text: Column, default: int = 0) -> Column:
    """Truncates a fraction."""
    return F.coalesce(strip(text).try_cast("double").cast("long"), F.lit(default).cast("long"))


def border_width_mm(text: Column) -> Column:
    """``0.4 mm`` or a bare number in millimetres, ``pt`` in points; 0.4 mm where there is none. In points."""
    number = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    points = F.when(F.lower(text).contains("pt"), number).otherwise(number / 25.4 * 72.0)
    return F.coalesce(points, F.lit(0.4 / 25.4 * 72.0))


def pick(text: Column, raw: Column) -> Column:
    """The typed value if it is a number, truth value or date; else the text, empty as null."""
    return F.when(raw["kind"].isin("int", "float", "bool", "date"), F.coalesce(raw["l"].cast("string"), raw["d"].cast("string"), raw["b"].cast("string"))).otherwise(F.nullif(text, F.lit("")))


def xls_value(kind: Column, number: Column, text: Column) -> Column:
    """A binary workbook's cell by its kind: 0 empty, 1 text, 2 number, 3 date, 4 truth value, 5 error, 6 blank.

    Dates are days from 1899-12-30; under one day they are times.
    """
    day = F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(number).cast("int")), "yyyy-MM-dd")
    seconds = F.rint((number - F.floor(number)) * 86400).cast("long")
    clock = F.format_string("%02d:%02d:%02d", (seconds / 3600).cast("long"), (seconds % 3600 / 60).cast("long"), seconds % 60)
    when = F.when(number < 1, clock).when(seconds == 0, day).otherwise(F.concat(day, F.lit(" "), clock))
    return F.when(kind == 1, text).when(kind == 2, number.cast("string")).when(kind == 3, when).when(kind == 4, F.when(number != 0, "TRUE").otherwise("FALSE")).when(kind == 5, XLS_ERROR)

"""Colours: a null colour is inherited, which differs from black."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))


def hex_to_rgb(text: Column) -> Column:
    """``#RRGGBB``, ``RRGGBB`` or ``AARRGGBB``; null for anything else."""
    bare = F.regexp_replace(F.trim(text), "^#+", "")
    six = F.when(F.length(bare) == 8, F.substring(bare, 3, 6)).otherwise(bare)
    pair = lambda at: F.conv(F.substring(six, at, 2), 16, 10)
    return F.when(bare.rlike("^([0-9A-Fa-f]{2})?[0-9A-Fa-f]{6}$"), rgb(pair(1), pair(3), pair(5)))


def rgb_to_hex(colour: Column, prefix: str = "#") -> Column:
    part = lambda c: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), colour[c])).cast("long")), 2, "0")
    return F.when(colour.isNotNull(), F.concat(F.lit(prefix), part("r"), part("g"), part("b")))


def hwp_to_rgb(value: Column) -> Column:
    """A number 0x00BBGGRR; negative is inherited."""
    n = value.cast("long")
    return F.when(n >= 0, rgb(n.bitwiseAND(255), F.shiftright(n, 8).bitwiseAND(255), F.shiftright(n, 16).bitwiseAND(255)))


def rgb_to_hwp(colour: Column) -> Column:
    part = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), colour[c])).cast("long")
    return F.when(colour.isNull(), F.lit(0).cast("long")).otherwise(part("r").bitwiseOR(F.shiftleft(part("g"), 8)).bitwiseOR(F.shiftleft(part("b"), 16)))


def black_is_inherited(colour: Column) -> Column:
    return F.when((colour["r"] != 0) | (colour["g"] != 0) | (colour["b"] != 0), colour)


def fill_colour(code: Column) -> Column:
    """A solid fill; white, black, ``auto`` and what is no colour are no fill."""
    upper = F.upper(F.regexp_replace(F.trim(code), "^#+", ""))
    six = F.when(F.length(upper) == 8, F.substring(upper, 3, 6)).otherwise(upper)
    return F.when(~six.isin("FFFFFF", "000000", "AUTO"), hex_to_rgb(code))

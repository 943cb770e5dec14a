"""Rules of styles, headers and names of parts."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions.text import strip

# Line kinds that switch an underline and a strike on; what isn't listed is off.
UNDERLINE = ("BOTTOM", "CENTER", "TOP")
STRIKE = ("SOLID", "DASH", "DOT", "DASH_DOT", "DASH_DOT_DOT", "LONG_DASH", "CIRCLE", "DOUBLE_SLIM", "SLIM_THICK", "THICK_SLIM", "SLIM_THICK_SLIM")
# Border line kinds by how they are drawn; what isn't listed is not drawn.
BORDER = {
    "solid": ("SOLID", "THICK", "3D", "3D_INSET", "THICK_3D", "THICK_3D_INSET"),
    "dashed": ("DASH", "DASHED", "DASH_DOT", "DASH_DOT_DOT", "LONG_DASH", "WAVE"),
    "dotted": ("DOT", "DOTTED", "CIRCLE"),
    "double": ("DOUBLE_SLIM", "SLIM_THICK", "THICK_SLIM", "SLIM_THICK_SLIM", "DOUBLE_WAVE"),
}
# Words in a font's name that say its weight and slope.
BOLD_NAMES, ITALIC_NAMES = "bold|black|heavy|semibold", "italic|oblique"
# First bytes of pictures; anything else counts as png.
PICTURES = {"jpeg": "FFD8", "gif": "47494638", "bmp": "424D"}


def underlined(kind: Column) -> Column:
    return F.coalesce(F.upper(kind).isin(*UNDERLINE), F.lit(False))


def struck(kind: Column) -> Column:
    return F.coalesce(F.upper(kind).isin(*STRIKE), F.lit(False))


def border_style(kind: Column) -> Column:
    known = F.create_map(*(F.lit(x) for x in chain.from_iterable((k, style) for style, kinds in BORDER.items() for k in kinds)))
    return F.coalesce(F.try_element_at(known, F.upper(kind)), F.lit("none"))


def heading_of_style(name: Column, outline: Column) -> Column:
    """From names such as ``heading 2`` or ``개요 2``, else from the outline level; 1 to 9, or 0."""
    low = F.lower(strip(F.coalesce(name, F.lit(""))))
    n = F.regexp_extract(low, r"^(?:heading|개요|제목) +([0-9]{1,4})$", 1).try_cast("int")
    clamp = lambda x: F.greatest(F.lit(1), F.least(F.lit(9), x))
    named = F.when(low.isin("title", "제목"), 1).when(low.isin("subtitle", "부제"), 2).when(n.isNotNull(), clamp(n))
    return F.coalesce(named, F.when(outline > 0, clamp(outline)), F.lit(0))


def section_index(name: Column) -> Column:
    """The number of a section part; null for other parts."""
    return F.regexp_extract(name, r"^Contents/section([0-9]{1,9})\.xml$", 1).try_cast("int")


def page_range(text: Column) -> Column:
    """``3-7``, ``3-``, ``-7`` or ``3``, counted from one, as STRUCT(lo, hi), half-open from zero; null if it is none."""
    t = strip(text)
    a, b = F.regexp_extract(t, r"^([0-9]*) *-", 1).try_cast("long"), F.regexp_extract(t, r"- *([0-9]*)$", 1).try_cast("long")
    one = t.try_cast("long")
    both = F.struct(F.greatest(F.lit(0), F.coalesce(a - 1, F.lit(0))).alias("lo"), F.coalesce(b, F.lit(1_000_000_000)).alias("hi"))
    single = F.struct((one - 1).alias("lo"), one.alias("hi"))
    return F.when(t.rlike(r"^[0-9]* *- *[0-9]*$"), both).when(t.rlike(r"^[0-9]+$"), single)


def span_style(flags: Column, font: Column, colour: Column) -> Column:
    """STRUCT(bold, italic, superscript, r): by the flag bits or the font's name; black is inherited."""
    low = F.lower(F.coalesce(font, F.lit("")))
    bit = lambda n: flags.bitwiseAND(n) != 0
    red = F.when((colour > 0), F.shiftright(colour, 16).bitwiseAND(255))
    return F.struct((bit(16) | low.rlike(BOLD_NAMES)).alias("bold"), (bit(2) | low.rlike(ITALIC_NAMES)).alias("italic"), bit(1).alias("superscript"), red.alias("r"))


def picture_kind(content: Column) -> Column:
    head, kind = F.hex(F.substring(content, 1, 8)), F.lit("png")
    for name, magic in PICTURES.items():
        kind = F.when(F.startswith(head, F.lit(magic)), name).otherwise(kind)
    return kind


def little_endian(content: Column, at: int, size: int) -> Column:
    """An unsigned number of ``size`` bytes at offset ``at``."""
    parts = (F.hex(F.substring(content, at + i, 1)) for i in range(size, 0, -1))
    return F.conv(F.concat(*parts), 16, 10).cast("long")


def hwp_header(content: Column) -> Column:
    """STRUCT(version, compressed, encrypted, distribution) of the binary format's header."""
    part = lambda at: F.conv(F.hex(F.substring(content, at + 1, 1)), 16, 10)
    flags = part(36).cast("int")
    version = F.concat_ws(".", part(35), part(34), part(33), part(32))
    return F.struct(version.alias("version"), (flags.bitwiseAND(1) != 0).alias("compressed"), (flags.bitwiseAND(2) != 0).alias("encrypted"), (flags.bitwiseAND(4) != 0).alias("distribution"))

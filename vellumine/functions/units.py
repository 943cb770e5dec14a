"""Length units as column expressions. Everything inside is in points.

A null length is 0.0 points where a format leaves lengths out (hwp, emu, twip, Excel).
Whole units round half to even.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units to a point, points and millimetres to an inch.
HWP, EMU, TWIP = 100.0, 12700.0, 20.0
INCH_PT, INCH_MM = 72.0, 25.4


def _from(value: Column, per_point: float) -> Column:
    return F.coalesce(value.cast("double") / F.lit(per_point), F.lit(0.0))


def _to(points: Column, per_point: float) -> Column:
    return F.rint(points.cast("double") * F.lit(per_point)).cast("long")


def hwp_to_pt(value: Column) -> Column:
    return _from(value, HWP)


def pt_to_hwp(points: Column) -> Column:
    return _to(points, HWP)


def emu_to_pt(value: Column) -> Column:
    return _from(value, EMU)


def pt_to_emu(points: Column) -> Column:
    return _to(points, EMU)


def twip_to_pt(value: Column) -> Column:
    return _from(value, TWIP)


def pt_to_twip(points: Column) -> Column:
    return _to(points, TWIP)


def px_to_pt(pixels: Column, dpi: float = 96.0) -> Column:
    return pixels.cast("double") * F.lit(INCH_PT) / F.lit(dpi)


def pt_to_px(points: Column, dpi: float = 96.0) -> Column:
    return points.cast("double") * F.lit(dpi) / F.lit(INCH_PT)


def mm_to_pt(mm: Column) -> Column:
    return mm.cast("double") / F.lit(INCH_MM) * F.lit(INCH_PT)


def pt_to_mm(points: Column) -> Column:
    return points.cast("double") / F.lit(INCH_PT) * F.lit(INCH_MM)


def excel_width_to_pt(width: Column) -> Column:
    """A column width in digits; a digit is seven pixels wide."""
    return F.coalesce(width.cast("double") * 7.0 * F.lit(INCH_PT) / 96.0, F.lit(0.0))


def pt_to_excel_width(points: Column) -> Column:
    """8.43, the default of a new sheet, where there is no width."""
    return F.when(points <= 0, 8.43).otherwise(points.cast("double") * 96.0 / F.lit(INCH_PT) / 7.0)


def excel_height_to_pt(height: Column) -> Column:
    return F.coalesce(height.cast("double"), F.lit(0.0))

"""Relative luminance and contrast of #rrggbb colours (WCAG 2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel(hex_color: Column, i: int) -> Column:
    """Linear value of channel i (0 red, 1 green, 2 blue)."""
    v = F.conv(F.substring(hex_color, 2 + 2 * i, 2), 16, 10).cast("double") / 255
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def luminance(hex_color: Column) -> Column:
    return 0.2126 * channel(hex_color, 0) + 0.7152 * channel(hex_color, 1) + 0.0722 * channel(hex_color, 2)


def contrast(a: Column, b: Column) -> Column:
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)

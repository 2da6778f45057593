"""Colours as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_rgba(c: Column) -> tuple[Column, Column, Column, Column]:
    """Red, green, blue and alpha as floats from 0 to 1 of #RRGGBB or #RRGGBBAA; anything else is an error."""
    valid = c.rlike("^#([0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$")

    def part(i: int) -> Column:
        value = F.conv(F.substring(c, 2 * i, 2), 16, 10).cast("float") / F.lit(255).cast("float")
        return F.when(valid, value.cast("float")).otherwise(F.raise_error(F.concat(F.lit("not a colour: "), F.coalesce(c, F.lit("null")))).cast("float"))

    alpha = F.when(F.length(c) == 9, part(4)).when(valid, F.lit(1.0).cast("float")).otherwise(part(1))
    return part(1), part(2), part(3), alpha


def css_hex(rgb: Column) -> Column:
    """A 24-bit colour as six lower-case hex digits."""
    return F.lpad(F.lower(F.hex(rgb)), 6, "0")

"""Unsigned LEB128 numbers of up to 32 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(v: Column) -> Column:
    """The bytes of a number from 0 to 2**32 - 1 as lower-case hex."""
    v = v.cast("long")
    parts = []
    for i in range(5):
        low = F.shiftright(v, 7 * i).bitwiseAND(127)
        more = F.shiftright(v, 7 * (i + 1)) > 0
        here = F.lit(True) if i == 0 else F.shiftright(v, 7 * i) > 0
        parts.append(F.when(here, F.lpad(F.lower(F.hex(low + F.when(more, 128).otherwise(0))), 2, "0")).otherwise(""))
    return F.concat(*parts)


def decode(h: Column) -> Column:
    """The number at the start of hex bytes; null if they end within it or it has more than five."""
    out = F.lit(None).cast("long")
    value, ended = F.lit(0).cast("long"), F.lit(False)
    for i in range(5):
        byte = F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("long")
        there = F.length(h) >= 2 * (i + 1)
        total = value + F.shiftleft(byte.bitwiseAND(127), 7 * i)
        stop = ~ended & there & (byte < 128)
        out = F.when(stop, total.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).otherwise(out)
        ended = ended | stop | ~there
        value = total
    return out

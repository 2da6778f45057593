"""Positions in a chunk as numbers: update index, Morton rank, 63-bit Morton code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def update_index(x: Column, y: Column, z: Column) -> Column:
    return x + 16 * y + 256 * z


def from_update_index(idx: Column) -> tuple[Column, Column, Column]:
    return idx.bitwiseAND(15), F.shiftright(idx, 4).bitwiseAND(15), F.shiftright(idx, 8)


def _or(*parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def spread(v: Column, bits: int) -> Column:
    """Bit i of v at place 3 * i."""
    return _or(*(F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1).cast("long")), 3 * i) for i in range(bits)))


def gather(v: Column, bits: int) -> Column:
    """Bit 3 * i of v at place i."""
    return _or(*(F.shiftleft(F.shiftright(v, 3 * i).bitwiseAND(F.lit(1).cast("long")), i) for i in range(bits)))


def morton(x: Column, y: Column, z: Column, bits: int = 4) -> Column:
    """x, y and z interleaved, x lowest; 4 bits give a cell's place in the stream, 21 a 63-bit code."""
    parts = (spread(c.cast("long"), bits) for c in (x, y, z))
    return _or(*(F.shiftleft(p, i) for i, p in enumerate(parts)))


def from_morton(code: Column, bits: int = 4) -> tuple[Column, Column, Column]:
    return tuple(gather(F.shiftright(code.cast("long"), i), bits) for i in range(3))


def swapped_rank(x: Column, y: Column, z: Column) -> Column:
    """For compatibility: a rank that has y and z swapped. Not the place in the stream."""
    return morton(x, z, y)


def from_swapped_rank(rank: Column) -> tuple[Column, Column, Column]:
    """x, y, z of swapped_rank()."""
    x, z, y = from_morton(rank)
    return x, y, z


def morton_bits(w: Column, d: Column, h: Column) -> Column:
    """Bits of a Morton code of a box: three times the bits of the largest side less one."""
    m = F.greatest(w, d, h) - 1
    return F.when(m > 0, 3 * F.length(F.bin(m))).otherwise(0)


def inside(x: Column, y: Column, z: Column) -> Column:
    return x.between(0, 15) & y.between(0, 15) & z.between(0, 15)


def placement(x: Column, y: Column, z: Column, nx: Column, ny: Column, nz: Column) -> tuple[Column, Column, Column]:
    """The cell next to a hit voxel along the rounded normal; halves round up."""
    return tuple((c + F.floor(n + 0.5)).cast("int") for c, n in ((x, nx), (y, ny), (z, nz)))


def ground_placement(px: Column, pz: Column) -> tuple[Column, Column, Column]:
    """The cell on the ground plane that a point lies over."""
    return F.floor(px + 0.5).cast("int"), F.lit(0), F.floor(pz + 0.5).cast("int")

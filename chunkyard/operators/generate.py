"""Procedural chunks. Whatever is random has a seed parameter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chunkyard.functions.index import from_update_index
from chunkyard.model import CELLS

USABLE = 63  # colors 1 to 63
#: Weights and factor of the corner noise, the step of an octave's seed, terrain's and contour's scales,
#: terrain's threshold and its fall with height, the weights of terrain's colors.
CORNER, FACTOR, OCTAVE = (127.1, 311.7, 74.7), 43758.5453, 13.37
TERRAIN_SCALE, CONTOUR_SCALE, THRESHOLD, FALL = (0.35, 0.55, 0.35), (0.35, 0.35, 0.35), 0.58, 0.06
TERRAIN_COLOR = (997, 17, 31, 13)


def cells(spark: SparkSession, chunks: int = 1) -> DataFrame:
    """chunk_id, idx, x, y, z of all cells of `chunks` chunks."""
    x, y, z = from_update_index(F.col("idx"))
    grid = spark.range(chunks * CELLS).select(F.floor(F.col("id") / CELLS).alias("chunk_id"), (F.col("id") % CELLS).cast("int").alias("idx"))
    return grid.select("chunk_id", "idx", x.alias("x"), y.alias("y"), z.alias("z"))


def _distance(centre: float) -> Column:
    return F.sqrt(sum(((F.col(c) - F.lit(centre)) * (F.col(c) - F.lit(centre)) for c in "xyz"), F.lit(0.0)))


def _shade(part: Column) -> Column:
    return (F.least(F.floor(part * USABLE), F.lit(USABLE - 1)) + 1).cast("int")


def rainbow(grid: DataFrame) -> DataFrame:
    """Color by the distance from the corner."""
    return grid.withColumn("color", _shade(_distance(0.0) / F.sqrt(F.lit(768.0))))


def stripes(grid: DataFrame) -> DataFrame:
    return grid.withColumn("color", (F.col("z") % USABLE + 1).cast("int"))


def sphere(grid: DataFrame) -> DataFrame:
    """Cells within 8 of the centre, by distance."""
    return grid.withColumn("r", _distance(7.5)).where("r <= 8").withColumn("color", _shade(F.col("r") / 8)).drop("r")


def _random_color(seed: int) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit("color"), "chunk_id", "idx"), F.lit(USABLE)) + 1).cast("int")


def fill(grid: DataFrame, seed: int = 0) -> DataFrame:
    return grid.withColumn("color", _random_color(seed))


def wanted(percent: float) -> int:
    return int(CELLS * min(max(percent, 0.0), 100.0) / 100 + 0.5)


def noise(spark: SparkSession, amount: int, low: float, high: float | None = None, seed: int = 0) -> DataFrame:
    """`amount` chunks (none if negative), each with exactly the share of random cells that its own percentage, from
    low to high (swapped if reversed), calls for."""
    low, high = sorted((low, low if high is None else high))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit("share"), "chunk_id"), F.lit(1_000_001)) / 1_000_000
    share = F.least(F.greatest(F.lit(low) + draw * (high - low), F.lit(0.0)), F.lit(100.0))
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.xxhash64(F.lit(seed), "chunk_id", "idx"), "idx"))
    dealt = cells(spark, max(0, amount)).withColumn("want", F.floor(F.lit(CELLS) * share / 100 + 0.5)).withColumn("rank", rank)
    return dealt.where("rank <= want").withColumn("color", _random_color(seed)).drop("rank", "want")


def _value_noise(at: np.ndarray, seed: float) -> np.ndarray:
    """Values at the corners of the unit cells that the points (rows) lie in, blended smoothly."""
    base = np.floor(at)
    t = at - base
    smooth = t * t * (3 - 2 * t)
    out = np.zeros(len(at))
    for corner in np.ndindex(2, 2, 2):
        h = np.sin((base + corner) @ np.array(CORNER) + seed) * FACTOR
        out += (h - np.floor(h)) * np.where(corner, smooth, 1 - smooth).prod(axis=1)
    return out


def with_noise(grid: DataFrame, scale: tuple[float, float, float], seed: float, octaves: int) -> DataFrame:
    """grid with n: octaves of value noise, each twice as fine and half as strong. As column expressions the
    corners' sines outgrow the JVM's method size, so it is computed on Arrow batches."""
    where = [grid.columns.index(c) for c in "xyz"]

    def run(batches):
        for b in batches:
            at = np.stack([b.column(i).to_numpy() for i in where], 1) * np.array(scale)
            n = sum(_value_noise(at * 2**i, seed + OCTAVE * i) * 0.5 ** (i + 1) for i in range(octaves))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], names=[*b.schema.names, "n"])

    return grid.mapInArrow(run, T.StructType([*grid.schema, T.StructField("n", T.DoubleType())]))


def terrain(grid: DataFrame, seed: float = 0.0) -> DataFrame:
    """Noise above a threshold that falls with height."""
    n, x, y, z = TERRAIN_COLOR
    color = F.pmod(F.floor(F.col("n") * n + F.col("x") * x + F.col("y") * y + F.col("z") * z), F.lit(USABLE)) + 1
    made = with_noise(grid, TERRAIN_SCALE, seed, 3)
    return made.where(F.col("n") > THRESHOLD - F.col("y") * FALL).withColumn("color", color.cast("int")).drop("n")


def contour(grid: DataFrame, seed: float = 0.0) -> DataFrame:
    """A border two cells wide, one from the edge, on the two lowest layers."""
    edge = F.least(F.col("x"), 15 - F.col("x"), F.col("z"), 15 - F.col("z"))
    made = with_noise(grid.where((F.col("y") < 2) & edge.between(1, 2)), CONTOUR_SCALE, seed, 2)
    return made.withColumn("color", (F.pmod(F.floor(F.col("n") * USABLE), F.lit(USABLE)) + 1).cast("int")).drop("n")

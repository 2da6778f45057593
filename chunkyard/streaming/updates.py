"""Voxels from a stream of writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkyard.model import CELLS


def live_cells(log: DataFrame, order: Column) -> DataFrame:
    """The last color written to each cell of a streaming log (chunk_id, idx, color); for update or complete mode.
    State holds a row a cell, however many writes there are; 0 is an erased cell. Writes without a color are dropped."""
    good = log.where(F.col("idx").between(0, CELLS - 1) & F.col("color").isNotNull())
    return good.groupBy("chunk_id", "idx").agg(F.max_by(F.greatest(F.least("color", F.lit(255)), F.lit(0)), order).alias("color"))


def write_rates(log: DataFrame, time: str, window: str = "10 minutes", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Writes and erasures a chunk and time window; rows later than the watermark are dropped."""
    slot = F.window(time, window, slide) if slide else F.window(time, window)
    counted = log.withWatermark(time, late).groupBy(slot.alias("w"), "chunk_id")
    out = counted.agg(F.count("*").alias("writes"), F.count_if(F.col("color") == 0).alias("erased"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "chunk_id", "writes", "erased")

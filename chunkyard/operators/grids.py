"""Voxel tables: updates, differences, overlays, counts, faces, runs.

A voxel table has chunk_id, idx, x, y, z, color with color <> 0 and one row a cell. All of it is keyed by
chunk_id first, so a table partitioned by chunk_id goes through without another exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkyard.functions.index import from_update_index, morton
from chunkyard.model import CELLS

#: Direction number -> (axis, step): +x, -x, +y, -y, +z, -z.
DIRECTIONS = (("x", 1), ("x", -1), ("y", 1), ("y", -1), ("z", 1), ("z", -1))


def with_position(cells: DataFrame) -> DataFrame:
    x, y, z = from_update_index(F.col("idx"))
    return cells.select("chunk_id", "idx", x.alias("x"), y.alias("y"), z.alias("z"), "color")


def apply_log(log: DataFrame, order: Column, base: DataFrame | None = None) -> DataFrame:
    """Last write wins over (chunk_id, idx, color); color 0 erases, idx beyond the chunk is dropped, and so are writes
    with a null idx or color; color is held to 0..255. base: voxels that count as written before. One exchange, after partial sums."""
    writes = log.where(F.col("idx").between(0, CELLS - 1) & F.col("color").isNotNull()).select("chunk_id", "idx", F.greatest(F.least("color", F.lit(255)), F.lit(0)).alias("color"), F.struct(F.lit(1).alias("late"), order.alias("o")).alias("at"))
    last = writes.groupBy("chunk_id", "idx").agg(F.max_by("color", "at").alias("color"))
    if base is not None:
        old = base.select("chunk_id", "idx", F.lit(0).alias("late"), "color")
        both = last.select("chunk_id", "idx", F.lit(1).alias("late"), "color").unionByName(old)
        last = both.groupBy("chunk_id", "idx").agg(F.max_by("color", "late").alias("color"))
    return with_position(last.where("color <> 0"))


def erased(log: DataFrame, order: Column) -> DataFrame:
    """Cells whose last write is 0; writes without a color don't count."""
    return log.where("color is not null").groupBy("chunk_id", "idx").agg(F.max_by("color", order).alias("color")).where("color = 0").select("chunk_id", "idx")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(chunk_id, idx, color) of after's voxels that are new or changed; removals aren't told."""
    old = before.select("chunk_id", "idx", F.col("color").alias("old"))
    return after.join(old, ["chunk_id", "idx"], "left").where(F.col("old").isNull() | (F.col("old") != F.col("color"))).select("chunk_id", "idx", "color")


def overlay(under: DataFrame, over: DataFrame) -> DataFrame:
    """over's voxels on top of under's."""
    both = under.select("chunk_id", "idx", F.lit(0).alias("layer"), "color").unionByName(over.select("chunk_id", "idx", F.lit(1).alias("layer"), "color"))
    return with_position(both.groupBy("chunk_id", "idx").agg(F.max_by("color", "layer").alias("color")))


def densify(voxels: DataFrame) -> DataFrame:
    """All 4,096 cells of each chunk that has a voxel, empty ones with color 0, with their rank."""
    cells = voxels.select("chunk_id").distinct().select("chunk_id", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("idx"))
    x, y, z = from_update_index(F.col("idx"))
    full = cells.join(voxels.select("chunk_id", "idx", "color"), ["chunk_id", "idx"], "left")
    return full.select("chunk_id", "idx", morton(x, y, z).cast("int").alias("rank"), F.coalesce("color", F.lit(0)).alias("color"))


def in_stream_order(voxels: DataFrame) -> DataFrame:
    """voxels with their rank, in chunks and ranks ascending: ranges of chunks, each sorted by itself."""
    ranked = voxels.withColumn("rank", morton(F.col("x"), F.col("y"), F.col("z")).cast("int"))
    return ranked.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id", "rank")


def cleared(voxels: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """voxels without the chunks named in chunks (chunk_id); None: without any."""
    return voxels.where("false") if chunks is None else voxels.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti").select(voxels.columns)


def clearing(voxels: DataFrame) -> DataFrame:
    """The writes that erase every voxel, as a log for apply_log()."""
    return voxels.select("chunk_id", "idx", F.lit(0).alias("color"))


def colors_at(voxels: DataFrame, points: DataFrame) -> DataFrame:
    """points (chunk_id, x, y, z and more) with the color there; 0 where it is empty or beyond the chunk."""
    cells = voxels.select("chunk_id", "x", "y", "z", F.col("color").alias("found"))
    return points.join(cells, ["chunk_id", "x", "y", "z"], "left").withColumn("color", F.coalesce("found", F.lit(0))).drop("found")


def set_voxel(voxels: DataFrame, chunk_id: int, x: int, y: int, z: int, color: int) -> DataFrame:
    """voxels after one edit; color 0 removes, places beyond the chunk are ignored."""
    if not all(0 <= c < 16 for c in (x, y, z)):
        return voxels
    edit = voxels.sparkSession.createDataFrame([(chunk_id, x + 16 * y + 256 * z, color)], "chunk_id long, idx int, color int")
    return apply_log(edit, F.lit(0), voxels)


def exposed(voxels: DataFrame) -> DataFrame:
    """chunk_id, idx, x, y, z, color, dir: the faces of voxels whose neighbour cell is empty or beyond the chunk.

    Neighbours come from windows along the three axes; one exchange by chunk_id serves all of them.
    """
    out = voxels.repartition("chunk_id")
    hidden = []
    for d, (axis, step) in enumerate(DIRECTIONS):
        line = Window.partitionBy("chunk_id", *(a for a in "xyz" if a != axis)).orderBy(axis)
        beside = F.lead(axis).over(line) if step > 0 else F.lag(axis).over(line)
        out = out.withColumn(f"n{d}", beside)
        hidden.append(F.when(F.coalesce(F.col(f"n{d}") == F.col(axis) + step, F.lit(False)), -1).otherwise(d))
    faces = out.withColumn("dir", F.explode(F.array(*hidden))).where("dir >= 0")
    return faces.select("chunk_id", "idx", "x", "y", "z", "color", "dir")


def runs(voxels: DataFrame) -> DataFrame:
    """chunk_id, y, z, x0, length, color: maximal runs of one colour along x."""
    line = Window.partitionBy("chunk_id", "y", "z", "color").orderBy("x")
    island = voxels.withColumn("island", F.col("x") - F.row_number().over(line))
    return island.groupBy("chunk_id", "y", "z", "color", "island").agg(F.min("x").alias("x0"), F.count("*").alias("length")).drop("island")


def raw_sizes(voxels: DataFrame, bpp: int = 6) -> DataFrame:
    """chunk_id, n and the three raw payload sizes, with the encoding of the smallest (ties: dense, sparse, bitmap)."""
    n = F.col("n")
    sized = voxels.groupBy("chunk_id").agg(F.count("*").alias("n")).select(
        "chunk_id", "n",
        F.lit((CELLS * bpp + 7) // 8).cast("long").alias("dense"),
        F.floor((16 + n * (12 + bpp) + 7) / 8).alias("sparse"),
        (512 + F.floor((n * bpp + 7) / 8)).alias("bitmap"),
    )
    choice = F.when((F.col("dense") <= F.col("sparse")) & (F.col("dense") <= F.col("bitmap")), 0).when(F.col("sparse") <= F.col("bitmap"), 1).otherwise(3)
    return sized.withColumn("enc", choice)


def pack_positions(entries: DataFrame, pack: str = "pack", name: str = "name", width: int = 16, depth: int = 16) -> DataFrame:
    """pack, name, ord, x, z: each pack's entries on a square grid in name order, column first. Packs are numbered apart."""
    own = Window.partitionBy(pack)
    numbered = entries.select(pack, name, (F.row_number().over(own.orderBy(name)) - 1).alias("ord"), F.ceil(F.sqrt(F.count("*").over(own))).alias("cols"))
    return numbered.select(pack, name, "ord", (F.col("ord") % F.col("cols") * width).cast("int").alias("x"), (F.floor(F.col("ord") / F.col("cols")) * depth).cast("int").alias("z"))

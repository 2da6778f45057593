"""Sizes, formats, palette and schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 16
CELLS = SIDE**3
#: Fixed values of the file formats.
CHUNK_MAGIC, PACK_MAGIC, VERSION = b"VOPL", b"VOPLPACK", 3
DENSE, SPARSE, BITMAP, ZLIB_FLAG = 0, 1, 3, 0x80
BPP, COLORS = 6, 64
#: The palette, #RRGGBB by index; index 0 is empty.
PALETTE = (
    "#00000000 #000000 #3C3C3C #787878 #D2D2D2 #FFFFFF #600018 #ED1C24 #FF7F27 #F6AA09 #F9DD3B #FFFABC #0EB968 #13E67B #87FF5E #0C816E "
    "#10AEA6 #13E1BE #28509E #4093E4 #60F7F2 #6B50F6 #99B1FB #780C99 #AA38B9 #E09FF9 #CB007A #EC1F80 #F38DA9 #684634 #95682A #F8B277 "
    "#AAAAAA #A50E1E #FA8072 #E45C1A #D6B594 #9C8431 #C5AD31 #E8D45F #4A6B3A #5A944A #84C573 #0F799F #BBFAF2 #7DC7FF #4D31B8 #4A4284 "
    "#7A71C4 #B5AEF1 #DBA463 #D18051 #FFC5A5 #9B5249 #D18078 #FAB6A4 #7B6352 #9C846B #333941 #6D758D #B3B9D1 #6D643F #948C6B #CDC59E"
).split()

VOXELS = "chunk_id long, idx int, x int, y int, z int, color int"
FILES = "name string, content binary"
HEADER = "magic string, ver int, enc int, bpp int, w int, h int, d int, pal int, plen long"
QUADS = "chunk_id long, quad int, dir int, slice int, u int, v int, w int, h int, color int"


def palette(spark: SparkSession) -> DataFrame:
    """color, hex, r, g, b, a: 64 rows, parts from 0 to 1."""
    from chunkyard.functions.colors import hex_rgba

    rows = spark.createDataFrame(list(enumerate(PALETTE)), "color int, hex string")
    return rows.select("color", "hex", *(c.alias(n) for n, c in zip("rgba", hex_rgba(F.col("hex")), strict=True)))

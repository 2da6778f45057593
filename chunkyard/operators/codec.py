"""Chunk payloads and files, vectorised over the cells of a chunk.

The bit work runs in numpy on Arrow batches: a bit-packed stream has no column form, and lambdas over 4,096
cells in the JVM were slower by an order of magnitude.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkyard.model import BITMAP, BPP, CELLS, CHUNK_MAGIC, COLORS, DENSE, SIDE, SPARSE, VERSION, VOXELS, ZLIB_FLAG

_IDX = np.arange(CELLS)


def _spread(v: np.ndarray) -> np.ndarray:
    return sum(((v >> i) & 1) << (3 * i) for i in range(4))


#: Update index -> rank, and back.
RANK = _spread(_IDX & 15) | _spread(_IDX >> 4 & 15) << 1 | _spread(_IDX >> 8) << 2
INDEX = np.argsort(RANK)


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Values of `width` bits, lowest bit first, filled with zeros to whole bytes; higher bits are cut off."""
    if not width or not len(values):
        return b""
    bits = (values.astype(np.int64)[:, None] >> np.arange(width)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes, count: int, width: int) -> np.ndarray:
    """`count` values; too few bits are an error."""
    if not width or not count:
        return np.zeros(count, np.int64)
    if len(data) * 8 < count * width:
        raise ValueError("payload is too short")
    bits = np.unpackbits(np.frombuffer(data, np.uint8, (count * width + 7) // 8), count=count * width, bitorder="little")
    return bits.reshape(count, width).astype(np.int64) @ (1 << np.arange(width))


def encode_raw(stream: np.ndarray, enc: int, bpp: int = BPP) -> bytes:
    """A payload of the 4,096 colours in rank order."""
    at = np.flatnonzero(stream)
    if enc == DENSE:
        return pack_bits(stream, bpp)
    if enc == SPARSE:
        cut = stream[at] & ((1 << bpp) - 1)
        return struct.pack("<H", len(at)) + pack_bits(at | cut << 12, 12 + bpp)
    if enc == BITMAP:
        return pack_bits(stream != 0, 1) + pack_bits(stream[at], bpp)
    raise ValueError(f"unknown encoding {enc}")


def decode_raw(payload: bytes, enc: int, bpp: int = BPP) -> np.ndarray:
    """The colours in rank order; repeated ranks: the last counts."""
    if enc & ZLIB_FLAG:
        payload, enc = zlib.decompress(payload), enc & ~ZLIB_FLAG
    if enc == DENSE:
        return unpack_bits(payload, CELLS, bpp)
    out = np.zeros(CELLS, np.int64)
    if enc == SPARSE:
        if len(payload) < 2:
            raise ValueError("payload is too short")
        pairs = unpack_bits(payload[2:], struct.unpack_from("<H", payload)[0], 12 + bpp)
        ranks, last = np.unique((pairs & 0xFFF)[::-1], return_index=True)
        out[ranks] = (pairs >> 12)[::-1][last]
        return out
    if enc == BITMAP:
        if len(payload) < CELLS // 8:
            raise ValueError("payload is too short")
        at = np.flatnonzero(unpack_bits(payload, CELLS, 1))
        out[at] = unpack_bits(payload[CELLS // 8 :], len(at), bpp)
        return out
    raise ValueError(f"unknown encoding {enc}")


def best(stream: np.ndarray, bpp: int = BPP, deflate: bool = True) -> tuple[int, bytes]:
    """The smallest payload; of equal ones the first of dense, sparse, bitmap, then each deflated."""
    raw = [(e, encode_raw(stream, e, bpp)) for e in (DENSE, SPARSE, BITMAP)]
    packed = [(e | ZLIB_FLAG, zlib.compress(p, 9)) for e, p in raw] if deflate else []
    return min(raw + packed, key=lambda x: len(x[1]))


def build_file(enc: int, payload: bytes, bpp: int = BPP, dims: tuple[int, int, int] = (SIDE, SIDE, SIDE), pal: int = COLORS, ver: int = VERSION) -> bytes:
    return CHUNK_MAGIC + struct.pack("<BBBBBBHI", ver, enc, bpp, *dims, pal, len(payload)) + payload


def parse_header(data: bytes) -> tuple:
    """ver, enc, bpp, w, h, d, pal, plen of a whole file; its length must be as the header says."""
    if len(data) < 16 or data[:4] != CHUNK_MAGIC:
        raise ValueError("not a chunk file")
    head = struct.unpack_from("<BBBBBBHI", data, 4)
    if head[0] != VERSION:
        raise ValueError(f"unsupported version {head[0]}")
    if len(data) - 16 != head[-1]:
        raise ValueError("payload length differs from the header's")
    return head


def load_file(data: bytes, strict: bool = True) -> np.ndarray:
    """The colours in rank order. Not strict: bytes after the payload are ignored, and a header cut short after
    the version counts as filled with zeros."""
    if strict:
        _, enc, bpp, *_ = parse_header(data)
        return decode_raw(data[16:], enc, bpp)
    if data[:4] != CHUNK_MAGIC or len(data) < 5 or data[4] != VERSION:
        raise ValueError("not a chunk file of a supported version")
    _, enc, bpp, *_, plen = struct.unpack_from("<BBBBBBHI", data[:16].ljust(16, b"\0"), 4)
    if len(data) < 16 + plen and plen:
        raise ValueError("payload is too short")
    return decode_raw(data[16 : 16 + plen], enc, bpp)


def save_stream(stream: np.ndarray, bpp: int = BPP, deflate: bool = True) -> bytes:
    bpp = min(max(bpp, 1), 8)
    enc, payload = best(stream, bpp, deflate)
    return build_file(enc, payload, bpp)


def cells_of(voxels: DataFrame) -> DataFrame:
    """chunk_id and the lists of its voxels' idx and color: one exchange; a chunk has at most 4,096.

    The number of partitions is given, since what follows costs far more than its bytes would tell
    the adaptive planner, which would merge them."""
    n = int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return voxels.repartition(n, "chunk_id").groupBy("chunk_id").agg(F.collect_list(F.struct("idx", "color")).alias("cells"))


def streams(batch: pa.RecordBatch):
    """(chunk_id, colours in rank order) of a batch of cells_of()."""
    lists = batch.column("cells")
    idx, color = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    ends = lists.offsets.to_numpy()
    for i, chunk in enumerate(batch.column("chunk_id").to_pylist()):
        part = slice(ends[i], ends[i + 1])
        out = np.zeros(CELLS, np.int64)
        out[RANK[idx[part]]] = color[part]
        yield chunk, out


def encode_chunks(voxels: DataFrame, enc: int | None = None, bpp: int = BPP, deflate: bool = True) -> DataFrame:
    """chunk_id, enc, payload, content (the whole file) of each chunk; enc None: the smallest."""

    def run(batches):
        for b in batches:
            rows = []
            for chunk, s in streams(b):
                e, p = best(s, bpp, deflate) if enc is None else (enc, zlib.compress(encode_raw(s, enc & 127, bpp), 9) if enc & ZLIB_FLAG else encode_raw(s, enc, bpp))
                rows.append((chunk, e, p, build_file(e, p, bpp)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["chunk_id", "enc", "payload", "content"])

    cells = cells_of(voxels).select(F.col("chunk_id").cast("long").alias("chunk_id"), "cells")
    return cells.mapInArrow(run, "chunk_id long, enc int, payload binary, content binary")


def decode_files(files: DataFrame, strict: bool = True) -> DataFrame:
    """Voxels of files given as (chunk_id, content)."""

    def run(batches):
        for b in batches:
            for chunk, data in zip(b.column(0), b.column(1), strict=True):
                stream = load_file(data.as_py() or b"", strict)
                idx = np.flatnonzero(stream[RANK])
                color = stream[RANK][idx]
                cols = [np.full(len(idx), chunk.as_py()), idx, idx & 15, idx >> 4 & 15, idx >> 8, color]
                kinds = [pa.int64(), *[pa.int32()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["chunk_id", "idx", "x", "y", "z", "color"])

    return files.select(F.col("chunk_id").cast("long").alias("chunk_id"), "content").mapInArrow(run, VOXELS)


def dense_grids(files: DataFrame, strict: bool = True) -> DataFrame:
    """chunk_id and grid of files given as (chunk_id, content): 4,096 colors at z + 16 * x + 256 * y."""
    at = np.arange(CELLS)
    order = RANK[(at >> 4 & 15) | (at >> 8) << 4 | (at & 15) << 8]  # of x, y, z as update index

    def run(batches):
        for b in batches:
            rows = [load_file(c.as_py() or b"", strict)[order] for c in b.column(1)]
            ends = np.arange(len(rows) + 1, dtype=np.int32) * CELLS
            flat = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int16)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["chunk_id", "grid"])

    return files.select(F.col("chunk_id").cast("long").alias("chunk_id"), "content").mapInArrow(run, "chunk_id long, grid array<smallint>")


def canonical_files(files: DataFrame) -> DataFrame:
    """The files' `content` read leniently and written again at 6 bits a colour; other columns stay."""
    at = files.columns.index("content")

    def run(batches):
        for b in batches:
            made = pa.array([save_stream(load_file(c.as_py() or b"", strict=False)) for c in b.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([made if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return files.mapInArrow(run, files.schema)


def header_columns(content) -> dict:
    """The header's fields of a file column, in the JVM; only the first bytes are looked at."""

    def number(at: int, size: int):
        byte = lambda k: F.conv(F.hex(F.substring(content, at + k + 1, 1)), 16, 10).cast("long")
        return sum((byte(k) * (1 << 8 * k) for k in range(1, size)), byte(0))

    out = {"magic": F.decode(F.substring(content, 1, 4), "ISO-8859-1")}
    out |= {n: number(4 + i, 1).cast("int") for i, n in enumerate(("ver", "enc", "bpp", "w", "h", "d"))}
    return out | {"pal": number(10, 2).cast("int"), "plen": number(12, 4)}


def headers(files: DataFrame, key: str = "name") -> DataFrame:
    return files.select(key, *(c.alias(n) for n, c in header_columns(F.col("content")).items()), F.octet_length("content").cast("long").alias("bytes"))


def check_homogeneous(files: DataFrame, key: str = "name") -> DataFrame:
    """The one (bpp, w, h, d, pal) of all files; others make it an error."""
    one = headers(files, key).select("bpp", "w", "h", "d", "pal").distinct()
    return one.withColumn("ok", F.expr("assert_true(count(*) over () = 1, 'headers differ')")).drop("ok")

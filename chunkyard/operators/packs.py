"""Containers of many chunks: raw and content-defined layouts, three codecs."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkyard.model import PACK_MAGIC, VERSION
from chunkyard.operators.codec import build_file, parse_header

NONE, ZLIB, ZSTD = 0, 1, 2
RAW, CDC = 0, 1
#: Fixed values of the content-defined layout: target, least and greatest block, the table's seed text and steps.
TARGET, LEAST, MOST = 4096, 2048, 16384
GEAR_SEED, STEP_A, STEP_B = b"vopl-cdc-gear-seed", 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F
WORD = (1 << 64) - 1


def gear_table() -> np.ndarray:
    """256 numbers from XXH64 with seed 0; zero is replaced by the first step."""
    seed = xxhash.xxh64_intdigest(GEAR_SEED)
    parts = (struct.pack("<QQ", (seed + i * STEP_A) & WORD, ~(seed + i * STEP_B) & WORD) for i in range(256))
    return np.array([xxhash.xxh64_intdigest(p) or STEP_A for p in parts], np.uint64)


_GEAR = gear_table()


def cut_points(data: bytes) -> list[int]:
    """Ends of the blocks. The hash shifts by one a byte and its lowest bits decide, so only the last bytes
    count (12 for a target of 4,096): candidates come from shifted sums, then a walk keeps the sizes."""
    bits = round(math.log2(TARGET))
    low = (_GEAR[np.frombuffer(data, np.uint8)] & np.uint64((1 << bits) - 1)).astype(np.int64)
    total = np.zeros(len(low), np.int64)
    for k in range(bits):
        total[k:] += low[: max(0, len(low) - k)] << k
    hits = np.flatnonzero(total & ((1 << bits) - 1) == 0) + 1
    ends, start = [], 0
    while start < len(data):
        k = np.searchsorted(hits, start + LEAST)
        end = min(int(hits[k]) if k < len(hits) else len(data), start + MOST, len(data))
        ends.append(end)
        start = end
    return ends


def blocks_and_refs(payloads: list[bytes]) -> tuple[list[bytes], list[list[int]]]:
    """Distinct blocks in order of first use, and each payload's block numbers."""
    number: dict[bytes, int] = {}
    refs = []
    for p in payloads:
        ends = cut_points(p)
        refs.append([number.setdefault(p[a:b], len(number)) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if p else [])
    return list(number), refs


def _zstd():
    try:
        import zstandard
    except ImportError as e:  # optional on a cluster
        raise RuntimeError("zstd packs need the zstandard package") from e
    return zstandard


def write_pack(head: tuple[int, int, int, int, int], entries: list[tuple[str, int, bytes]], layout: int = RAW, codec: int = ZLIB) -> bytes:
    """head: bpp, w, h, d, pal; entries: name, enc, payload, in order."""
    version = 1 if layout == RAW and codec in (NONE, ZLIB) else 2
    out = [struct.pack("<BBBBBH", VERSION, *head)]
    if version > 1:
        out.append(bytes([layout]))

    def named(name: str, enc: int) -> bytes:
        raw = name.encode()
        if len(raw) > 0xFFFF:
            raise ValueError("an entry's name is too long")
        return struct.pack("<H", len(raw)) + raw + bytes([enc])

    if layout == RAW:
        out.append(struct.pack("<I", len(entries)))
        out += [named(n, e) + struct.pack("<I", len(p)) + p for n, e, p in entries]
    elif layout == CDC:
        blocks, refs = blocks_and_refs([p for *_, p in entries])
        out.append(struct.pack("<IIII", TARGET, LEAST, MOST, len(blocks)))
        out += [struct.pack("<I", len(b)) + b for b in blocks]
        out.append(struct.pack("<I", len(entries)))
        out += [named(n, e) + struct.pack(f"<II{len(r)}I", len(p), len(r), *r) for (n, e, p), r in zip(entries, refs, strict=True)]
    else:
        raise ValueError(f"unknown layout {layout}")
    body = b"".join(out)
    if codec == ZLIB:
        body = zlib.compress(body, 9)
    elif codec == ZSTD:
        body = _zstd().ZstdCompressor().compress(body)
    elif codec != NONE:
        raise ValueError(f"unknown codec {codec}")
    return PACK_MAGIC + bytes([version, codec]) + body


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the pack ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def skip(self, n: int) -> None:
        if self.at + n > len(self.data):
            raise ValueError("the pack ends too early")
        self.at += n

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "little")

    def numbers(self, n: int) -> list[int]:
        return list(struct.unpack(f"<{n}I", self.take(4 * n)))


def _open(data: bytes) -> tuple[tuple[int, int, int, int, int], int, _Reader]:
    """The common header, the layout, and a reader of what follows."""
    if len(data) < 10 or data[:8] != PACK_MAGIC:
        raise ValueError("not a pack")
    version, codec, body = data[8], data[9], data[10:]
    if version == 0:
        raise ValueError("unsupported pack version 0")
    if codec == ZLIB:
        body = zlib.decompress(body)
    elif codec == ZSTD:
        body = _zstd().ZstdDecompressor().decompressobj().decompress(body)
    elif codec != NONE:
        raise ValueError(f"unknown codec {codec}")
    r = _Reader(body)
    _, *head = struct.unpack("<BBBBBH", r.take(7))
    return tuple(head), r.number(1) if version > 1 else RAW, r


def read_pack(data: bytes, names: set[str] | None = None) -> tuple[tuple[int, int, int, int, int], list[tuple[str, int, bytes]]]:
    """The common header and the entries. names: payloads of others are passed over, and come as empty. Counts are never
    trusted beyond the bytes that are there."""
    head, layout, r = _open(data)
    wanted = lambda name: names is None or base_name(name) in names
    entries = []
    if layout == RAW:
        for _ in range(r.number(4)):
            name, enc = r.take(r.number(2)).decode("utf-8", "replace"), r.number(1)
            size = r.number(4)
            if wanted(name):
                entries.append((name, enc, r.take(size)))
            else:
                r.skip(size)
                entries.append((name, enc, b""))
    elif layout == CDC:
        _, _, most = r.numbers(3)
        blocks = [r.take(r.number(4)) for _ in range(r.number(4))]
        for _ in range(r.number(4)):
            name, enc, size = r.take(r.number(2)).decode("utf-8", "replace"), r.number(1), r.number(4)
            refs = r.numbers(r.number(4))
            if any(k >= len(blocks) for k in refs):
                raise ValueError("a block number beyond the dictionary")
            payload = b"".join(blocks[k] for k in refs) if wanted(name) else b""
            if len(payload) > size + most:
                raise ValueError("an entry's blocks are longer than it")
            entries.append((name, enc, payload[:size]))
    else:
        raise ValueError(f"unknown layout {layout}")
    return head, entries


def read_directory(data: bytes) -> list[tuple[str, int, int]]:
    """Name, encoding and payload bytes of each entry; payloads and blocks are passed over."""
    _, layout, r = _open(data)
    out = []
    if layout == CDC:
        r.numbers(3)
        for _ in range(r.number(4)):
            r.skip(r.number(4))
    elif layout != RAW:
        raise ValueError(f"unknown layout {layout}")
    for _ in range(r.number(4)):
        name, enc, size = r.take(r.number(2)).decode("utf-8", "replace"), r.number(1), r.number(4)
        r.skip(4 * r.number(4) if layout == CDC else size)
        out.append((name, enc, size))
    return out


def base_name(name: str) -> str:
    return name.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1]


def make_packs(files: DataFrame, layout: int = RAW, codec: int = ZLIB) -> DataFrame:
    """(pack, content) of files given as (pack, ord, name, content): a pack's files in their order, payloads
    as they are, names without folders. Files of one pack with other headers are an error. A pack is one
    binary value, so its files meet in one task."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("ord", "name", "content")), strict=True), key=lambda r: r[:2])
        heads = [parse_header(c) for *_, c in rows]
        if len({h[2:7] for h in heads}) > 1:
            raise ValueError("a pack's files must have the same header")
        body = write_pack(heads[0][2:7], [(base_name(n), h[1], c[16:]) for (_, n, c), h in zip(rows, heads, strict=True)], layout, codec)
        return pa.table({"pack": pa.array([t.column("pack")[0].as_py()], pa.string()), "content": pa.array([body], pa.binary())})

    return files.select(F.col("pack").cast("string").alias("pack"), F.col("ord").cast("long").alias("ord"), "name", "content").groupBy("pack").applyInArrow(run, "pack string, content binary")


def canonical_packs(files: DataFrame) -> DataFrame:
    """(pack, content) of files given as (pack, name, content), each written again at 6 bits a colour, in the
    order of their names."""
    from chunkyard.operators.codec import canonical_files

    return make_packs(canonical_files(files.select("pack", F.lit(0).alias("ord"), "name", "content")))


def read_packs(packs: DataFrame) -> DataFrame:
    """pack, ord, name, enc, payload, content (the entry as a file) of every entry of packs given as (pack, content)."""

    def run(batches):
        for b in batches:
            for pack, data in zip(b.column(0), b.column(1), strict=True):
                (bpp, w, h, d, pal), entries = read_pack(data.as_py())
                rows = [(pack.as_py(), i, n, e, p, build_file(e, p, bpp, (w, h, d), pal)) for i, (n, e, p) in enumerate(entries)]
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["pack", "ord", "name", "enc", "payload", "content"])

    return packs.select(F.col("pack").cast("string").alias("pack"), "content").mapInArrow(run, "pack string, ord int, name string, enc int, payload binary, content binary")


def directory(packs: DataFrame) -> DataFrame:
    """pack, ord, name, enc, bytes of every entry of packs given as (pack, content); no payload leaves the task."""

    def run(batches):
        for b in batches:
            for pack, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [(pack, i, base_name(n), e, size) for i, (n, e, size) in enumerate(read_directory(data.as_py()))]
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["pack", "ord", "name", "enc", "bytes"])

    return packs.select(F.col("pack").cast("string").alias("pack"), "content").mapInArrow(run, "pack string, ord int, name string, enc int, bytes long")


def entries_by_name(packs: DataFrame, wanted: DataFrame) -> DataFrame:
    """pack, name, content of the entries named in wanted (pack, name); of several with one name in a pack, the last.
    Payloads of others are passed over."""
    names = wanted.groupBy(F.col("pack").cast("string").alias("pack")).agg(F.collect_set("name").alias("names"))

    def run(batches):
        for b in batches:
            for pack, data, names in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                (bpp, w, h, d, pal), entries = read_pack(data.as_py(), set(names))
                last = {base_name(n): (e, p) for n, e, p in entries if base_name(n) in names}
                rows = [(pack, n, build_file(e, p, bpp, (w, h, d), pal)) for n, (e, p) in last.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary()))], names=["pack", "name", "content"])

    found = packs.select(F.col("pack").cast("string").alias("pack"), "content").join(names, "pack")
    return found.mapInArrow(run, "pack string, name string, content binary")


def listing(packs: DataFrame) -> DataFrame:
    """Names of packs given as (pack, content), in order."""
    return directory(packs).select("pack", "name").orderBy("pack", "name")


def cut_blocks(files: DataFrame) -> DataFrame:
    """pack, ord, name, pos, block: the content-defined blocks of files given as (pack, ord, name, content)."""

    def run(batches):
        for b in batches:
            for pack, ord_, name, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                payload = data[16:]
                ends = cut_points(payload)
                blocks = [payload[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)] if payload else []
                n = len(blocks)
                yield pa.RecordBatch.from_arrays([pa.array([pack] * n, pa.string()), pa.array([ord_] * n, pa.int64()), pa.array([base_name(name)] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(blocks, pa.binary())], names=["pack", "ord", "name", "pos", "block"])

    return files.select(F.col("pack").cast("string").alias("pack"), F.col("ord").cast("long").alias("ord"), "name", "content").mapInArrow(run, "pack string, ord long, name string, pos int, block binary")


def blocks_of(cut: DataFrame) -> DataFrame:
    """pack, number, block: each pack's distinct blocks, numbered by first use from 0."""
    first = cut.groupBy("pack", "block").agg(F.min(F.struct("ord", "name", "pos")).alias("at"))
    return first.select("pack", (F.row_number().over(Window.partitionBy("pack").orderBy("at")) - 1).alias("number"), "block")


def refs_of(cut: DataFrame, blocks: DataFrame) -> DataFrame:
    """pack, ord, name, pos, number: which block of the pack stands at each place of each entry."""
    return cut.join(blocks, ["pack", "block"]).select("pack", "ord", "name", "pos", "number")


def expand_refs(refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """pack, ord, name, payload: the entries put together from their blocks. An entry has few blocks."""
    parts = refs.join(blocks, ["pack", "number"]).groupBy("pack", "ord", "name").agg(F.sort_array(F.collect_list(F.struct("pos", "block"))).alias("b"))
    return parts.select("pack", "ord", "name", F.unhex(F.concat_ws("", F.transform("b", lambda x: F.hex(x.block)))).alias("payload"))

"""GIF as a media column: writing and reading code streams, palettes, disposal, transparency, timed frames."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkyard.llm.common import arrow_map

#: Samples of a row, rows of a frame, hundredths of a second of a frame, in stored payloads.
WIDTH, HEIGHT, DELAY = 64, 1024, 4
#: Most pixels of a screen or frame that the reader draws; what claims more isn't read.
PIXELS = 1 << 26
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)
_BYTE = np.arange(256)
#: Payload bytes as colours: three bits of red, three of green, two of blue.
COLOURS = np.stack([_BYTE >> 5 << 5, (_BYTE >> 2 & 7) << 5, (_BYTE & 3) << 6], 1).astype(np.uint8)
#: Payload frames are drawn on a cleared screen, and the filling's zeros don't show.
DISPOSAL, TRANSPARENT = 2, 0
#: A code table has at most 2 ** WIDEST entries.
WIDEST = 12


def _runs(size: int, first: int, count: int) -> list[tuple[int, int]]:
    """(codes, width) of `count` codes that begin `first` codes after a clear code. A code gives the table an entry,
    but for the first after a clear; codes widen when the table has outgrown them."""
    out = []
    for width in range(size + 1, WIDEST + 1):
        last = first + count if width == WIDEST else min(first + count, (1 << width) - (1 << size) - 1)
        if last > first:
            out.append((last - first, width))
            count -= last - first
            first = last
    return out


def _to_bits(codes: list[int], size: int) -> list[np.ndarray]:
    """The bits, one a byte and lowest first, of the codes after a clear code."""
    raw = np.array(codes, "<u2").view(np.uint8).reshape(-1, 2)
    out, at = [], 0
    for n, width in _runs(size, 0, len(codes)):
        out.append(np.unpackbits(raw[at : at + n], axis=1, count=width, bitorder="little").reshape(-1))
        at += n
    return out


def lzw_encode(samples: bytes, size: int = 8) -> bytes:
    """The compressing code stream of samples below 2 ** size; a full table is begun anew."""
    clear = 1 << size
    parts = [np.unpackbits(np.array([clear], "<u2").view(np.uint8), count=size + 1, bitorder="little")]
    codes: list[int] = []
    table: dict[int, int] = {}  # (code so far, sample) -> code; codes are kept 8 bits up
    free, known, put = clear + 2, table.get, codes.append
    head = -1
    for s in samples:
        if head < 0:
            head = s << 8
        elif (longer := known(head | s)) is not None:
            head = longer
        else:
            put(head >> 8)
            if free < 1 << WIDEST:
                table[head | s] = free << 8
                free += 1
            else:
                put(clear)
                parts += _to_bits(codes, size)
                codes.clear()
                table.clear()
                free = clear + 2
            head = s << 8
    if head >= 0:
        put(head >> 8)
    put(clear + 1)
    parts += _to_bits(codes, size)
    return np.packbits(np.concatenate(parts), bitorder="little").tobytes()


def _codes(data: bytes, at: int, size: int, first: int, count: int) -> list[int]:
    """At most `count` codes from bit `at` on, the first of them `first` codes after a clear code."""
    out: list[int] = []
    for n, width in _runs(size, first, count):
        n = min(n, (8 * len(data) - at) // width)
        if n <= 0:
            break
        raw = np.frombuffer(data, np.uint8, (at + n * width + 7 >> 3) - (at >> 3), at >> 3)
        bits = np.zeros((n, 16), np.uint8)
        bits[:, :width] = np.unpackbits(raw, bitorder="little")[at & 7 :][: n * width].reshape(n, width)
        out += np.packbits(bits, axis=1, bitorder="little").view("<u2")[:, 0].tolist()
        at += n * width
    return out


def lzw_decode(data: bytes, size: int, most: int) -> np.ndarray:
    """At most `most` samples of a code stream, by its code table; a code that cannot be is a ValueError.

    The codes between two clear codes have widths that their number alone tells, so they are cut out
    of the bits together; then each is looked up, and the table grows by the one before it and its first sample.
    """
    if not 1 <= size <= 8:
        raise ValueError("a code size that cannot be")
    clear = 1 << size
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, last = base[:], b""
    out: list[bytes] = []
    made = at = since = 0
    ahead, full = 512, 1 << WIDEST
    while made < most:
        codes = _codes(data, at, size, since, ahead)
        stop = min((codes.index(c) for c in (clear, clear + 1) if c in codes), default=len(codes))
        used = codes[:stop]
        before, wrong = len(out), False
        if used and not last:
            if wrong := used[0] > clear:
                used = []
            else:
                last = table[used[0]]
                out.append(last)
        grow, put, n = table.append, out.append, len(table)
        for code in used[1:] if since == 0 else used:
            if code < n:
                entry = table[code]
            elif code == n < full:
                entry = last + last[:1]
            else:
                wrong = True
                break
            put(entry)
            if n < full:
                grow(last + entry[:1])
                n += 1
            last = entry
        made += sum(map(len, out[before:]))
        if wrong and made < most:
            raise ValueError("a code before its entry")
        if stop == len(codes):  # neither a clear nor an end code
            if len(codes) < ahead:
                break
            at += sum(n * width for n, width in _runs(size, since, stop))
            since += stop
            ahead = min(2 * ahead, full)
        elif codes[stop] == clear:
            at += sum(n * width for n, width in _runs(size, since, stop + 1))
            ahead = max(256, since + stop + 1)
            table, last, since = base[:], b"", 0
        else:
            break
    return np.frombuffer(b"".join(out), np.uint8)[:most]


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int  # hundredths of a second
    disposal: int
    transparent: int  # palette index, or -1
    samples: np.ndarray  # height x width palette indices, rows in display order
    palette: np.ndarray
    canvas: np.ndarray | None  # screen after drawing, height x width x 4 (RGBA)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The joined sub-blocks from `at`, and the place after their end."""
    size = 256
    whole = (len(data) - at) // size
    if whole > 2:  # full blocks in one step
        lengths = np.frombuffer(data, np.uint8, whole * size, at).reshape(whole, size)
        short = np.flatnonzero(lengths[:, 0] != 255)
        k = int(short[0]) if len(short) else whole
    else:
        k = 0
    parts = [lengths[:k, 1:].tobytes()] if k else []
    at += k * size
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _sub_blocks(data: bytes) -> bytes:
    whole = len(data) // 255
    out = np.empty((whole, 256), np.uint8)
    out[:, 0] = 255
    out[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return out.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def read_gif(data: bytes, canvases: bool = True, pixels: int = PIXELS):
    """Yield the frames in order, drawn on the screen by their palettes, transparency and disposal.

    Not a GIF, codes that cannot be, or a screen or frame of more than `pixels`: ValueError. What is cut off in
    mid-frame ends the frames; missing samples are 0.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > pixels:
        raise ValueError(f"a screen of {width} x {height}")
    at, shared = 13, GREY
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    screen = np.zeros((height, width, 4), np.uint8) if canvases else None
    delay, disposal, transparent = 0, 0, -1
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                transparent = body[3] if body[0] & 1 else -1
            continue
        if data[at] != 0x2C or at + 11 > len(data):
            return
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        if w * h > pixels:
            raise ValueError(f"a frame of {w} x {h}")
        at += 10
        palette = shared
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        size = data[at]
        body, at = _blocks(data, at + 1)
        flat = lzw_decode(body, size, w * h)
        if len(flat) < w * h:
            flat = np.concatenate([flat, np.zeros(w * h - len(flat), np.uint8)])
        samples = flat.reshape(h, w)
        if flags & 0x40:  # interlaced: four passes
            rows = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            samples = samples[np.argsort(rows, kind="stable")]
        canvas = None
        if canvases:
            before = screen.copy() if disposal == 3 else None
            view = screen[top : top + h, left : left + w]
            part = samples[: view.shape[0], : view.shape[1]]
            table = np.zeros((256, 4), np.uint8)
            table[: len(palette), :3] = palette
            table[:, 3] = 255
            drawn = table[part]
            if transparent >= 0 and (through := part == transparent).any():
                drawn[through] = view[through]
            view[...] = drawn
            canvas = screen.copy()
            if disposal == 2:
                view[...] = 0
            elif disposal == 3:
                screen = before
        yield Frame(left, top, w, h, delay, disposal, transparent, samples, palette, canvas)
        delay, disposal, transparent = 0, 0, -1


def write_gif(frames: list[np.ndarray], palette: np.ndarray = GREY, delay: int = DELAY, disposal: int = 1, transparent: int = -1) -> bytes:
    """A GIF of 8-bit frames (height x width) at the screen's corner, with one palette of 256 colours."""
    height, width = max(len(f) for f in frames), max(f.shape[1] for f in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), np.ascontiguousarray(palette, np.uint8).tobytes()]
    control = b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent >= 0), delay, max(0, transparent), 0)
    for f in frames:
        out += [control, b"\x2c" + struct.pack("<HHHHB", 0, 0, f.shape[1], len(f), 0) + b"\x08", _sub_blocks(lzw_encode(f.tobytes()))]
    return b"".join([*out, b"\x3b"])


def colour_histogram(canvas: np.ndarray) -> np.ndarray:
    """Visible pixels by the upper two bits of red, green and blue: 64 counts."""
    c = canvas[..., :3] >> 6
    cell = (c[..., 0] << 4 | c[..., 1] << 2 | c[..., 2])[canvas[..., 3] > 0]
    return np.bincount(cell.reshape(-1), minlength=64)


def pack_payload(payload: bytes) -> bytes:
    """A payload of a positive multiple of WIDTH bytes as frames of at most HEIGHT rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return write_gif([rows[i : i + HEIGHT] for i in range(0, len(rows), HEIGHT)], COLOURS, disposal=DISPOSAL, transparent=TRANSPARENT)


def payload_media(docs: DataFrame, *, keep_media: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's whole text as a GIF: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, and media (binary) if keep_media.

    The UTF-8 bytes (null: none) are filled with zeros to a positive multiple of 64 and are the samples; LZW codes
    them. All but n_bytes and media_* is computed from the frames read back from the stored bytes through the code table.
    feature: frame count, screen, length in hundredths of a second, and the colour histogram of the
    drawn screens (zeros are transparent and don't count). An empty table gives no rows. Rows are independent: null
    or repeated ids and other columns don't matter.
    """

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1).cast(pa.binary()):
                text = t.as_py() or b""
                media = pack_payload(text + bytes(-len(text) % WIDTH or (0 if text else WIDTH)))
                digest, crc, size, tail, time, hist, n, screen = hashlib.sha256(), 0, 0, b"", 0, np.zeros(64, np.int64), 0, (0, 0)
                for f in read_gif(media):
                    part = f.samples.tobytes()
                    digest.update(part)
                    tail = (tail + part)[-WIDTH:]
                    size += len(part)
                    time += f.delay
                    hist += colour_histogram(f.canvas)
                    n += 1
                    screen = f.canvas.shape
                crc = zlib.crc32(tail)
                feature = f"frames={n};screen={screen[1]}x{screen[0]};time={time};colours={','.join(map(str, hist.tolist()))}"
                rows.append((len(text), size, digest.hexdigest(), crc, len(media), hashlib.sha256(media).hexdigest(), feature, *([media] if keep_media else [])))
            kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()} | ({"media": pa.binary()} if keep_media else {})
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values()))], names=["doc_id", *kinds])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def gif_frames(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The timed frames of GIFs: id, frame (from 0), start and delay (hundredths of a second), left, top, width,
    height, disposal, transparent (-1: none), histogram (64 counts of the drawn screen), rgba (the drawn screen).

    Each frame leaves the task by itself, so that memory holds one. A null, what isn't a GIF or has no frames, and a
    fault after some frames (these stay) give a row with a null frame and the reason in `error`; so does a screen or
    frame of more than PIXELS. An empty table gives no rows; repeated rows each give theirs; null ids are carried.
    """
    names = ["id", "frame", "start", "delay", "left", "top", "width", "height", "disposal", "transparent", "histogram", "rgba", "error"]
    kinds = [pa.int64(), *[pa.int32()] * 9, pa.list_(pa.int64()), pa.binary(), pa.string()]

    def row(*values):
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    def run(batches):
        for b in batches:
            for i, m in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n, start, error = 0, 0, None
                try:
                    for f in read_gif(m.as_py() or b""):
                        yield row(i, n, start, f.delay, f.left, f.top, f.width, f.height, f.disposal, f.transparent, colour_histogram(f.canvas).tolist(), f.canvas.tobytes(), None)
                        n += 1
                        start += f.delay
                except (ValueError, IndexError, struct.error) as e:
                    error = str(e) or "cut off"
                if error or not n:
                    yield row(i, *[None] * 11, error or "no frames")

    return arrow_map(media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("m")), run, "id long, frame int, start int, delay int, left int, top int, width int, height int, disposal int, transparent int, histogram array<long>, rgba binary, error string")

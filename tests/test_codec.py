import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkyard.operators import codec, packs


def stream(n, bpp=6, seed=0):
    r = np.random.default_rng(seed)
    out = np.zeros(4096, np.int64)
    at = r.choice(4096, n, replace=False)
    out[at] = r.integers(1, 1 << bpp, n) if bpp else 0
    return out


@pytest.mark.parametrize("bpp", range(1, 9))
@pytest.mark.parametrize("enc", [0, 1, 3])
@pytest.mark.parametrize("n", [0, 1, 340, 4096])
def test_round_trip(enc, bpp, n):
    s = stream(n, bpp)
    assert (codec.decode_raw(codec.encode_raw(s, enc, bpp), enc, bpp) == s).all()
    packed = zlib.compress(codec.encode_raw(s, enc, bpp), 9)
    assert (codec.decode_raw(packed, enc | 0x80, bpp) == s).all()


def test_sizes_and_raw_winner():
    for n, enc in ((0, 1), (340, 1), (341, 3), (3412, 3), (3413, 0), (4096, 0)):
        s = stream(n)
        assert codec.best(s, deflate=False)[0] == enc
        assert len(codec.encode_raw(s, 0)) == 3072
        assert len(codec.encode_raw(s, 1)) == (16 + 18 * n + 7) // 8
        assert len(codec.encode_raw(s, 3)) == 512 + (6 * n + 7) // 8


def test_bits_against_a_sequential_writer():
    values, width = [5, 63, 0, 1, 32, 7], 6
    acc = sum(v << (width * i) for i, v in enumerate(values))
    assert codec.pack_bits(np.array(values), width) == acc.to_bytes(5, "little")


def test_colours_are_cut_to_the_width():
    s = np.zeros(4096, np.int64)
    s[7] = 64
    assert not codec.load_file(codec.save_stream(s)).any()


def test_rank_is_a_permutation():
    assert sorted(codec.RANK) == list(range(4096))
    assert codec.RANK[16] == 2 and codec.RANK[256] == 4


def test_repeated_ranks_last_counts():
    body = struct.pack("<H", 2) + codec.pack_bits(np.array([9 | 5 << 12, 9 | 6 << 12]), 18)
    assert codec.decode_raw(body, 1)[9] == 6


def test_bad_files():
    good = codec.save_stream(stream(12))
    with pytest.raises(ValueError):
        codec.parse_header(good + b"x")
    assert (codec.load_file(good + b"x", strict=False) == stream(12)).all()
    for bad in (b"", b"VOPX" + good[4:], good[:4] + b"\x02" + good[5:], good[:5] + b"\x02" + good[6:], good[:-1]):
        with pytest.raises(ValueError):
            codec.load_file(bad, strict=False)
    assert not codec.load_file(b"VOPL\x03", strict=False).any()


ENTRIES = [("a", 0, bytes(range(256)) * 40), ("b", 3, b""), ("a", 1, b"x" * 40_000), ("é", 1, bytes(range(256)) * 40)]


@pytest.mark.parametrize("layout", [0, 1])
@pytest.mark.parametrize("code", [0, 1, 2])
def test_packs(layout, code):
    data = packs.write_pack((6, 16, 16, 16, 64), ENTRIES, layout, code)
    assert data[8] == (1 if layout == 0 and code < 2 else 2)
    assert packs.read_pack(data) == ((6, 16, 16, 16, 64), ENTRIES)
    for cut in (9, len(data) // 2):
        with pytest.raises(Exception):  # noqa: B017
            packs.read_pack(data[:cut])


def test_gear_table():
    assert packs.gear_table()[0] == 0xE016B2BAA0016A20
    assert packs.gear_table()[255] == 0x9627430A76BA0EE7


@settings(max_examples=20, deadline=None)
@given(st.binary(max_size=70_000))
def test_cuts_follow_the_rolling_hash(data):
    gear, ends, start, h = [int(g) for g in packs.gear_table()], [], 0, 0
    for pos, b in enumerate(data):
        h = (h * 2 + gear[b]) % 2**64
        if pos - start + 1 >= 2048 and (h % 4096 == 0 or pos - start + 1 >= 16384):
            ends.append(pos + 1)
            start, h = pos + 1, 0
    if start < len(data):
        ends.append(len(data))
    assert packs.cut_points(data) == ends

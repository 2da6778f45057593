"""What a worker holds, and what rectangles cost: bulk steps against plain ones."""

import time

import numpy as np
import pyarrow as pa
import pytest

from chunkyard.operators import codec, mesh, packs

RNG = np.random.default_rng(11)
MB = 1 << 20


class Frame:
    """Stands for a DataFrame, and keeps the function that would run on its batches."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


def noise(fill, colors=63):
    return np.where(RNG.random(4096) < fill, RNG.integers(1, colors + 1, 4096), 0)


def plain(s):
    """The rectangles of a chunk, one cell after another."""
    grid = np.zeros((16,) * 3, np.int64)
    grid[codec.INDEX & 15, codec.INDEX >> 4 & 15, codec.INDEX >> 8] = s
    for d, (axis, sign, _, _) in enumerate(mesh.FACING):
        g = np.pad(np.moveaxis(grid, axis, 0), ((1, 1), (0, 0), (0, 0)))
        faces = np.where(g[2:] == 0, g[1:-1], 0) if sign > 0 else np.where(g[:-2] == 0, g[1:-1], 0)
        for p, left in enumerate(faces):
            for u, v in np.argwhere(left):
                color, w, h = left[u, v], 1, 1
                if not color:
                    continue
                while v + w < 16 and left[u, v + w] == color:
                    w += 1
                while u + h < 16 and (left[u + h, v : v + w] == color).all():
                    h += 1
                left[u : u + h, v : v + w] = 0
                yield d, p, int(u), int(v), w, h, int(color)


def cells(streams):
    """A batch as of codec.cells_of()."""
    kind = pa.list_(pa.struct([("idx", pa.int32()), ("color", pa.int32())]))
    rows = [[{"idx": int(codec.INDEX[i]), "color": int(s[i])} for i in np.flatnonzero(s)] for s in streams]
    return pa.RecordBatch.from_arrays([pa.array([100 + i for i in range(len(rows))], pa.int64()), pa.array(rows, kind)], names=["chunk_id", "cells"])


def made_quads(monkeypatch, streams):
    frame = Frame()
    monkeypatch.setattr(mesh, "cells_of", lambda f: f)
    mesh.quads(frame)
    return [tuple(r.values()) for b in frame.run([cells(streams)]) for r in b.to_pylist()]


def test_quads_of_many_chunks_are_the_plain_ones(spark, monkeypatch):
    streams = [noise(f, c) for f in (0.0, 0.01, 0.2, 0.6, 1.0) for c in (1, 2, 63)] * 3
    streams += [np.full(4096, 3), np.arange(4096) % 255 + 1, np.repeat(RNG.integers(0, 3, 512), 8), np.repeat(RNG.integers(0, 3, 64), 64)]
    want = [(100 + c, i, *q) for c, s in enumerate(streams) for i, q in enumerate(plain(s))]
    assert len(streams) > 32 and made_quads(monkeypatch, streams) == want


def test_quads_take_no_step_a_rectangle(spark, monkeypatch):
    """Many chunks cost little more than one, cell by cell."""
    streams = [noise(0.22) for _ in range(64)]
    made_quads(monkeypatch, streams[:1])
    frame, batch = Frame(), cells(streams)
    mesh.quads(frame)
    began = time.process_time()
    n = sum(b.num_rows for b in frame.run([batch]))
    bulk, began = time.process_time() - began, time.process_time()
    assert n > 200_000
    for s in streams[:16]:
        list(plain(s))
    assert bulk < time.process_time() - began  # four times the chunks


@pytest.mark.parametrize("pack", [True, False])
def test_models_leave_in_bounded_batches(spark, pack):
    streams = [noise(0.3) for _ in range(16)]
    if pack:
        files = [packs.write_pack((6, 16, 16, 16, 64), [(f"{i}.vopl", *codec.best(s)) for i, s in enumerate(streams)])] * 6
    else:
        files = [codec.save_stream(s) for s in streams] * 3
    frame, one = Frame(), mesh.pack_glb if pack else mesh.chunk_glb
    mesh.to_glb(frame, pack)
    names = [f"n{i}" for i in range(len(files))]
    batches = list(frame.run([pa.RecordBatch.from_arrays([pa.array(names), pa.array(files, pa.binary())], names=["name", "content"])]))
    most = max(len(one(f)) for f in set(files))
    assert sum(b.nbytes for b in batches) > 16 * MB
    assert max(b.nbytes for b in batches) < 8 * MB + most + 4096
    assert [n for b in batches for n in b.column(0).to_pylist()] == names
    assert [g for b in batches for g in b.column(1).to_pylist()] == [one(f) for f in files]

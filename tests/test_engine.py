import json
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkyard import cli
from chunkyard.operators import codec, generate, grids, mesh, packs, texts
from chunkyard.plans.queries import ORACLE_SQL, QUERIES
from chunkyard.sources.files import example_by_id, example_list, read_examples, read_files, safe_name, unpack_files, write_files
from chunkyard.streaming import updates

CORNERS = '{"40213": {"0": 1, "15": 19, "3840": 13, "3855": 7}}'
SMALL = {x + 16 * y + 256 * z: 1 + (x + y + z) % 6 for x in range(3) for y in range(2) for z in range(2)}


def voxels(spark, cells, chunk=0):
    rows = [(chunk, i, i & 15, i >> 4 & 15, i >> 8, c) for i, c in cells.items()]
    return spark.createDataFrame(rows, "chunk_id long, idx int, x int, y int, z int, color int")


def stream(cells):
    out = np.zeros(4096, np.int64)
    for i, c in cells.items():
        out[codec.RANK[i]] = c
    return out


def collect(df):
    return {r.idx: r.color for r in df.collect()}


FULL = {i: 3 for i in range(4096)}
GOLDENS = [({0: 1, 15: 19, 3840: 13, 3855: 7}, 24, 24), (SMALL, 32, 32), (FULL, 1536, 6)]


@pytest.mark.parametrize(("cells", "faces", "quads"), GOLDENS)
def test_faces_and_quads(spark, cells, faces, quads):
    v = voxels(spark, cells)
    assert grids.exposed(v).count() == faces
    q = mesh.quads(v)
    assert q.count() == quads
    assert q.agg(F.sum(F.col("w") * F.col("h"))).first()[0] == faces


@pytest.mark.parametrize(("make", "n", "faces", "quads"), [(generate.sphere, 2176, 1248, 1062), (generate.rainbow, 4096, 1536, 1059), (generate.stripes, 4096, 1536, 66)])
def test_generators(spark, make, n, faces, quads):
    v = make(generate.cells(spark))
    assert v.count() == n
    assert grids.exposed(v).count() == faces
    assert mesh.quads(v).count() == quads


def test_quads_face_outward(spark):
    q = mesh.quads(voxels(spark, SMALL))
    rows = {}
    for r in mesh.vertices(q).collect():
        rows.setdefault(r.vertex_id // 4, []).append((r.vertex_id, np.array([r.px, r.py, r.pz]), np.array([r.nx, r.ny, r.nz])))
    assert len(rows) == 32
    for corner in rows.values():
        (_, a, n), (_, b, _), (_, c, _), _ = sorted(corner, key=lambda x: x[0])
        cross = np.cross(b - a, c - a)
        assert np.allclose(cross / np.linalg.norm(cross), n)


def test_vertices_agree_with_the_file(spark):
    made = mesh.vertices(mesh.quads(voxels(spark, SMALL))).orderBy("vertex_id").collect()
    at, n, _, order = mesh._mesh_arrays(stream(SMALL))
    assert np.array_equal(at, [[r.px, r.py, r.pz] for r in made])
    assert np.array_equal(n, [[r.nx, r.ny, r.nz] for r in made])
    assert order[:6].tolist() == [0, 1, 2, 0, 2, 3] and len(order) == 6 * 32


def glb_parts(data):
    magic, version, size, n, kind = struct.unpack_from("<IIIII", data)
    assert (magic, version, size, kind) == (0x46546C67, 2, len(data), 0x4E4F534A)
    return json.loads(data[20 : 20 + n])


def test_glb():
    cells = {0: 1, 15: 19, 3840: 13, 3855: 7}
    doc = glb_parts(mesh.chunk_glb(codec.save_stream(stream(cells))))
    prim = doc["meshes"][0]["primitives"][0]
    counts = {k: doc["accessors"][v]["count"] for k, v in prim["attributes"].items()}
    assert counts == {"POSITION": 96, "NORMAL": 96, "COLOR_0": 96}
    assert doc["accessors"][prim["indices"]]["count"] == 144
    assert doc["materials"][0]["alphaMode"] == "OPAQUE"
    pack = packs.write_pack((6, 16, 16, 16, 64), [(f"{i}", *codec.best(stream(cells))) for i in range(5)])
    doc = glb_parts(mesh.pack_glb(pack))
    assert [n["translation"] for n in doc["nodes"]] == [[0, 0, 0], [16, 0, 0], [32, 0, 0], [0, 0, 16], [16, 0, 16]]
    assert "NORMAL" not in doc["meshes"][0]["primitives"][0]["attributes"]
    with pytest.raises(ValueError):
        mesh.pack_glb(packs.write_pack((6, 16, 16, 16, 64), []))
    with pytest.raises(ValueError):
        mesh.write_glb([("x", stream({0: 64}), None)])


def test_updates(spark):
    made = cli.update(spark, None, CORNERS)
    got = codec.load_file(made)
    assert {int(codec.INDEX[r]): int(got[r]) for r in np.flatnonzero(got)} == {0: 1, 15: 19, 3840: 13, 3855: 7}
    again = codec.load_file(cli.update(spark, made, '{"0": {"0": 0, "1": 300, "4096": 5, "-1": 4}}'))
    assert {int(codec.INDEX[r]): int(again[r]) for r in np.flatnonzero(again)} == {1: 63, 15: 19, 3840: 13, 3855: 7}
    assert not codec.load_file(cli.update(spark, made, '{"0": {"0": 0, "15": 0, "3840": 0, "3855": -2}}')).any()


@pytest.mark.parametrize("text", ['{"0": {"0": 1.5}}', "[]", '{"0": {"x": 1}}', "{"])
def test_bad_updates(spark, text):
    with pytest.raises(Exception):  # noqa: B017
        texts.parse_updates(spark.createDataFrame([(text,)], "json string")).collect()


def test_lenient_updates(spark):
    rows = texts.parse_updates_lenient(spark.createDataFrame([('{"b": {"x": 7, "5": 300, "9999": 1}, "a": {"1": 2}}',)], "json string")).collect()
    assert sorted((r.chunk, r.idx, r.color) for r in rows) == [("b", 0, 7), ("b", 5, 300)]


def test_first_chunk_of_each_text(spark):
    rows = [('{"b": {"1": 2}, "a": {"5": 6}}', 1), ('{"d": {"1": 3}, "c": {"7": 8}}', 2), ("{}", 3)]
    plain = texts.parse_updates(spark.createDataFrame(rows, "json string, id int").select("json"), first_only=True)
    assert sorted((r.chunk, r.idx, r.color) for r in plain.collect()) == [("a", 5, 6), ("c", 7, 8)]
    named = texts.parse_updates(spark.createDataFrame(rows + [('{"a": {"5": 9}}', 4)], "json string, id int"), first_only=True)
    assert sorted((r.id, r.chunk, r.color) for r in named.collect()) == [(1, "a", 6), (2, "c", 8), (4, "a", 9)]


def test_writes_without_a_color_are_dropped(spark):
    log = spark.createDataFrame([(0, 1, 5, 1), (0, 1, None, 2), (0, 2, None, 1), (0, None, 4, 1), (0, 3, 400, 1), (0, 4, 0, 1)], "chunk_id long, idx int, color int, at int")
    assert collect(grids.apply_log(log, F.col("at"))) == {1: 5, 3: 255}
    assert collect(updates.live_cells(log, F.col("at"))) == {1: 5, 3: 255, 4: 0}
    assert [r.idx for r in grids.erased(log, F.col("at")).collect()] == [4]


def test_clearing(spark):
    v = voxels(spark, SMALL).unionAll(voxels(spark, {7: 1}, chunk=2))
    assert collect(grids.apply_log(grids.clearing(v), F.lit(0), v)) == {} and grids.cleared(v).count() == 0
    assert collect(grids.cleared(v, spark.createDataFrame([(0,), (0,), (9,)], "chunk_id long"))) == {7: 1}


def test_dense_cells(spark):
    rows = grids.densify(voxels(spark, SMALL)).collect()
    assert len(rows) == 4096 and {r.idx: r.color for r in rows if r.color} == SMALL and all(r.rank == codec.RANK[r.idx] for r in rows)


@pytest.mark.parametrize("layout", [packs.RAW, packs.CDC])
def test_directories_and_single_entries(spark, layout):
    entries = [("a/x.vopl", *codec.best(stream(SMALL))), ("y.vopl", *codec.best(stream(FULL))), ("x.vopl", *codec.best(stream({1: 2})))]
    data = packs.write_pack((6, 16, 16, 16, 64), entries, layout)
    assert packs.read_directory(data) == [(n, e, len(p)) for n, e, p in entries]
    assert [p for *_, p in packs.read_pack(data, {"y.vopl"})[1]] == [b"", entries[1][2], b""]
    for cut in (9, 11, 30):
        with pytest.raises((ValueError, zlib.error, struct.error)):
            packs.read_directory(data[:cut])
    df = spark.createDataFrame([("p", bytearray(data))], "pack string, content binary")
    assert [r.name for r in packs.listing(df).collect()] == ["x.vopl", "x.vopl", "y.vopl"]
    got = packs.entries_by_name(df, spark.createDataFrame([("p", "x.vopl"), ("p", "none"), ("q", "y.vopl")], "pack string, name string")).collect()
    assert [(r.pack, r.name) for r in got] == [("p", "x.vopl")] and codec.load_file(bytes(got[0].content)).sum() == 2


def test_blocks_and_references(spark):
    r = np.random.default_rng(1)
    same = r.integers(0, 256, 30_000, dtype=np.uint8).tobytes()
    payloads = [same, same[5000:] + b"x" * 10, b"", same]
    files = spark.createDataFrame([("p", i, f"f/{i}.vopl", bytearray(codec.build_file(0, p))) for i, p in enumerate(payloads)], "pack string, ord long, name string, content binary")
    cut = packs.cut_blocks(files)
    blocks = packs.blocks_of(cut)
    refs = packs.refs_of(cut, blocks)
    want, numbers = packs.blocks_and_refs(payloads)
    assert [bytes(x.block) for x in blocks.orderBy("number").collect()] == want
    assert [[x.number for x in refs.where(F.col("ord") == i).orderBy("pos").collect()] for i in range(4)] == numbers
    assert {x.ord: bytes(x.payload) for x in packs.expand_refs(refs, blocks).collect()} == {i: p for i, p in enumerate(payloads) if p}


def test_examples(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"examples": [{"id": "a", "name": "A", "layers": [["12"]]}, {"id": "b", "name": "B"}, {"id": "a", "name": "A2", "layers": [["3"]]}]}, indent=1))
    e = read_examples(spark, str(tmp_path / "e.json"))
    assert [(r.id, r.name) for r in example_list(e).collect()] == [("a", "A"), ("b", "B"), ("a", "A2")]
    assert [r.name for r in example_by_id(e, "a").collect()] == ["A2"] and example_by_id(e, "c").count() == 0
    assert collect(texts.decode_layers(example_by_id(e, "a"))) == {0: 3}
    (tmp_path / "n.json").write_text("{}")
    assert read_examples(spark, str(tmp_path / "n.json")).count() == 0


def test_hostile_names_are_not_unpacked(spark, tmp_path):
    for bad in ("../x.vopl", "a/x.vopl", ".."):
        data = packs.write_pack((6, 16, 16, 16, 64), [(bad, *codec.best(stream(SMALL)))])
        with pytest.raises(Exception, match="not a file name"):
            unpack_files(spark.createDataFrame([("p", bytearray(data))], "pack string, content binary"), str(tmp_path))


def test_json_round_trip(spark):
    text = texts.write_updates(voxels(spark, SMALL)).first().json
    assert json.loads(text) == {"0": {str(k): v for k, v in sorted(SMALL.items())}}


def test_diff_and_overlay(spark):
    a, b = voxels(spark, {1: 5, 2: 6, 3: 7}), voxels(spark, {2: 6, 3: 9, 4: 1})
    assert collect(grids.diff(a, b)) == {3: 9, 4: 1}
    assert collect(grids.overlay(a, b)) == {1: 5, 2: 6, 3: 9, 4: 1}
    empty = a.where("false")
    assert collect(grids.diff(empty, b)) == {2: 6, 3: 9, 4: 1} and collect(grids.overlay(empty, empty)) == {}


def test_single_edits(spark):
    v = voxels(spark, {1: 5})
    assert collect(grids.set_voxel(v, 0, 2, 0, 0, 7)) == {1: 5, 2: 7}
    assert collect(grids.set_voxel(v, 0, 1, 0, 0, 0)) == {}
    assert collect(grids.set_voxel(v, 0, 16, 0, 0, 7)) == {1: 5}


def test_layers(spark):
    rows = [["1234"] + [None] * 20, ["0,64,2 3,x"], *[["9" * 20]] * 20]
    got = texts.decode_layers(spark.createDataFrame([("e", rows)], "id string, layers array<array<string>>"))
    cells = {(r.x, r.y, r.z): r.color for r in got.collect()}
    assert {k: v for k, v in cells.items() if k[1] < 2} == {(0, 0, 0): 1, (1, 0, 0): 2, (2, 0, 0): 3, (3, 0, 0): 4, (2, 1, 0): 2, (3, 1, 0): 3}
    assert sum(k[1] >= 2 for k in cells) == 14 * 16


def test_noise(spark):
    got = generate.noise(spark, 3, 10, 0, seed=1).groupBy("chunk_id").agg(F.count("*").alias("n"), F.count_distinct("idx").alias("d")).collect()
    assert all(r.n == r.d <= generate.wanted(10) for r in got)
    assert generate.noise(spark, -4, 50).count() == 0
    assert generate.noise(spark, 1, 250).count() == 4096


def test_files(spark, tmp_path):
    made = codec.encode_chunks(voxels(spark, SMALL)).select(F.lit("0.vopl").alias("name"), "content")
    write_files(made, str(tmp_path / "out"))
    files = read_files(spark, str(tmp_path / "out"))
    assert [r.name for r in files.collect()] == ["0.vopl"]
    assert collect(codec.decode_files(files.select(F.lit(0).alias("chunk_id"), "content"))) == SMALL
    for bad in ("", "..", "a/b", "a\\b"):
        with pytest.raises(ValueError):
            safe_name(bad)


def test_cli(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    (tmp_path / "u.json").write_text(CORNERS)
    assert cli.main(["from-json", p("u.json"), p("a.vopl")]) == 0
    assert cli.main(["update", p("a.vopl"), p("u.json"), p("b.vopl")]) == 0
    assert cli.main(["pack", p("x.voplpack"), p("a.vopl"), p("b.vopl")]) == 0
    assert cli.main(["unpack", p("x.voplpack"), p("dir")]) == 0
    assert (tmp_path / "dir/a.vopl").read_bytes() == (tmp_path / "a.vopl").read_bytes()
    assert cli.main(["chunk-glb", p("a.vopl"), p("a.glb")]) == 0 and cli.main(["pack-glb", p("x.voplpack"), p("x.glb")]) == 0
    assert cli.main(["noise", "5", "2", p("noise")]) == 0 and len(list((tmp_path / "noise").iterdir())) == 2
    assert cli.main([]) == 1 and cli.main(["update"]) == 1


def test_stream(spark, tmp_path):
    folder = str(tmp_path / "log")
    rows = [(0, 5, 1, 1, "2024-01-01 00:00:00"), (0, 5, 9, 2, "2024-01-01 00:01:00"), (0, 6, 4, 1, "2024-01-01 00:02:00"), (0, 6, 0, 2, "2024-01-01 00:20:00"), (0, 9999, 1, 1, "2024-01-01 00:20:00")]
    schema = "chunk_id long, idx int, color int, seq int, ts string"
    spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts")).write.parquet(folder)
    log = spark.readStream.schema(schema.replace("ts string", "ts timestamp")).parquet(folder)
    for name, df in (("live", updates.live_cells(log, F.col("seq"))), ("rates", updates.write_rates(log, "ts"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
    assert {(r.idx, r.color) for r in spark.table("live").collect()} == {(5, 9), (6, 0)}
    assert sorted((r.writes, r.erased) for r in spark.table("rates").collect()) == [(2, 1), (3, 0)]


def norm(v):
    return float(f"{v:.7g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, name):
    import os

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    df = QUERIES[name](spark, sf)
    r = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(map(norm, x)) for x in r.fetchall()), key=repr)
    assert sorted((tuple(norm(x[c]) for c in cols) for x in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_mean_quads_cover_faces_once(spark, sf):
    """Each exposed face lies in just one rectangle of its direction, slice and colour."""
    v = QUERIES["live_voxels"](spark, sf)
    axes = {d: "xyz"[a] for d, (a, *_) in enumerate(mesh.FACING)}
    want = {(r.chunk_id, r.dir, r[axes[r.dir]], *(r[c] for c in "xyz" if c != axes[r.dir]), r.color) for r in grids.exposed(v).collect()}
    got = [(r.chunk_id, r.dir, r.slice, u, w, r.color) for r in mesh.quads(v).collect() for u in range(r.u, r.u + r.h) for w in range(r.v, r.v + r.w)]
    assert len(got) == len(set(got)) and set(got) == want

"""The catalogue: a query for each operator, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkyard.functions import index, varint
from chunkyard.functions.colors import css_hex, hex_rgba
from chunkyard.model import PALETTE, palette
from chunkyard.operators import codec, generate, grids, mesh, packs, texts
from chunkyard.plans.fixtures import ORDERS, VIEWS, ev, ev_log, li, li_log, table
from chunkyard.sources.files import PACKS, base_name, example_by_id, example_list, kind, read_examples, read_files, shared_folder, unpack_files, write_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_SPREAD = "({0} & 1) | (({0} & 2) << 2) | (({0} & 4) << 4) | (({0} & 8) << 6)"


def _interleave(x: str, y: str, z: str) -> str:
    a, b, c = (_SPREAD.format(v) for v in (x, y, z))
    return f"(({a}) | (({b}) << 1) | (({c}) << 2))"


RANK = f"CAST({_interleave('x', 'y', 'z')} AS INT)"
_LI_LONG = "SELECT chunk_id, idx, x, y, z, color FROM li"
_PALETTE = ", ".join(f"({i}, '{h}')" for i, h in enumerate(PALETTE))
#: All cells of a chunk, for generators.
_GRID = "g AS (SELECT CAST(i AS INT) AS idx, CAST(i & 15 AS INT) AS x, CAST((i >> 4) & 15 AS INT) AS y, CAST(i >> 8 AS INT) AS z FROM range(4096) t(i))"


def query(sql: str | None = None, views: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {VIEWS} {sql}" if views and not sql.lstrip().startswith("WITH") else sql
        return f

    return add


@query(_LI_LONG)
def live_voxels(spark, d):
    return li(spark, d)


@query("SELECT chunk_id, count(*) AS writes, count(DISTINCT idx) AS cells, count(*) FILTER (age = 1 AND color <> 0) AS live FROM li_log GROUP BY chunk_id")
def update_lww(spark, d):
    cells = li_log(spark, d).groupBy("chunk_id", "idx").agg(F.count("*").alias("w"), F.max_by("color", "at").alias("color"))
    return cells.groupBy("chunk_id").agg(F.sum("w").alias("writes"), F.count("*").alias("cells"), F.count_if(F.col("color") != 0).alias("live"))


@query("SELECT chunk_id, count(*) AS erased FROM ev_log WHERE age = 1 AND color = 0 GROUP BY chunk_id")
def update_erase_counts(spark, d):
    return grids.erased(ev_log(spark, d), F.col("at")).groupBy("chunk_id").agg(F.count("*").alias("erased"))


@query(", both_ AS (SELECT chunk_id, idx, color, 0 AS late FROM li UNION ALL SELECT chunk_id, idx, color, 1 FROM ev_log WHERE age = 1), last AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, idx ORDER BY late DESC) AS rn FROM both_) SELECT chunk_id, idx, idx & 15 AS x, (idx >> 4) & 15 AS y, idx >> 8 AS z, color FROM last WHERE rn = 1 AND color <> 0")
def update_on_base(spark, d):
    return grids.apply_log(ev_log(spark, d), F.col("at"), li(spark, d))


@query(f"SELECT chunk_id, idx, {RANK} AS rank FROM li")
def morton_rank(spark, d):
    return li(spark, d).select("chunk_id", "idx", index.morton(*map(F.col, "xyz")).cast("int").alias("rank"))


@query(f"SELECT chunk_id, idx, CAST({_interleave('x', 'z', 'y')} AS INT) AS rank FROM ev")
def morton_rank_compat(spark, d):
    return ev(spark, d).select("chunk_id", "idx", index.swapped_rank(*map(F.col, "xyz")).cast("int").alias("rank"))


@query("SELECT chunk_id, idx, x, y, z FROM ev")
def morton_rank_back(spark, d):
    ranks = ev(spark, d).select("chunk_id", "idx", index.swapped_rank(*map(F.col, "xyz")).alias("rank"))
    return ranks.select("chunk_id", "idx", *(c.cast("int").alias(n) for n, c in zip("xyz", index.from_swapped_rank(F.col("rank")), strict=True)))


@query(f"SELECT chunk_id, idx, row_number() OVER (PARTITION BY chunk_id ORDER BY {RANK}) - 1 AS pos FROM li")
def morton_order(spark, d):
    laid = grids.in_stream_order(li(spark, d))  # ranges of chunks, so a chunk lies in one partition
    return laid.withColumn("pos", F.row_number().over(Window.partitionBy("chunk_id").orderBy("rank")) - 1).select("chunk_id", "idx", F.col("pos").cast("long").alias("pos"))


_BITS = lambda v, k: " + ".join(f"((({v} >> {i}) & 1) << {3 * i + k})" for i in range(21))


@query(f"WITH e AS (SELECT event_id, (event_id * 7919) % 2097152 AS x, (event_id * 104729) % 2097152 AS y, user_id % 2097152 AS z FROM events) SELECT event_id, x, y, z, CAST({_BITS('x', 0)} + {_BITS('y', 1)} + {_BITS('z', 2)} AS BIGINT) AS code FROM e")
def morton64_roundtrip(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") * 7919 % 2097152).alias("x"), (F.col("event_id") * 104729 % 2097152).alias("y"), (F.col("user_id") % 2097152).alias("z"))
    coded = e.select("event_id", index.morton(*map(F.col, "xyz"), bits=21).alias("code"))
    return coded.select("event_id", *(c.alias(n) for n, c in zip("xyz", index.from_morton(F.col("code"), 21), strict=True)), "code")


@query("SELECT p_partkey, CASE WHEN greatest(p_size, 3, p_partkey % 40) > 1 THEN 3 * length(bin(greatest(p_size, 3, p_partkey % 40) - 1)) ELSE 0 END AS bits FROM part")
def morton_max_bits(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", index.morton_bits(F.col("p_size").cast("long"), F.lit(3).cast("long"), F.col("p_partkey") % 40).cast("long").alias("bits"))


@query(f"SELECT chunk_id, {RANK} AS rank, idx FROM ev")
def stream_to_grid(spark, d):
    r = ev(spark, d).select("chunk_id", index.morton(*map(F.col, "xyz")).cast("int").alias("rank"))
    return r.select("chunk_id", "rank", index.update_index(*index.from_morton(F.col("rank"))).cast("int").alias("idx"))


@query("SELECT a.chunk_id, a.idx, a.color FROM li a LEFT JOIN ev b ON a.chunk_id = b.chunk_id AND a.idx = b.idx WHERE b.color IS NULL OR b.color <> a.color")
def grid_diff(spark, d):
    return grids.diff(ev(spark, d), li(spark, d))


@query("SELECT coalesce(b.chunk_id, a.chunk_id) AS chunk_id, coalesce(b.idx, a.idx) AS idx, coalesce(b.x, a.x) AS x, coalesce(b.y, a.y) AS y, coalesce(b.z, a.z) AS z, coalesce(b.color, a.color) AS color FROM li a FULL JOIN ev b ON a.chunk_id = b.chunk_id AND a.idx = b.idx")
def overlay_layers(spark, d):
    return grids.overlay(li(spark, d), ev(spark, d))


@query("SELECT chunk_id, color, count(*) AS n FROM li GROUP BY chunk_id, color")
def color_histogram(spark, d):
    return li(spark, d).groupBy("chunk_id", "color").agg(F.count("*").alias("n"))


@query("SELECT chunk_id, idx, x, y, z, color FROM li WHERE chunk_id NOT IN (SELECT chunk_id FROM ev)")
def clear_chunks(spark, d):
    return grids.cleared(li(spark, d), ev(spark, d))


@query("SELECT chunk_id, idx, x, y, z, color FROM li WHERE color > 30")
def clear_by_writes(spark, d):
    v = li(spark, d)
    return grids.apply_log(grids.clearing(v.where("color <= 30")), F.lit(0), v)


@query(", e AS (SELECT chunk_id, idx, color FROM ev UNION ALL SELECT 1, 4095, 9), l AS (SELECT chunk_id, idx, color FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, idx ORDER BY color = 9 AND idx = 4095 AND chunk_id = 1 DESC) AS rn FROM e) WHERE rn = 1) SELECT chunk_id, idx, idx & 15 AS x, (idx >> 4) & 15 AS y, idx >> 8 AS z, color FROM l WHERE NOT (chunk_id = 0 AND idx = (SELECT min(idx) FROM ev WHERE chunk_id = 0))")
def single_edits(spark, d):
    v = ev(spark, d)
    gone = v.where("chunk_id = 0").agg(F.min("idx")).first()[0]
    v = grids.set_voxel(grids.set_voxel(v, 1, 15, 15, 15, 9), 1, 16, 0, 0, 9)  # the second lies beyond the chunk
    return grids.set_voxel(v, 0, gone & 15, gone >> 4 & 15, gone >> 8, 0)


@query(f", p(color, hex) AS (VALUES {_PALETTE}) SELECT color, hex, count(*) AS n FROM li JOIN p USING (color) GROUP BY color, hex")
def palette_join(spark, d):
    counts = li(spark, d).groupBy("color").agg(F.count("*").alias("n"))
    return mesh.colored(counts).select("color", "hex", "n")


@query(f"WITH p(color, hex) AS (VALUES {_PALETTE}) SELECT color, hex, CAST(('0x' || substr(hex, 2, 2))::INT / 255.0 AS FLOAT) AS r, CAST(('0x' || substr(hex, 4, 2))::INT / 255.0 AS FLOAT) AS g, CAST(('0x' || substr(hex, 6, 2))::INT / 255.0 AS FLOAT) AS b, CAST(CASE WHEN color = 0 THEN 0 ELSE 1 END AS FLOAT) AS a FROM p WHERE color > 0 OR color = 0")
def palette_parts(spark, d):
    return palette(spark)


@query("SELECT p_partkey, printf('%06x', (p_partkey * 7919) % 16777216) AS css FROM part")
def css_color(spark, d):
    return table(spark, d, "part").select("p_partkey", css_hex(F.col("p_partkey") * 7919 % 16777216).alias("css"))


_FACES = ", dirs(dir, dx, dy, dz) AS (VALUES (0,1,0,0),(1,-1,0,0),(2,0,1,0),(3,0,-1,0),(4,0,0,1),(5,0,0,-1)), faces AS (SELECT v.*, dir FROM li v, dirs WHERE NOT EXISTS (SELECT 1 FROM li n WHERE n.chunk_id = v.chunk_id AND n.x = v.x + dx AND n.y = v.y + dy AND n.z = v.z + dz))"


@query(f"{_FACES} SELECT chunk_id, idx, x, y, z, color, dir FROM faces")
def exposed_faces(spark, d):
    return grids.exposed(li(spark, d))


@query(f"{_FACES} SELECT chunk_id, dir, count(*) AS faces FROM faces GROUP BY chunk_id, dir")
def exposed_face_totals(spark, d):
    return grids.exposed(li(spark, d)).groupBy("chunk_id", "dir").agg(F.count("*").alias("faces"))


@query(f"{_FACES} SELECT chunk_id, dir, count(*) AS area FROM faces GROUP BY chunk_id, dir")
def quad_area_check(spark, d):
    return mesh.quads(li(spark, d)).groupBy("chunk_id", "dir").agg(F.sum(F.col("w") * F.col("h")).alias("area"))


@query(f"{_FACES} SELECT chunk_id, color, count(*) AS area FROM faces GROUP BY chunk_id, color")
def quad_color_area(spark, d):
    return mesh.quads(li(spark, d)).groupBy("chunk_id", "color").agg(F.sum(F.col("w") * F.col("h")).alias("area"))


_RECTANGLES = """, dirs2(dir, axis) AS (VALUES (0,0),(1,0),(2,1),(3,1),(4,2),(5,2)),
flat AS (SELECT chunk_id, dir, CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS slice, CASE axis WHEN 0 THEN y ELSE x END AS fu, CASE axis WHEN 2 THEN y ELSE z END AS fv, color FROM faces JOIN dirs2 USING (dir)),
slices AS (SELECT DISTINCT chunk_id, dir, slice FROM flat),
start AS (SELECT s.chunk_id, s.dir, s.slice, list(CAST(coalesce(f.color, 0) AS INT) ORDER BY i) AS g FROM slices s CROSS JOIN range(256) t(i)
  LEFT JOIN flat f ON f.chunk_id = s.chunk_id AND f.dir = s.dir AND f.slice = s.slice AND f.fu = i // 16 AND f.fv = i % 16 GROUP BY ALL),
rects(chunk_id, dir, slice, g, n, u, v, w, h, color) AS (
  SELECT chunk_id, dir, slice, g, 0, 0, 0, 0, 0, 0 FROM start
  UNION ALL
  SELECT chunk_id, dir, slice, list_transform(range(256), lambda i: CASE WHEN i // 16 >= u AND i // 16 < u + h AND i % 16 >= v AND i % 16 < v + w THEN 0 ELSE g[i + 1] END), n + 1, u, v, w, h, color
  FROM (SELECT *, coalesce(list_position(list_transform(range(u, 16), lambda r: len(list_filter(g[r * 16 + v + 1 : r * 16 + v + w], lambda x: x <> color)) = 0), false) - 1, 16 - u) AS h
    FROM (SELECT *, coalesce(list_position(list_transform(g[u * 16 + v + 1 : u * 16 + 16], lambda x: x = color), false) - 1, 16 - v) AS w
      FROM (SELECT chunk_id, dir, slice, g, n, (p - 1) // 16 AS u, (p - 1) % 16 AS v, g[p] AS color
        FROM (SELECT *, list_position(list_transform(g, lambda x: x <> 0), true) AS p FROM rects) WHERE p IS NOT NULL)))),
quads AS (SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY dir, slice, n) - 1 AS INT) AS quad, dir, CAST(slice AS INT) AS slice, CAST(u AS INT) AS u, CAST(v AS INT) AS v, CAST(w AS INT) AS w, CAST(h AS INT) AS h, color FROM rects WHERE n > 0)"""
#: The rectangles of ev's faces as SQL, cell by cell; `quads` has mesh_quads' rows.
_QUADS = f"WITH RECURSIVE {VIEWS}{_FACES.replace('FROM li ', 'FROM ev ')}{_RECTANGLES}"
_VERTICES = """, corners(k, du, dv) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)), normals(dir, nx, ny, nz, turned) AS (VALUES (0,1,0,0,false), (1,-1,0,0,true), (2,0,1,0,true), (3,0,-1,0,false), (4,0,0,1,false), (5,0,0,-1,true)),
vertices AS (SELECT chunk_id, CAST(quad * 4 + k AS BIGINT) AS vertex_id,
  CASE WHEN dir < 2 THEN slice + (dir = 0)::INT ELSE u + (CASE WHEN turned THEN dv ELSE du END) * h END::FLOAT AS px,
  CASE WHEN dir < 2 THEN u + (CASE WHEN turned THEN dv ELSE du END) * h WHEN dir < 4 THEN slice + (dir = 2)::INT ELSE v + (CASE WHEN turned THEN du ELSE dv END) * w END::FLOAT AS py,
  CASE WHEN dir < 4 THEN v + (CASE WHEN turned THEN du ELSE dv END) * w ELSE slice + (dir = 4)::INT END::FLOAT AS pz,
  nx::FLOAT AS nx, ny::FLOAT AS ny, nz::FLOAT AS nz, color FROM quads JOIN normals USING (dir), corners)"""


@query(f"{_QUADS} SELECT * FROM quads")
def mesh_quads(spark, d):
    return mesh.quads(ev(spark, d))


@query(f"{_QUADS}{_VERTICES} SELECT * FROM vertices")
def mesh_vertices(spark, d):
    return mesh.vertices(mesh.quads(ev(spark, d)))


_RGBA = ", ".join(f"CAST(('0x' || substr(hex, {i}, 2))::INT / 255.0 AS FLOAT) AS {c}" for c, i in zip("rgb", (2, 4, 6), strict=True))


@query(f"{_QUADS}{_VERTICES}, p(color, hex) AS (VALUES {_PALETTE}) SELECT chunk_id, vertex_id, {_RGBA}, 1::FLOAT AS a FROM vertices JOIN p USING (color)")
def mesh_vertex_colors(spark, d):
    return mesh.colored(mesh.vertices(mesh.quads(ev(spark, d)))).select("chunk_id", "vertex_id", "r", "g", "b", "a")


@query(f"{_QUADS} SELECT q.chunk_id, CAST(q.quad * 6 + i AS BIGINT) AS position, CAST(q.quad * 4 + CASE i WHEN 3 THEN 0 WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE i END AS BIGINT) AS vertex_id FROM quads q, range(6) t(i)")
def mesh_indices(spark, d):
    return mesh.indices(mesh.quads(ev(spark, d)))


@query(f"{_QUADS} SELECT chunk_id, 4 * count(*) AS vertices, 6 * count(*) AS indices FROM quads GROUP BY chunk_id")
def mesh_counts(spark, d):
    return mesh.mesh_counts(mesh.quads(ev(spark, d)))


@query(f"{_QUADS.replace('FROM ev ', 'FROM li ')} SELECT chunk_id, 4 * count(*) AS vertices, 6 * count(*) AS indices FROM quads GROUP BY chunk_id")
def mesh_vertex_counts(spark, d):
    return mesh.mesh_counts(mesh.quads(li(spark, d)))


@query(", i AS (SELECT *, x - row_number() OVER (PARTITION BY chunk_id, y, z, color ORDER BY x) AS island FROM li) SELECT chunk_id, y, z, color, min(x) AS x0, count(*) AS length FROM i GROUP BY chunk_id, y, z, color, island")
def slice_runs(spark, d):
    return grids.runs(li(spark, d))


@query(", e AS (SELECT DISTINCT chunk_id // 16 AS pack, 'chunk' || chunk_id AS name FROM li), o AS (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY name) - 1 AS ord, CAST(ceil(sqrt(count(*) OVER (PARTITION BY pack))) AS INT) AS cols FROM e) SELECT pack, name, CAST(ord AS INT) AS ord, CAST(ord % cols * 16 AS INT) AS x, CAST(ord // cols * 16 AS INT) AS z FROM o")
def pack_layout(spark, d):
    names = li(spark, d).select(F.expr("chunk_id div 16").alias("pack"), F.concat(F.lit("chunk"), F.col("chunk_id").cast("string")).alias("name")).distinct()
    return grids.pack_positions(names)


_SIZES = ", n AS (SELECT chunk_id, count(*) AS n FROM li GROUP BY chunk_id), s AS (SELECT chunk_id, n, CAST(3072 AS BIGINT) AS dense, (16 + n * 18 + 7) // 8 AS sparse, 512 + (n * 6 + 7) // 8 AS bitmap FROM n)"


@query(f"{_SIZES} SELECT * FROM s")
def enc_sizes(spark, d):
    return grids.raw_sizes(li(spark, d)).drop("enc")


@query(f"{_SIZES} SELECT chunk_id, CASE WHEN dense <= sparse AND dense <= bitmap THEN 0 WHEN sparse <= bitmap THEN 1 ELSE 3 END AS enc FROM s")
def enc_choice_raw(spark, d):
    return codec.encode_chunks(li(spark, d), deflate=False).select("chunk_id", "enc")


# A payload as SQL: each value's bits go to three bytes at most, and a byte is the sum of what goes to it.
_CELLS = f", r AS (SELECT chunk_id, {RANK} AS rank, color FROM li), m AS (SELECT chunk_id, rank, color, row_number() OVER (PARTITION BY chunk_id ORDER BY rank) - 1 AS rn FROM r), c AS (SELECT chunk_id, count(*) AS n FROM r GROUP BY chunk_id)"
_BYTES = ", part AS (SELECT chunk_id, (pos >> 3) + k AS byte, ((v << (pos & 7)) >> (8 * k)) & 255 AS b FROM bits, range(4) t(k)), size AS (SELECT chunk_id, {size} AS size FROM c), summed AS (SELECT chunk_id, byte, sum(b) AS b FROM part WHERE b <> 0 GROUP BY ALL), full_ AS (SELECT s.chunk_id, i, coalesce(b, 0) AS b FROM size s, range(5000) t(i) LEFT JOIN summed p ON p.chunk_id = s.chunk_id AND p.byte = i WHERE i < s.size) SELECT chunk_id, string_agg(printf('%02x', CAST(b AS BIGINT)), '' ORDER BY i) AS payload FROM full_ GROUP BY chunk_id"
_HEX = lambda df: df.select("chunk_id", F.lower(F.hex("payload")).alias("payload"))


@query(_CELLS + ", bits AS (SELECT chunk_id, rank * 6 AS pos, CAST(color & 63 AS BIGINT) AS v FROM m)" + _BYTES.format(size="3072"))
def enc_dense_bytes(spark, d):
    return _HEX(codec.encode_chunks(li(spark, d), enc=0))


@query(_CELLS + ", bits AS (SELECT chunk_id, 16 + 18 * rn AS pos, CAST(rank | ((color & 63) << 12) AS BIGINT) AS v FROM m UNION ALL SELECT chunk_id, 0, n FROM c)" + _BYTES.format(size="(16 + 18 * n + 7) // 8"))
def enc_sparse_bytes(spark, d):
    return _HEX(codec.encode_chunks(li(spark, d), enc=1))


@query(_CELLS + ", bits AS (SELECT chunk_id, rank AS pos, CAST(1 AS BIGINT) AS v FROM m UNION ALL SELECT chunk_id, 4096 + 6 * rn, color & 63 FROM m)" + _BYTES.format(size="512 + (6 * n + 7) // 8"))
def enc_bitmap_bytes(spark, d):
    return _HEX(codec.encode_chunks(li(spark, d), enc=3))


def _round_trip(enc):
    def run(spark, d):
        return codec.decode_files(codec.encode_chunks(li(spark, d), enc=enc))

    return run


for _name, _enc in (("dense_roundtrip", 0), ("sparse_roundtrip", 1), ("bitmap_roundtrip", 3), ("zlib_roundtrip", 0x80), ("codec_roundtrip", None)):
    _f = _round_trip(_enc)
    _f.__name__ = _name
    query(_LI_LONG)(_f)


def _files(spark, d):
    made = codec.encode_chunks(li(spark, d), deflate=False)
    return made.select(F.expr("chunk_id div 16").cast("string").alias("pack"), F.col("chunk_id").alias("ord"), F.concat(F.lit("some/folder/"), F.col("chunk_id").cast("string"), F.lit(".vopl")).alias("name"), "content")


def _unpacked(entries):
    return codec.decode_files(entries.select(F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("chunk_id"), "content"))


for _name, _layout, _codec in (("pack_roundtrip", packs.RAW, packs.ZLIB), ("pack_plain_roundtrip", packs.RAW, packs.NONE), ("cdc_roundtrip", packs.CDC, packs.NONE), ("cdc_zlib_roundtrip", packs.CDC, packs.ZLIB), ("zstd_roundtrip", packs.RAW, packs.ZSTD)):

    def _f(spark, d, layout=_layout, codec_=_codec):
        return _unpacked(packs.read_packs(packs.make_packs(_files(spark, d), layout, codec_)))

    _f.__name__ = _name
    query(_LI_LONG)(_f)


@query("SELECT DISTINCT CAST(chunk_id // 16 AS VARCHAR) AS pack, chunk_id || '.vopl' AS name FROM li")
def pack_listing(spark, d):
    return packs.listing(packs.make_packs(_files(spark, d)))


@query(f"{_SIZES} SELECT CAST(chunk_id // 16 AS VARCHAR) AS pack, CAST(row_number() OVER (PARTITION BY chunk_id // 16 ORDER BY chunk_id) - 1 AS INT) AS ord, chunk_id || '.vopl' AS name, CASE WHEN dense <= sparse AND dense <= bitmap THEN 0 WHEN sparse <= bitmap THEN 1 ELSE 3 END AS enc, least(dense, sparse, bitmap) AS bytes FROM s")
def pack_directory(spark, d):
    return packs.directory(packs.make_packs(_files(spark, d), packs.CDC, packs.ZLIB))


@query(f"{_SIZES} SELECT CAST(chunk_id // 16 AS VARCHAR) AS pack, chunk_id AS ord, chunk_id || '.vopl' AS name, least(dense, sparse, bitmap) AS bytes FROM s")
def cdc_relations(spark, d):
    cut = packs.cut_blocks(_files(spark, d))
    blocks = packs.blocks_of(cut)
    whole = packs.expand_refs(packs.refs_of(cut, blocks), blocks)
    files = _files(spark, d).select("pack", "ord", F.substring("content", 17, 1 << 20).alias("before"))
    same = whole.join(files, ["pack", "ord"]).where(F.col("payload") == F.col("before"))
    return same.select("pack", "ord", "name", F.octet_length("payload").cast("long").alias("bytes"))


@query(_LI_LONG)
def unpacked_files(spark, d):
    folder = shared_folder(spark)
    unpack_files(packs.make_packs(_files(spark, d)), folder)
    files = read_files(spark, folder)
    return codec.decode_files(files.select(F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("chunk_id"), "content"))


@query(_LI_LONG)
def chunk_files(spark, d):
    folder = shared_folder(spark)
    write_files(codec.encode_chunks(li(spark, d)).select(F.concat(F.col("chunk_id").cast("string"), F.lit(".vopl")).alias("name"), "content"), folder)
    files = read_files(spark, folder)
    return codec.decode_files(files.select(F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("chunk_id"), "content"))


@query("SELECT DISTINCT CAST(chunk_id // 16 AS VARCHAR) AS pack, chunk_id || '.vopl' AS name FROM li")
def pack_files(spark, d):
    folder = shared_folder(spark)
    write_files(packs.make_packs(_files(spark, d)).select(F.concat("pack", F.lit(".voplpack")).alias("name"), "content"), folder)
    return packs.directory(read_files(spark, folder, PACKS).select(F.regexp_extract("name", r"^(\d+)", 1).alias("pack"), "content")).select("pack", "name")


@query(f"{_SIZES} SELECT CAST(chunk_id // 16 AS VARCHAR) AS pack, count(*) AS entries, CAST(sum(least(dense, sparse, bitmap)) AS BIGINT) AS bytes FROM s GROUP BY 1")
def pack_totals(spark, d):
    e = packs.read_packs(packs.make_packs(_files(spark, d)))
    return e.groupBy("pack").agg(F.count("*").alias("entries"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"))


@query(f"{_SIZES} SELECT CAST(chunk_id // 16 AS VARCHAR) AS pack, max(CASE WHEN false THEN '' ELSE chunk_id || '.vopl' END) AS name, CAST(16 + max_by(least(dense, sparse, bitmap), chunk_id || '.vopl') AS BIGINT) AS bytes FROM s GROUP BY 1")
def entry_by_name(spark, d):
    made = packs.make_packs(_files(spark, d))
    wanted = packs.directory(made).groupBy("pack").agg(F.max("name").alias("name"))
    return packs.entries_by_name(made, wanted).select("pack", "name", F.octet_length("content").cast("long").alias("bytes"))


@query(f"{_SIZES} SELECT chunk_id || '.vopl' AS name, 'VOPL' AS magic, 3 AS ver, CASE WHEN dense <= sparse AND dense <= bitmap THEN 0 WHEN sparse <= bitmap THEN 1 ELSE 3 END AS enc, 6 AS bpp, 16 AS w, 16 AS h, 16 AS d, 64 AS pal, least(dense, sparse, bitmap) AS plen, 16 + least(dense, sparse, bitmap) AS bytes FROM s")
def header_parse(spark, d):
    files = _files(spark, d).withColumn("name", base_name(F.col("name")))
    return codec.headers(files)


@query("SELECT 6 AS bpp, 16 AS w, 16 AS h, 16 AS d, 64 AS pal")
def header_homogeneity(spark, d):
    return codec.check_homogeneous(_files(spark, d))


@query(_LI_LONG)
def updates_json_roundtrip(spark, d):
    written = texts.write_updates(li(spark, d)).select("json")
    cells = texts.parse_updates(written)
    return grids.with_position(cells.select(F.col("chunk").cast("long").alias("chunk_id"), "idx", "color"))


@query(", g AS (SELECT chunk_id // 4 AS id, min(CAST(chunk_id AS VARCHAR)) AS chunk FROM ev GROUP BY 1) SELECT id, chunk, idx, color FROM ev JOIN g ON CAST(chunk_id AS VARCHAR) = chunk AND chunk_id // 4 = id")
def updates_json_first_chunk(spark, d):
    one = ev(spark, d).groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("string"), "color"))).alias("m"))
    each = one.groupBy(F.expr("chunk_id div 4").alias("id")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("chunk_id").cast("string"), "m")))).alias("json"))
    return texts.parse_updates(each, first_only=True)


@query("SELECT CAST(chunk_id AS VARCHAR) AS chunk, idx, color FROM ev")
def updates_json_lenient(spark, d):
    return texts.parse_updates_lenient(texts.write_updates(ev(spark, d)).select("json"))


@query("SELECT chunk_id, idx, x, y, z, color FROM ev")
def json_to_chunks(spark, d):
    log = texts.parse_updates(texts.write_updates(ev(spark, d)).select("json"))
    made = codec.encode_chunks(grids.apply_log(log.select(F.col("chunk").cast("long").alias("chunk_id"), "idx", "color"), F.lit(0)))
    return codec.decode_files(made)


@query("WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) SELECT CAST(event_id AS VARCHAR) AS chunk, CAST(abs(k) % 5000 AS INT) AS idx, CAST(least(k % 300, 255) AS INT) AS color FROM e WHERE abs(k) % 5000 < 4096")
def updates_json_parse(spark, d):
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return texts.parse_updates(e.select(F.concat(F.lit('{"'), "event_id", F.lit('": {"'), F.abs("k") % 5000, F.lit('": '), F.col("k") % 300, F.lit("}}")).alias("json")))


def _grid(spark):
    return generate.cells(spark)


@query(f"WITH {_GRID}, r AS (SELECT *, sqrt((x-7.5)*(x-7.5) + (y-7.5)*(y-7.5) + (z-7.5)*(z-7.5)) AS r FROM g) SELECT idx, CAST(least(floor(r / 8 * 63), 62) + 1 AS INT) AS color FROM r WHERE r <= 8")
def gen_sphere(spark, d):
    return generate.sphere(_grid(spark)).select("idx", "color")


@query(f"WITH {_GRID} SELECT idx, CAST(least(floor(sqrt(x*x + y*y + z*z) / sqrt(768.0) * 63), 62) + 1 AS INT) AS color FROM g")
def gen_rainbow(spark, d):
    return generate.rainbow(_grid(spark)).select("idx", "color")


@query(f"WITH {_GRID} SELECT idx, CAST(1 + z % 63 AS INT) AS color FROM g")
def gen_stripes(spark, d):
    return generate.stripes(_grid(spark)).select("idx", "color")


def _noise_sql(scale: tuple[str, str, str], seed: float, octaves: int) -> str:
    """Octaves of value noise at x, y, z: the corners' values, blended by smoothed distances."""
    total = []
    for o in range(octaves):
        at = [f"({c} * {s} * {2**o})" for c, s in zip("xyz", scale, strict=True)]
        t = [f"({a} - floor({a}))" for a in at]
        smooth = [f"({v} * {v} * (3 - 2 * {v}))" for v in t]
        for corner in ((i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)):
            dot = " + ".join(f"(floor({a}) + {c}) * {m}" for a, c, m in zip(at, corner, ("127.1::DOUBLE", "311.7::DOUBLE", "74.7::DOUBLE"), strict=True))
            h = f"(sin({dot} + {seed + 13.37 * o}::DOUBLE) * 43758.5453::DOUBLE)"
            total.append(f"({h} - floor({h})) * " + " * ".join(w if c else f"(1 - {w})" for w, c in zip(smooth, corner, strict=True)) + f" * {0.5 ** (o + 1)}")
    return " + ".join(total)


@query(f"WITH {_GRID}, n AS (SELECT *, {_noise_sql(('0.35::DOUBLE', '0.35::DOUBLE', '0.35::DOUBLE'), 5.0, 2)} AS n FROM g WHERE y < 2 AND least(x, 15 - x, z, 15 - z) IN (1, 2)) SELECT idx, CAST((floor(n * 63) % 63 + 63) % 63 + 1 AS INT) AS color FROM n")
def gen_contour(spark, d):
    return generate.contour(_grid(spark), 5.0).select("idx", "color")


@query(f"WITH {_GRID}, n AS (SELECT *, {_noise_sql(('0.35::DOUBLE', '0.55::DOUBLE', '0.35::DOUBLE'), 5.0, 3)} AS n FROM g) SELECT idx, CAST((floor(n * 997 + x * 17 + y * 31 + z * 13) % 63 + 63) % 63 + 1 AS INT) AS color FROM n WHERE n > 0.58::DOUBLE - y * 0.06::DOUBLE")
def gen_terrain(spark, d):
    return generate.terrain(_grid(spark), 5.0).select("idx", "color")


@query("SELECT CAST(i AS BIGINT) AS chunk_id, 4096 AS n FROM range(3) t(i)")
def gen_fill(spark, d):
    return generate.fill(generate.cells(spark, 3), 7).where("color between 1 and 63").groupBy("chunk_id").agg(F.count("*").cast("int").alias("n"))


@query("SELECT CAST(i AS BIGINT) AS chunk_id, CAST(1024 AS BIGINT) AS n, CAST(1024 AS BIGINT) AS cells FROM range(8) t(i)")
def noise_counts(spark, d):
    return generate.noise(spark, 8, 25.0, seed=3).where("color between 1 and 63").groupBy("chunk_id").agg(F.count("*").alias("n"), F.count_distinct("idx").alias("cells"))


@query("SELECT i || '.vopl' AS name, true AS in_range, true AS distinct_cells FROM range(24) t(i)", views=False)
def noise_files(spark, d):
    """Chunks with 40 down to 10 % of random cells as files, read again."""
    folder = shared_folder(spark)
    made = codec.encode_chunks(generate.noise(spark, 24, 40.0, 10.0, seed=7))
    write_files(made.select(F.concat(F.col("chunk_id").cast("string"), F.lit(".vopl")).alias("name"), "content"), folder)
    cells = codec.decode_files(read_files(spark, folder).select(F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("chunk_id"), "content"))
    n = F.count("*")
    out = cells.groupBy("chunk_id").agg(n.between(generate.wanted(10), generate.wanted(40)).alias("in_range"), (n == F.count_distinct("idx")).alias("distinct_cells"))
    return out.select(F.concat(F.col("chunk_id").cast("string"), F.lit(".vopl")).alias("name"), "in_range", "distinct_cells")


_ROW = "CASE n_nationkey % 3 WHEN 0 THEN '0,1, 2,x,70,-3,63' WHEN 1 THEN '12345' ELSE '9 8  7' END"


@query(f"WITH t AS (SELECT n_nationkey AS id, n_nationkey % 3 AS m FROM nation), v(m, x, color) AS (VALUES (0,1,1),(0,2,2),(0,6,63),(1,0,1),(1,1,2),(1,2,3),(1,3,4),(1,4,5),(2,0,9),(2,1,8),(2,2,7)) SELECT t.id, CAST(x + 16 * 1 + 256 * z AS INT) AS idx, x, 1 AS y, z, color FROM t JOIN v USING (m), (VALUES (0), (2)) s(z)")
def layers_decode(spark, d):
    row = F.expr(_ROW)
    rows = F.array(row, F.lit(None).cast("string"), row)
    e = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.array(F.array(F.lit("0")), rows).alias("layers"))
    return texts.decode_layers(e)


def _examples(spark, d):
    """nation as a file of layered examples; written by a task, read by Spark's JSON source."""
    folder = shared_folder(spark)
    digits = F.concat(F.lit("0"), F.col("n_nationkey").cast("string"))
    one = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.array(F.array(digits, F.lit("7 8"))).alias("layers"))
    rows = table(spark, d, "nation").agg(F.to_json(F.struct(F.sort_array(F.collect_list(one)).alias("examples"))).cast("binary").alias("content"))  # one file holds them all
    write_files(rows.select(F.lit("examples.json").alias("name"), "content"), folder)
    return read_examples(spark, f"file://{folder}/examples.json")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation", views=False)
def examples_list(spark, d):
    return example_list(_examples(spark, d))


@query("SELECT '7' AS id, CAST(1 + 16 * 0 + 256 * 0 AS INT) AS idx, 7 AS color UNION ALL SELECT '7', 256, 7 UNION ALL SELECT '7', 257, 8", views=False)
def example_cells(spark, d):
    return texts.decode_layers(example_by_id(_examples(spark, d), "7")).select("id", "idx", "color")


@query("SELECT chunk_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1, count(*) AS n FROM li GROUP BY chunk_id")
def bounding_box(spark, d):
    sides = [f(c).alias(f"{c}{k}") for c in "xyz" for k, f in enumerate((F.min, F.max))]
    return li(spark, d).groupBy("chunk_id").agg(*sides, F.count("*").alias("n"))


@query("SELECT chunk_id, CAST(4096 AS BIGINT) AS cells, count(*) AS full, CAST(sum(color) AS BIGINT) AS total FROM li GROUP BY chunk_id")
def densify_counts(spark, d):
    return grids.densify(li(spark, d)).groupBy("chunk_id").agg(F.count("*").alias("cells"), F.count_if(F.col("color") != 0).alias("full"), F.sum("color").alias("total"))


@query("WITH n AS (SELECT c_custkey, c_custkey % 3 AS m FROM customer) SELECT c_custkey, CASE m WHEN 0 THEN c_custkey || '.VOPL' WHEN 1 THEN c_custkey || '.voplpack' ELSE c_custkey || '.txt' END AS name, CASE m WHEN 0 THEN 'chunk' WHEN 1 THEN 'pack' END AS kind FROM n")
def file_kinds(spark, d):
    end = F.element_at(F.array(F.lit(".VOPL"), F.lit(".voplpack"), F.lit(".txt")), (F.col("c_custkey") % 3 + 1).cast("int"))
    c = table(spark, d, "customer").select("c_custkey", base_name(F.concat(F.lit("a/b\\c/"), F.col("c_custkey").cast("string"), end)).alias("name"))
    return c.withColumn("kind", kind(F.col("name")))


@query("WITH o AS (SELECT o_orderkey, (o_orderkey * 104729 * 37) % 4294967296 AS v FROM orders) SELECT o_orderkey, v, CASE WHEN v < 128 THEN printf('%02x', v) WHEN v < 16384 THEN printf('%02x%02x', (v & 127) + 128, v >> 7) WHEN v < 2097152 THEN printf('%02x%02x%02x', (v & 127) + 128, ((v >> 7) & 127) + 128, v >> 14) WHEN v < 268435456 THEN printf('%02x%02x%02x%02x', (v & 127) + 128, ((v >> 7) & 127) + 128, ((v >> 14) & 127) + 128, v >> 21) ELSE printf('%02x%02x%02x%02x%02x', (v & 127) + 128, ((v >> 7) & 127) + 128, ((v >> 14) & 127) + 128, ((v >> 21) & 127) + 128, v >> 28) END AS bytes FROM o")
def varint_roundtrip(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", varint.encode(F.col("o_orderkey") * 104729 * 37 % 4294967296).alias("bytes"))
    return o.select("o_orderkey", varint.decode(F.col("bytes")).alias("v"), "bytes")


@query("SELECT chunk_id, idx, x + CAST(floor(((color % 3) - 1) * 0.7 + 0.5) AS INT) AS px, y + CAST(floor(0.4 + 0.5) AS INT) AS py, z + CAST(floor(-0.5 + 0.5) AS INT) AS pz FROM li")
def placement(spark, d):
    at = index.placement(F.col("x"), F.col("y"), F.col("z"), (F.col("color") % 3 - 1) * 0.7, F.lit(0.4), F.lit(-0.5))
    return li(spark, d).select("chunk_id", "idx", *(c.alias(n) for n, c in zip(("px", "py", "pz"), at, strict=True)))


@query(f"{_QUADS} SELECT CAST(chunk_id AS VARCHAR) AS name, 2 AS version, 4 * count(*) AS vertices, 6 * count(*) AS indices, 184 * count(*) AS bin_bytes, true AS whole, 'ChunkMesh' AS mesh, 'OPAQUE' AS alpha FROM quads GROUP BY chunk_id")
def glb_sizes(spark, d):
    """Four vertices of position, normal and colour (40 bytes) and six indices of 4 bytes a rectangle."""
    files = codec.encode_chunks(ev(spark, d)).select(F.col("chunk_id").cast("string").alias("name"), "content")
    parts = mesh.glb_parts(mesh.to_glb(files))
    field = lambda path, kind="string": F.get_json_object("json", path).cast(kind)
    return parts.select("name", "version", field("$.accessors[0].count", "long").alias("vertices"), field("$.accessors[3].count", "long").alias("indices"), "bin_bytes", "whole", field("$.meshes[0].name").alias("mesh"), field("$.materials[0].alphaMode").alias("alpha"))


@query(f"{_QUADS}, n AS (SELECT chunk_id // 16 AS pack, count(DISTINCT chunk_id) AS n, count(*) AS q FROM quads GROUP BY 1), c AS (SELECT *, CAST(ceil(sqrt(n)) AS INT) AS cols FROM n) SELECT CAST(pack AS VARCHAR) AS name, CAST(n AS INT) AS nodes, CAST(n AS INT) AS meshes, 136 * q AS bin_bytes, (least(n, cols) - 1) * 16.0::DOUBLE AS x, ((n - 1) // cols) * 16.0::DOUBLE AS z FROM c")
def pack_glb_sizes(spark, d):
    """Without normals: 28 bytes a vertex; entries on a square grid."""
    files = codec.encode_chunks(ev(spark, d), deflate=False).select(F.expr("chunk_id div 16").cast("string").alias("pack"), F.col("chunk_id").alias("ord"), F.concat(F.col("chunk_id").cast("string"), F.lit(".vopl")).alias("name"), "content")
    parts = mesh.glb_parts(mesh.to_glb(packs.make_packs(files).withColumnRenamed("pack", "name"), pack=True))
    nodes = F.from_json(F.get_json_object("json", "$.nodes"), "array<struct<translation: array<double>>>")
    most = lambda k: F.array_max(F.transform(nodes, lambda n: n.translation[k]))
    return parts.select("name", F.size(nodes).alias("nodes"), F.json_array_length(F.get_json_object("json", "$.meshes")).alias("meshes"), "bin_bytes", most(0).alias("x"), most(2).alias("z"))


@query("SELECT chunk_id, idx, x, y, z, color FROM li QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY " + _interleave("x", "y", "z") + ") = 1")
def first_in_stream(spark, d):
    rank = index.morton(*map(F.col, "xyz"))
    return li(spark, d).withColumn("r", rank).groupBy("chunk_id").agg(F.min_by(F.struct("idx", "x", "y", "z", "color"), "r").alias("v")).select("chunk_id", "v.*")


@query("SELECT l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'x' ELSE 'y' END AS side FROM lineitem WHERE l_partkey % 20 - 2 BETWEEN 0 AND 15 AND l_suppkey % 20 BETWEEN 0 AND 15 AND l_linenumber * 4 BETWEEN 0 AND 15")
def bounded_lookup(spark, d):
    t = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    return t.where(index.inside(F.col("l_partkey") % 20 - 2, F.col("l_suppkey") % 20, F.col("l_linenumber") * 4)).withColumn("side", F.when(F.col("l_linenumber") % 2 == 0, "x").otherwise("y"))


@query("WITH v AS (SELECT p_partkey, (p_partkey * 2654435761) % 4294967296 AS v FROM part) SELECT p_partkey, CAST((v >> 24) / 255.0 AS FLOAT) AS r, CAST(((v >> 16) & 255) / 255.0 AS FLOAT) AS g, CAST(((v >> 8) & 255) / 255.0 AS FLOAT) AS b, CAST(CASE WHEN p_partkey % 2 = 0 THEN (v & 255) / 255.0 ELSE 1 END AS FLOAT) AS a FROM v", views=False)
def hex_color_parse(spark, d):
    """Eight digits for even keys, six for odd ones."""
    p = table(spark, d, "part").select("p_partkey", F.lpad(F.hex(F.col("p_partkey") * 2654435761 % 4294967296), 8, "0").alias("h"))
    shown = F.concat(F.lit("#"), F.when(F.col("p_partkey") % 2 == 0, F.col("h")).otherwise(F.substring("h", 1, 6)))
    return p.select("p_partkey", *(c.alias(n) for n, c in zip("rgba", hex_rgba(shown), strict=True)))


@query("SELECT l_orderkey, l_linenumber, l.l_orderkey // 250 AS chunk_id, l_partkey % 20 AS x, l_suppkey % 20 AS y, CAST(l_linenumber AS BIGINT) AS z, coalesce(li.color, 0) AS color FROM lineitem l LEFT JOIN li ON li.chunk_id = l.l_orderkey // 250 AND li.x = l_partkey % 20 AND li.y = l_suppkey % 20 AND li.z = l_linenumber")
def voxel_lookup(spark, d):
    at = [F.expr(f"l_orderkey div {ORDERS}"), F.col("l_partkey") % 20, F.col("l_suppkey") % 20, F.col("l_linenumber").cast("long")]
    points = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(n) for c, n in zip(at, ("chunk_id", "x", "y", "z"), strict=True)))
    return grids.colors_at(li(spark, d), points)


@query("SELECT chunk_id, z + 16 * x + 256 * y AS at, color FROM li")
def decode_grid(spark, d):
    grid = codec.dense_grids(codec.encode_chunks(li(spark, d)))
    return grid.select("chunk_id", F.posexplode("grid").alias("at", "color")).where("color <> 0").select("chunk_id", "at", F.col("color").cast("int").alias("color"))


@query(_LI_LONG)
def canonical_pack_roundtrip(spark, d):
    files = codec.encode_chunks(li(spark, d), bpp=8).select(F.expr("chunk_id div 16").cast("string").alias("pack"), F.concat(F.col("chunk_id").cast("string"), F.lit(".vopl")).alias("name"), "content")
    return _unpacked(packs.read_packs(packs.canonical_packs(files)))


@query(f"{_SIZES} SELECT chunk_id || '.vopl' AS name, 6 AS bpp FROM s")
def canonical_headers(spark, d):
    files = codec.encode_chunks(li(spark, d), bpp=8).select(F.concat(F.col("chunk_id").cast("string"), F.lit(".vopl")).alias("name"), "content")
    return codec.headers(codec.canonical_files(files)).select("name", "bpp")


@query("SELECT color, hex FROM p WHERE color > 0".replace("p WHERE", f"(VALUES {_PALETTE}) p(color, hex) WHERE"), views=False)
def usable_colors(spark, d):
    return palette(spark).where("color > 0").select("color", "hex").orderBy("color")


@query("SELECT pack, min(name) AS name FROM (SELECT DISTINCT CAST(chunk_id // 16 AS VARCHAR) AS pack, chunk_id || '.vopl' AS name FROM li) GROUP BY pack")
def first_entry(spark, d):
    return packs.directory(packs.make_packs(_files(spark, d))).groupBy("pack").agg(F.min("name").alias("name"))

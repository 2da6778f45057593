"""python -m chunkyard.cli COMMAND ...: the commands on files."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chunkyard.operators import codec, generate, grids, mesh, packs, texts
from chunkyard.sources.files import base_name, write_files

USAGE = """commands:
  update IN.chunk UPDATES.json OUT.chunk
  from-json UPDATES.json OUT.chunk
  chunk-glb IN.chunk OUT.glb
  pack OUT.pack IN.chunk...
  unpack IN.pack FOLDER
  pack-glb IN.pack OUT.glb
  noise PERCENT [PERCENT] AMOUNT FOLDER"""


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _write(path: str, data: bytes) -> None:
    with open(path, "wb") as f:
        f.write(data)


def update(spark: SparkSession, base: bytes | None, text: str) -> bytes:
    """A chunk file after an updates text; no base: an empty one. Of several chunks the least name counts."""
    log = texts.parse_updates(spark.createDataFrame([(text,)], "json string"), first_only=True)
    log = log.select(F.lit(0).cast("long").alias("chunk_id"), "idx", "color")
    old = codec.decode_files(spark.createDataFrame([(0, bytearray(base))], "chunk_id long, content binary"), strict=False) if base else None
    made = codec.encode_chunks(grids.apply_log(log, F.lit(0), old)).collect()
    return bytes(made[0].content) if made else codec.save_stream(codec.np.zeros(codec.CELLS, int))


def main(argv: list[str]) -> int:
    args = argv[1:]
    arity = {"update": 3, "from-json": 2, "chunk-glb": 2, "unpack": 2, "pack-glb": 2}
    command = argv[0] if argv else ""
    if command not in (*arity, "pack", "noise") or (command in arity and len(args) != arity[command]) or (command == "pack" and len(args) < 2) or (command == "noise" and len(args) not in (3, 4)):
        print(USAGE, file=sys.stderr)
        return 1
    if command == "chunk-glb":
        _write(args[1], mesh.chunk_glb(_read(args[0])))
    elif command == "pack-glb":
        _write(args[1], mesh.pack_glb(_read(args[0])))
    else:
        spark = SparkSession.builder.getOrCreate()
        if command == "unpack":
            os.makedirs(args[1], exist_ok=True)
            read = spark.read.format("binaryFile").load(args[0]).select(F.lit("").alias("pack"), "content")
            write_files(packs.read_packs(read).select("name", "content"), args[1])
        elif command == "update":
            _write(args[2], update(spark, _read(args[0]), _read(args[1]).decode()))
        elif command == "from-json":
            _write(args[1], update(spark, None, _read(args[0]).decode()))
        elif command == "pack":
            files = spark.createDataFrame([(os.path.basename(args[0]), i, p, bytearray(_read(p))) for i, p in enumerate(args[1:])], "pack string, ord long, name string, content binary")
            _write(args[0], bytes(packs.make_packs(files.withColumn("name", base_name(F.col("name")))).first().content))
        else:
            shares = [float(a) for a in args[:-2]]
            made = codec.encode_chunks(generate.noise(spark, int(args[-2]), *shares))
            write_files(made.select(F.concat(F.col("chunk_id").cast("string"), F.lit(".vopl")).alias("name"), "content"), args[-1])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Chunk and pack files: distributed reads by Spark's binary source, writes to a folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS, PACKS = "*.vopl", "*.voplpack"
EXAMPLE = "struct<id: string, name: string, layers: array<array<string>>>"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"[/\\]+$", ""), r"[/\\]"), -1)


def kind(name: Column) -> Column:
    """`chunk`, `pack` or null by the lower-cased ending."""
    low = F.lower(name)
    return F.when(low.endswith(PACKS[1:]), "pack").when(low.endswith(CHUNKS[1:]), "chunk")


def read_files(spark: SparkSession, path: str, pattern: str = CHUNKS) -> DataFrame:
    """name, path, content of the matching files below a path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(base_name(F.col("path")).alias("name"), "path", "content")


def safe_name(name: str) -> str:
    if not name or name in (".", "..") or any(c in name for c in "/\\\0"):
        raise ValueError(f"not a file name: {name!r}")
    return name


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content", below: str | None = None) -> None:
    """One file a row, through a name that is replaced when whole, so a task that runs again does no harm. below: a column
    with the name of a folder of its own. The folder must be mounted on every executor; for other stores write the
    table as Parquet."""

    def put(part):
        for r in part:
            own = os.path.join(folder, safe_name(r[2])) if below else folder
            os.makedirs(own, exist_ok=True)
            target = os.path.join(own, safe_name(r[0]))
            temporary = f"{target}.{os.getpid()}.part"
            with open(temporary, "wb") as f:
                f.write(r[1])
            os.replace(temporary, target)

    rows.select(name, content, *([below] if below else [])).foreachPartition(put)


def unpack_files(packs: DataFrame, folder: str) -> None:
    """The entries of packs given as (pack, content) as files in a folder a pack, written by the tasks that read the packs."""
    from chunkyard.operators.packs import read_packs

    write_files(read_packs(packs).select("pack", "name", "content"), folder, below="pack")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see, below spark.checkpoint.dir; in local mode without that setting a temporary one."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    if "://" in root or not (root or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a mounted folder that driver and executors share")
    if root:
        os.makedirs(root, exist_ok=True)
    folder = tempfile.mkdtemp(prefix="chunkyard-files-", dir=root or None)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """ord, id, name, layers of the layered examples in a JSON file {"examples": [...]}, in its order."""
    whole = spark.read.schema(f"examples array<{EXAMPLE}>").option("multiLine", "true").json(path)
    return whole.select(F.posexplode("examples").alias("ord", "e")).select("ord", "e.*")


def example_list(examples: DataFrame) -> DataFrame:
    """id and name of all examples, in order."""
    return examples.orderBy("ord").select("id", "name")


def example_by_id(examples: DataFrame, wanted: str) -> DataFrame:
    """The example with an id, the last if several have it; no row if none has."""
    return examples.where(F.col("id") == wanted).orderBy(F.col("ord").desc()).limit(1).select("id", "name", "layers")

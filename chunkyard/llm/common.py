"""Shared plumbing: table access, scratch tables, word hashing, id filters."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager, suppress
from typing import ClassVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most ids that keep_ids() broadcasts; beyond it the ids are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of text of a rule base that small() broadcasts at most.
BROADCAST_BYTES = 8_000_000
#: Rows and bytes of an Arrow batch that a function works on.
BATCH_ROWS, BATCH_BYTES = 1000, 8_000_000
#: Rows of one file of a table that is known to be small.
FILE_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; one of our own only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="chunkyard-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def small(df: DataFrame, size: int) -> DataFrame:
    """df, made from `size` bytes on the driver, as a broadcast side; beyond BROADCAST_BYTES the join shuffles."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


class Scratch:
    """Parquet tables in the shared checkpoint folder: they cut lineage, survive the loss of
    executors, and go when dropped, at the end of a scope() that they were made in, or else when the driver's JVM ends."""

    _made: ClassVar[list[Scratch] | None] = None  # in the innermost scope

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/chunkyard-{uuid.uuid4().hex}"
        self.saved = 0
        fs, p = self._fs(self.root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        if Scratch._made is not None:
            Scratch._made.append(self)

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def save(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """df, written and read again. rows: a bound of its rows, if known, and if rows are short: they are dealt over as
        few files as they need, after tasks as many as they were made in."""
        path = f"{self.root}/{self.saved}"
        self.saved += 1
        if rows is not None:
            df = df.repartition(max(self.spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            fs, p = self._fs(df._scratch_path)
            fs.delete(p, True)

    def close(self) -> None:
        fs, p = self._fs(self.root)
        fs.delete(p, True)
        fs.cancelDeleteOnExit(p)

    @classmethod
    @contextmanager
    def scope(cls):
        """At its end the tables go that operators made within: what they returned must have been written by then."""
        before = cls._made
        cls._made = made = []
        try:
            yield
        finally:
            cls._made = before
            for tmp in made:
                tmp.close()


def slices(batch: pa.RecordBatch):
    """The batch in parts of at most BATCH_ROWS rows and about BATCH_BYTES, one row at least."""
    step = max(1, min(BATCH_ROWS, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
    return (batch.slice(i, step) for i in range(0, batch.num_rows, step))


def _trim() -> None:
    """Unused memory goes back, as workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError, TypeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: What a worker keeps from task to task of one operator, by the operator's name; a task of another one drops it.
kept: dict[str, dict] = {}


def _drop_others(keep: str) -> None:
    """A function of the module, as what is pickled with a closure would see a copy of `kept`."""
    for other in kept.keys() - {keep}:
        del kept[other]


def arrow_map(df: DataFrame, function, schema, keep: str = "") -> DataFrame:
    """mapInArrow with batches cut by rows and bytes: texts are long, and what is made of them is longer.
    At the end of a partition unused memory goes back. The caller's settings aren't touched; how large the batches are
    that Spark sends is the session's affair, see chunkyard.shipping. keep: the name under which the function uses `kept`."""

    def run(batches):
        _drop_others(keep)
        yield from function(part for b in batches for part in slices(b))
        _trim()

    return df.mapInArrow(run, schema)


def few(ids: DataFrame) -> DataFrame:
    """ids as a side that is broadcast only if a count finds at most BROADCAST_IDS rows, else joined by shuffle."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids.hint("shuffle_hash")


def keep_ids(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """df's rows whose column is (left_semi) or isn't (left_anti) among ids, one column of that
    name."""
    return df.join(few(ids), column, how)


GOLD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, kept for up to `most` words and then begun anew."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, cut at blanks and the controls 9 to 13; null gives none."""
    return (text or b"").lower().split()


def word_hashes(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words; fewer words make one run."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    with np.errstate(over="ignore"):
        run = mix(hashes[: n - width + 1] + np.uint64(GOLD * width & MASK))
        for i in range(1, width):
            run = mix(run * np.uint64(0xD6E8FEB86659FD93) + hashes[i : n - width + 1 + i])
    return np.unique(run)

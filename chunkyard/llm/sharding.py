"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkyard.llm.common import Scratch

#: Light groups that one task differences, partial partitions that one task combines, and rows in one run of slots, on
#: average; a group is heavy above this part of all bytes, or above one in SHARE of a chunk's bytes for a shard if that is less.
CHUNK, FAN, RUN, HEAVY, SHARE = 20_000, 500, 50_000, 10_000, 10


def difference(weights: list[int], shards: int, start: list[int] | None = None) -> tuple[list[int], list[int]]:
    """Karmarkar-Karp: each weight is a partial partition of `shards` sums; the two with the largest spread
    (largest minus smallest sum; ties: the earlier) are combined, the one's largest sums on the other's
    smallest, until one is left. start: sums that the shards have already; its places are then the shards'
    numbers. Returns the shards' sums and each weight's shard."""
    n = len(weights)
    sums = {i: [w] + [0] * (shards - 1) for i, w in enumerate(weights)}
    heap = [(-w, i) for i, w in enumerate(weights)]
    base = sorted(range(shards), key=lambda s: -start[s]) if start else list(range(shards))
    if start or not n:
        sums[n] = [start[s] for s in base] if start else [0] * shards
        heap.append((sums[n][-1] - sums[n][0], n))
    heapq.heapify(heap)
    parents: dict[int, tuple] = {}
    new = n + 1
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = [x + y for x, y in zip(sums.pop(a), reversed(sums.pop(b)), strict=True)]
        order = sorted(range(shards), key=total.__getitem__, reverse=True)
        sums[new] = [total[s] for s in order]
        parents[new] = (a, b, order)
        heapq.heappush(heap, (sums[new][-1] - sums[new][0], new))
        new += 1
    top = heap[0][1]
    at = {top: list(range(shards))}  # a partition's places -> the last one's
    for node in range(top, n, -1):
        if node in parents:
            a, b, order = parents[node]
            back = [0] * shards
            for where, s in enumerate(order):
                back[s] = at[node][where]
            at[a], at[b] = back, back[::-1]
            del at[node]
    shard = list(range(shards))
    if start:
        for place, s in zip(at[n], base, strict=True):
            shard[place] = s
    out = [0] * shards
    for place, w in enumerate(sums[top]):
        out[shard[place]] = w
    return out, [shard[at[i][0]] for i in range(n)]


def combine(sums: list[int], parts: dict[int, list[int]]) -> list[tuple[int, int, int]]:
    """Differences partial partitions on top of `sums`: the part with the largest spread first (ties: the lesser
    number), its largest sums on the smallest so far. Returns (part, its place, shard)."""
    sums, out = list(sums), []
    for c in sorted(parts, key=lambda c: (min(parts[c]) - max(parts[c]), c)):
        part = parts[c]
        places = sorted(range(len(sums)), key=lambda s: -part[s])
        for place, s in zip(places, sorted(range(len(sums)), key=sums.__getitem__), strict=True):
            out.append((c, place, s))
            sums[s] += part[place]
    return out


def _deal(shards: int, start: list[int]):
    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["w", "g"], ascending=[False, True], kind="stable")
        return pd.DataFrame({"g": t["g"], "part": t["part"], "place": difference(t["w"].tolist(), shards, start)[1], "w": t["w"]})

    return run


def _combine(shards: int, start: list[int]):
    def run(t: pd.DataFrame) -> pd.DataFrame:
        parts: dict[int, list[int]] = {}
        for c, place, w in zip(t["part"].tolist(), t["place"].tolist(), t["w"].tolist(), strict=True):
            parts.setdefault(c, [0] * shards)[place] = w
        rows = [(c, place, int(t["upper"].iloc[0]), s, parts[c][place]) for c, place, s in combine(start, parts)]
        return pd.DataFrame(rows, columns=["part", "place", "upper", "shard", "w"])

    return run


def byte_shards(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; law is `bytes`.

    A row's size is its text's UTF-8 bytes (null: none) plus `overhead`. Rows with equal texts are one
    indivisible group (null counts as empty). One differencing tree at all sizes, however many chunks there are: groups
    that are light against a chunk's bytes for a shard are dealt by hash into chunks; the heavy ones, less than half as
    many, are dealt first in the same way, until one chunk holds them all. Each chunk is differenced, on top of its part
    of the heavier groups' sums, to one partial partition; up to FAN partial partitions are combined to one in the same
    way, and so on until one is left. Chunks need not wait for one another, light groups make up for heavy ones, and what
    chunks leave uneven doesn't add up. slot numbers a shard's rows from 0 without gaps, in the order of a
    hash run, then doc_id (nulls first); which of equal rows comes first is free. An empty table gives no rows; other
    columns are ignored.
    """
    tmp = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("g")
    )
    rows = tmp.save(rows)
    groups = tmp.save(rows.groupBy("g").agg(F.sum("size").alias("w")))

    levels, rest = [], groups
    while True:
        count, total = rest.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
        n = max(1, -(-count // CHUNK))
        if n == 1:  # a single chunk holds them all
            levels.append((rest, 1))
            break
        limit = total // min(max(HEAVY, SHARE * shards * n), count // 2)
        levels.append((rest.where(F.col("w") <= limit), n))
        rest = rest.where(F.col("w") > limit)
    sums, where = [0] * shards, None
    for some, n in reversed(levels):
        chunks = some.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(n)).cast("int")).groupBy("part")
        placed = tmp.save(chunks.applyInPandas(_deal(shards, [s // n for s in sums]), "g binary, part int, place int, w long"))
        parts, to = placed.groupBy("part", "place").agg(F.sum("w").alias("w")), placed.select("g", "part", "place")
        while True:
            n = -(-n // FAN)
            upper = parts.withColumn("upper", F.pmod(F.xxhash64("part"), F.lit(n)).cast("int")).groupBy("upper")
            above = tmp.save(upper.applyInPandas(_combine(shards, [s // n for s in sums]), "part int, place int, upper int, shard int, w long"))
            to = to.join(above.select("part", "place", "upper", "shard"), ["part", "place"]).select("g", F.col("upper").alias("part"), F.col("shard").alias("place"))
            parts = above.groupBy(F.col("upper").alias("part"), F.col("shard").alias("place")).agg(F.sum("w").alias("w"))
            if n == 1:
                break
        for r in parts.collect():  # a row a shard
            sums[r.place] += r.w
        part = to.select("g", F.col("place").alias("shard"))
        where = part if where is None else where.union(part)
    dealt = tmp.save(rows.join(where, "g").select("doc_id", "size", "text_crc32", "shard"))
    runs = max(1, -(-dealt.count() // (RUN * shards))) * 4
    dealt = dealt.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs)))
    counts = dealt.groupBy("shard", "run").agg(F.count("*").alias("k"))  # shards x runs rows
    before = counts.select("shard", "run", (F.sum("k").over(Window.partitionBy("shard").orderBy("run")) - F.col("k")).alias("before"))
    order = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    out = dealt.withColumn("rank", F.row_number().over(order) - 1).join(before, ["shard", "run"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

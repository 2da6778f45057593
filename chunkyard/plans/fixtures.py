"""Voxel tables derived from the driver's tables, in Spark and as SQL. The number of chunks grows with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkyard.operators.grids import apply_log


#: Orders and users whose rows write to one chunk.
ORDERS, USERS = 250, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def li_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, idx, color, at): a write for each line item; `at` orders the writes."""
    t = table(spark, sf_dir, "lineitem")
    color = F.when(F.col("l_returnflag") == "R", 0).otherwise(F.floor("l_quantity") % 63 + 1)
    idx = (F.col("l_partkey") * 31 + F.col("l_suppkey") * 257 + F.col("l_linenumber") * 7 + F.col("l_orderkey") * 13) % 4096
    return t.select(F.expr(f"l_orderkey div {ORDERS}").alias("chunk_id"), idx.cast("int").alias("idx"), color.cast("int").alias("color"), F.struct("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("at"))


def ev_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    color = F.when(F.col("event_type") == "error", 0).otherwise(F.floor("value") % 63 + 1)
    return t.select(F.expr(f"user_id div {USERS}").alias("chunk_id"), (F.col("event_id") * 7919 % 4096).cast("int").alias("idx"), color.cast("int").alias("color"), F.struct("ts", "event_id").alias("at"))


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_log(li_log(spark, sf_dir), F.col("at"))


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_log(ev_log(spark, sf_dir), F.col("at"))


_LI = f"""li_log AS (SELECT l_orderkey // {ORDERS} AS chunk_id, CAST((l_partkey*31 + l_suppkey*257 + l_linenumber*7 + l_orderkey*13) % 4096 AS INT) AS idx,
  CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(floor(l_quantity) AS BIGINT) % 63 + 1 END AS INT) AS color,
  row_number() OVER (PARTITION BY l_orderkey // {ORDERS}, (l_partkey*31 + l_suppkey*257 + l_linenumber*7 + l_orderkey*13) % 4096 ORDER BY l_shipdate DESC, l_orderkey DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC) AS age FROM lineitem)"""
_EV = f"""ev_log AS (SELECT user_id // {USERS} AS chunk_id, CAST((event_id*7919) % 4096 AS INT) AS idx,
  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS BIGINT) % 63 + 1 END AS INT) AS color,
  row_number() OVER (PARTITION BY user_id // {USERS}, (event_id*7919) % 4096 ORDER BY ts DESC, event_id DESC) AS age FROM events)"""


def _live(name: str) -> str:
    return f"{name} AS (SELECT chunk_id, idx, idx & 15 AS x, (idx >> 4) & 15 AS y, idx >> 8 AS z, color FROM {name}_log WHERE age = 1 AND color <> 0)"


#: Common table expressions li_log, li, ev_log and ev of the SQL.
VIEWS = ", ".join((_LI, _live("li"), _EV, _live("ev")))

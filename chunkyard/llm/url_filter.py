"""URL rules: host-suffix and path-prefix expressions, short hash prefixes, full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict); fixed values of the production query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the hash prefix that is joined on.
PREFIX = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def url_verdicts(pages: DataFrame, rules=RULES, *, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    rules: a sequence of (host, path, verdict) with non-empty hosts. A rule fits its host and all
    subdomains if the path starts with the rule's. The longest fitting host + path wins, of equally long
    ones the first in code-point order, of equal ones block. Without a rule: null and the default.
    A URL is expanded only to as many host labels and path characters as some rule has, so a row has
    at most (label counts) x (path lengths) expressions, however long the URL is. The rule table is
    broadcast only if its measured size is below the broadcast threshold; beyond it the same equi-join shuffles. An empty
    table gives no rows; without rules every row has the default. Rows are independent: null or repeated ids and other
    columns don't matter.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    # The row number stands in for page_id, which may be null or repeated.
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    labels = sorted({r[0].count(".") + 1 for r in rules})
    lengths = sorted({len(r[1]) for r in rules})
    digest = lambda c: F.sha2(c, 256)
    table = spark.createDataFrame([(f"{h}{p}", v, len(h + p)) for h, p, v in rules], "rule string, verdict string, size int") if rules else spark.createDataFrame([], "rule string, verdict string, size int")
    table = table.groupBy("rule", "size").agg(F.max("verdict").alias("verdict"))  # block > allow
    table = table.select("rule", "verdict", "size", digest(F.col("rule")).alias("digest")).withColumn("prefix", F.substring("digest", 1, PREFIX))
    suffixes = F.array_distinct(F.array(*(F.substring_index("host", ".", -n) for n in labels))) if rules else F.array().cast("array<string>")
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    # Equal (host, path) pairs are judged once.
    sites = base.select("host", "path").distinct()
    expressions = sites.select("host", "path", F.explode(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))).alias("expression"))
    hashed = expressions.select("host", "path", digest(F.col("expression")).alias("d")).withColumn("prefix", F.substring("d", 1, PREFIX))
    hits = hashed.join(table, "prefix").where(F.col("d") == F.col("digest"))
    best = hits.groupBy("host", "path").agg(F.min(F.struct((-F.col("size")).alias("size"), "rule", "verdict")).alias("best"))
    judged = base.join(best, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

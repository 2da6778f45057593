"""Updates as JSON, and layered examples as rows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkyard.functions.index import update_index
from chunkyard.model import CELLS

UPDATES = "map<string,map<string,int>>"


def parse_updates(docs: DataFrame, column: str = "json", first_only: bool = False) -> DataFrame:
    """docs's other columns and chunk (string), idx, color of each write in {chunk: {index: color}}. What isn't such a
    map is an error, and so is an index that isn't a number. Indices beyond the chunk are dropped, colors held to
    0..255. first_only: the least chunk of each text. Of texts for one index the greatest color counts, within a text and
    between texts whose other columns are equal: give texts a column that tells them apart if they are to stay apart."""
    rest = [c for c in docs.columns if c != column]
    m = F.from_json(F.col(column), UPDATES)
    m = F.when(m.isNull(), F.raise_error(F.lit("not an updates map")).cast(UPDATES)).otherwise(m)
    if first_only:
        docs = docs.withColumn(column, m)
        least = F.array_min(F.map_keys(F.col(column)))
        m = F.map_filter(F.col(column), lambda k, _: k == least)
    chunks = docs.select(*rest, F.explode(m).alias("chunk", "cells"))
    cells = chunks.select(*rest, "chunk", F.explode("cells").alias("k", "color"))
    idx = F.when(F.col("k").rlike(r"^\s*[+-]?\d+"), F.regexp_extract("k", r"^\s*([+-]?\d+)", 1).cast("long")).otherwise(F.raise_error(F.concat(F.lit("not an index: "), F.col("k"))).cast("long"))
    color = F.when(F.col("color").isNull(), F.raise_error(F.lit("a color is missing")).cast("int")).otherwise(F.greatest(F.least("color", F.lit(255)), F.lit(0)))
    out = cells.select(*rest, "chunk", idx.alias("idx"), color.alias("color")).where(F.col("idx").between(0, CELLS - 1))
    return out.groupBy(*rest, "chunk", F.col("idx").cast("int").alias("idx")).agg(F.max("color").alias("color"))


def parse_updates_lenient(docs: DataFrame, column: str = "json") -> DataFrame:
    """As a browser reads them: the first chunk only, an index that isn't a number is 0, colors as they are."""
    pairs = F.from_json(F.col(column), UPDATES)
    first = docs.select(F.element_at(F.map_entries(pairs), 1).alias("e"))
    cells = first.select(F.col("e.key").alias("chunk"), F.explode(F.col("e.value")).alias("k", "color"))
    idx = F.coalesce(F.expr("try_cast(trim(k) as double)"), F.lit(0)).cast("int")
    return cells.select("chunk", idx.alias("idx"), "color").where(F.col("idx").between(0, CELLS - 1))


def write_updates(cells: DataFrame, chunk: Column | None = None) -> DataFrame:
    """chunk_id and json, {chunk: {index: color}} with ascending indices, of each chunk's voxels."""
    chunk = F.col("chunk_id").cast("string") if chunk is None else chunk
    pairs = F.sort_array(F.collect_list(F.struct("idx", "color")))
    body = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p.idx.cast("string"), p.color)))
    return cells.groupBy("chunk_id").agg(body.alias("m")).select("chunk_id", F.to_json(F.create_map(chunk, F.col("m"))).alias("json"))


def parse_row(row: Column) -> Column:
    """16 colors of a row of text: tokens between commas and blanks (0..63, anything else 0), or one digit a cell."""
    tokens = F.filter(F.split(row, r"[,\s]+"), lambda t: t != "")
    number = lambda t: F.coalesce(F.regexp_extract(t, r"^([+-]?\d{1,9})", 1).try_cast("int"), F.lit(0))
    listed = F.transform(tokens, lambda t: F.when(number(t).between(0, 63), number(t)).otherwise(0))
    digits = F.transform(F.split(F.rpad(F.coalesce(row, F.lit("")), 16, "0"), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    values = F.when(row.rlike(r"[,\s]"), listed).otherwise(digits)
    return F.slice(F.concat(values, F.array_repeat(F.lit(0), 16)), 1, 16)


def decode_layers(examples: DataFrame) -> DataFrame:
    """id, idx, x, y, z, color of examples given as (id, layers[y][z] = row over x). Layers and rows beyond the 16th are
    ignored, missing ones empty."""
    rows = examples.select("id", F.posexplode("layers").alias("y", "rows")).where("y < 16").select("id", "y", F.posexplode("rows").alias("z", "row")).where("z < 16 and row is not null")
    cells = rows.select("id", "y", "z", F.posexplode(parse_row(F.col("row"))).alias("x", "color")).where("color <> 0")
    return cells.select("id", update_index(F.col("x"), F.col("y"), F.col("z")).alias("idx"), "x", "y", "z", "color")

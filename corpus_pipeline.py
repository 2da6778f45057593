"""A training-data pipeline over documents: quality, toxicity, near duplicates, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir); all but the last keep or drop whole rows and return the columns of
documents. The last returns a row for each document that is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chunkyard.llm import toxicity
from chunkyard.llm.common import Scratch, table
from chunkyard.llm.decontaminate import drop_contaminated
from chunkyard.llm.near_dedup import drop_near_duplicates
from chunkyard.llm.piece_tokens import piece_codes
from chunkyard.llm.quality import fit_quality_rows, keep_quality, labelled_rows
from chunkyard.shipping import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without what the classifier, fitted on all of docs' labelled rows that aren't held out, rejects. Null and empty texts are scored as empty,
    a score of just 0.5 stays, repeated rows stay or go together, an empty table stays empty."""
    ship(spark)
    return keep_quality(docs, fit_quality_rows(labelled_rows(docs, table(spark, sf_dir, "labels"), "quality")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that are likelier toxic than not, by all of docs' labelled rows that aren't held out. Null and empty texts stay, repeated rows stay or go together,
    an empty table stays empty."""
    ship(spark)
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity_rows(labelled_rows(docs, table(spark, sf_dir, "labels"), "toxic")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the smallest doc_id of each group of near copies (five words, 0.8). Null and empty texts and rows without
    an id stay; rows that repeat an id and a text are one document; an empty table stays empty."""
    ship(spark)
    return drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark item at half of its best score. Null and empty texts stay, an empty
    benchmark drops nothing, repeated rows stay or go together, an empty table stays empty."""
    ship(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, counts, digests, decoded text and ids of every row; null and empty texts have no ids, repeated rows each give
    theirs, an empty table gives none."""
    ship(spark)
    return piece_codes(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("tokens", tokens_stage),
]
#: Classifiers and tokenisers have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents; between stages, Parquet in the shared checkpoint folder. What a stage made
    for itself, and what it read, goes when its result is written."""
    tmp = Scratch(spark)
    docs, read = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with Scratch.scope():
            docs = tmp.save(stage(spark, docs, sf_dir))
        if read is not None:
            tmp.drop(read)
        read = docs
    return docs

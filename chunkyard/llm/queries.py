"""The thin queries of the operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chunkyard.llm import toxicity
from chunkyard.llm.common import table
from chunkyard.llm.decontaminate import contaminated
from chunkyard.llm.gif_media import payload_media
from chunkyard.llm.html_extract import page_texts
from chunkyard.llm.licenses import license_matches, license_sql
from chunkyard.llm.near_dedup import near_duplicates
from chunkyard.llm.piece_tokens import piece_codes
from chunkyard.llm.quality import fit_quality, labelled_sample, quality_scores
from chunkyard.llm.sharding import byte_shards
from chunkyard.llm.url_filter import LOWER, RULES, UPPER, url_verdicts

MODEL = "piece_bpe_32k.model"


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload_media(table(spark, sf_dir, "documents"), keep_media=False)


def op4_kk_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", toxicity.FIT_ROWS)
    return toxicity.toxicity_scores(docs, toxicity.fit_toxicity(sample))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op9_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codes(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL), keep_ids=False)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_decontaminate, op3_gif_media, op4_kk_shards, op5_quality, op6_toxicity, op7_url_filter, op8_near_dedup, op9_piece_tokens, op10_licenses)}

_rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE_SQL = {
    "op7_url_filter": rf"""
WITH rules(rhost, rpath, verdict) AS (VALUES {_rules}),
u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
fit AS (SELECT s.host, s.path, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY s.host, s.path ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS rn
        FROM (SELECT DISTINCT host, path FROM s) s JOIN rules ON (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath))
SELECT s.page_id, s.host, s.path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN fit ON s.host = fit.host AND s.path = fit.path AND rn = 1""",
    "op8_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) = 1 THEN [l[1]] ELSE list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(doc_id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT q.o, r.low FROM r JOIN (SELECT a AS i, b AS o FROM e UNION ALL SELECT b, a FROM e) q ON q.i = r.doc_id WHERE r.low < q.o),
m AS (SELECT doc_id, min(low) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.doc_id = d.doc_id""",
    "op10_licenses": license_sql(),
}

"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for each operator."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chunkyard.llm import toxicity
from chunkyard.llm.decontaminate import contaminated, drop_contaminated
from chunkyard.llm.gif_media import payload_media
from chunkyard.llm.html_extract import page_texts
from chunkyard.llm.licenses import license_matches
from chunkyard.llm.near_dedup import drop_near_duplicates, near_duplicates
from chunkyard.llm.piece_tokens import piece_codes
from chunkyard.llm.quality import fit_quality, keep_quality, labelled_sample, quality_scores
from chunkyard.llm.sharding import byte_shards
from chunkyard.llm.url_filter import url_verdicts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = "word another " * 60_000 + "Released under the MIT License."
TEXTS = [(1, "a few plain words here"), (1, "a few plain words here"), (2, None), (3, ""), (None, "text without an id"), (None, None), (4, LONG), (5, " \n\t "), (6, "a few plain words here"), (7, "\u2581 \U0001f600 \x00 é\r\n")]
DOCS = "doc_id long, text string"


def docs(spark, rows=TEXTS):
    """documents, with columns named like the operators' own."""
    df = spark.createDataFrame(rows, DOCS)
    extra = {c: F.lit(None).cast("string") for c in ("lang", "source", "n", "fp", "score", "kept", "nid", "key", "shard", "size", "row", "pos", "how", "g", "license", "text_crc32", "item_id")}
    return df.withColumns(extra).withColumn("n_chars", F.length("text").cast("long"))




def filler(i):
    r = random.Random(i)
    return ["".join(r.choices("bcdfghklmnoprtvw", k=7)) for _ in range(12)]


CLEAN = [(i, ". ".join(filler(i)), 0) for i in range(0, 120, 2)]
FOUL = [(i, " ".join([*filler(i), *("idiot", "scum", "idiot", "scum")[i // 2 % 2 : i // 2 % 2 + 1 + i // 4 % 3]]), 1) for i in range(1, 120, 2)]

OPERATORS = {
    "near": lambda d, s: near_duplicates(d),
    "tokens": lambda d, s: piece_codes(d, MODEL),
    "media": lambda d, s: payload_media(d),
    "shards": lambda d, s: byte_shards(d),
    "quality": lambda d, s: quality_scores(d, fit_quality([])),
    "toxicity": lambda d, s: toxicity.toxicity_scores(d, toxicity.fit_toxicity([])),
    "fitted quality": lambda d, s: quality_scores(d, fit_quality([(i, t, 1 - y) for i, t, y in CLEAN + FOUL])),
    "fitted toxicity": lambda d, s: toxicity.toxicity_scores(d, toxicity.fit_toxicity(CLEAN + FOUL)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, name):
    got = OPERATORS[name](docs(spark), spark)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.select("doc_id").collect()) == sorted((i is None, i or 0) for i, _ in TEXTS)
    empty = OPERATORS[name](docs(spark, []), spark)
    assert empty.count() == 0 and empty.schema == got.schema


@pytest.mark.parametrize("name", OPERATORS)
def test_order_and_partitions_do_not_matter(spark, name):
    rows = [t for t in TEXTS if t[0] is not None]
    cols = [c for c in OPERATORS[name](docs(spark, rows), spark).columns]
    a = OPERATORS[name](docs(spark, rows).repartition(1), spark).select(cols).collect()
    b = OPERATORS[name](docs(spark, rows[::-1]).repartition(5), spark).select(cols).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_near(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs(spark), shingle=2).collect()}
    assert {(1, 4, 1, True), (6, 4, 1, False), (2, 0, 2, True), (3, 0, 3, True), (5, 0, 5, True), (None, 3, None, True), (None, 0, None, True)} <= got
    left = drop_near_duplicates(docs(spark))
    assert left.columns == docs(spark).columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 1, 2, 3, 4, 5, 7]


def test_ids_that_repeat_with_other_texts(spark):
    a, b, c = ("the first of three texts is here", "a second one that has other words", "and the third is unlike both of them")
    rows = [(3, b), (5, a), (5, b), (7, a), (7, c), (7, c), (8, c)]
    d = docs(spark, rows)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(d).collect())
    assert got == sorted([(3, 3, True), (5, 5, True), (5, 3, False), (7, 5, False), (7, 7, True), (7, 7, True), (8, 7, False)])
    left = drop_near_duplicates(d)
    assert left.schema == d.schema
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted([(3, b), (5, a), (7, c), (7, c)])


def test_media(spark):
    got = {r.doc_id: r for r in payload_media(docs(spark)).where("doc_id is not null").collect()}
    assert got[2].n_bytes == 0 and got[2].payload_bytes == 64 and got[2].media_sha256 == got[3].media_sha256
    assert got[4].payload_bytes % 64 == 0 and got[4].n_bytes == len(LONG.encode())
    assert got[1].media == got[6].media and got[1].feature == got[6].feature


def test_shards(spark):
    got = byte_shards(docs(spark), 3).collect()
    assert len({r.shard for r in got if r.size == 16 + 22}) == 1  # equal texts
    assert len({r.shard for r in got if r.size == 16}) == 1  # null and empty texts
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_classifiers_keep_columns(spark):
    d = docs(spark)
    quality, toxic = fit_quality([(1, "good text", 1), (2, "bad", 0)] * 3), toxicity.fit_toxicity([])
    assert keep_quality(d, quality).schema == d.schema
    kept = toxicity.drop_toxic(d, toxic)
    assert kept.schema == d.schema and kept.count() == len(TEXTS)


def test_fitted_classifiers(spark):
    rows = [*TEXTS, (20, "you scum"), (21, "YOU SCUM!"), (21, "YOU SCUM!"), (None, "idiot scum idiot"), (22, "a fine sentence about nothing"), (23, "scum " * 40_000)]
    model = toxicity.fit_toxicity(CLEAN + FOUL)
    got = [(r.doc_id, r.toxic) for r in toxicity.toxicity_scores(docs(spark, rows), model).collect()]
    assert sorted(i or 0 for i, t in got if t) == [0, 20, 21, 21, 23]
    left = toxicity.drop_toxic(docs(spark, rows), model)
    assert left.count() == len(rows) - 5 and left.schema == docs(spark).schema
    good = fit_quality([(i, t, 1 - y) for i, t, y in CLEAN + FOUL])
    scores = {r.doc_id: r.score for r in quality_scores(docs(spark, [(1, CLEAN[0][1]), (2, FOUL[0][1]), (3, None), (4, "")]), good).collect()}
    assert scores[1] > 0.5 > scores[2] and scores[3] == scores[4]


def test_sample_takes_no_held_out_row(spark):
    import zlib

    d = spark.createDataFrame([(i, f"text {i}") for i in range(60)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = labelled_sample(d, labels, "quality", rows=10)
    assert len(got) == 20 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i, *_ in got)
    assert labelled_sample(d.where("false"), labels, "quality") == []


def test_decontamination(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "only two"), (None, "eleven twelve thirteen fourteen fifteen")], "item_id long, text string")
    d = docs(spark, [*TEXTS, (8, f"x {item} y"), (9, f"x {item} y {item}"), (10, "say Only two, please"), (11, "eleven twelve thirteen fourteen fifteen")])
    got = sorted((r.doc_id, r.item_id or 0) for r in contaminated(d, bench).collect())
    assert got == [(8, 1), (8, 1), (9, 1), (9, 1), (10, 4), (11, 0)]
    left = drop_contaminated(d, bench)
    assert left.schema == d.schema and left.count() == len(TEXTS)
    assert contaminated(d, bench.where("false")).count() == 0 and drop_contaminated(d, bench.where("false")).count() == d.count()
    assert contaminated(d.where("false"), bench).count() == 0


def test_licenses(spark):
    rows = [*TEXTS, (8, "X. Licensed under CC BY 4.0. Y"), (8, "Licensed under CC BY 4.0.\nReleased   under\nthe MIT License."), (9, "RELEASED UNDER THE MIT LICENSE!"), (None, "All rights reserved.")]
    got = {(r.doc_id, r.license, r.n_matches) for r in license_matches(docs(spark, rows)).collect()}
    assert got == {(8, "CC-BY-4.0", 2), (8, "MIT", 1), (9, "MIT", 1), (None, "all-rights-reserved", 1)}
    assert license_matches(docs(spark, [])).count() == 0


def test_pages(spark):
    rows = [(1, "u", "<p>Some text.</p>"), (1, "u", "<p>Some text.</p>"), (2, None, None), (None, "u", ""), (3, "u", "<article>" + "<p>Para.</p>" * 20_000), (4, "u", "<" * 5000), (5, "u", "<div " * 5000), (6, "u", "\x00<b")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(7)).withColumn("n_chars", F.lit("x"))
    got = page_texts(p)
    assert got.count() == len(rows) and all(r.n_chars == len(r.text) for r in got.collect())
    assert {r.text for r in got.where("page_id = 1").collect()} == {"Some text."}
    assert page_texts(p.where("false")).count() == 0


def test_urls(spark):
    rows = [(1, "http://A.Example.ORG/es/x"), (2, None), (None, "no scheme"), (3, "x://com/fr/"), (3, "x://com/fr/"), (4, "x://example.org?/es/"), (5, "x://" + "a." * 3000 + "com/de/" + "p" * 9000), (6, "x://xcom/de/"), (7, "x://example.org/en/1#f"), (8, "")]
    p = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit(2))
    got = {(r.page_id, r.rule, r.verdict) for r in url_verdicts(p).collect()}
    assert got == {(1, "example.org/es/", "block"), (2, None, "allow"), (None, None, "allow"), (3, "com/fr/", "allow"), (4, None, "allow"), (5, "com/de/", "block"), (6, None, "allow"), (7, "example.org/en/1", "block"), (8, None, "allow")}
    assert url_verdicts(p).count() == len(rows) and url_verdicts(p.where("false")).count() == 0
    tie = url_verdicts(p.where("page_id = 3"), [("com", "/fr/", "allow"), ("com", "/fr/", "block")]).first()
    assert tie.verdict == "block" and url_verdicts(p, [], default="block").where("verdict = 'block'").count() == len(rows)


def test_pipeline_of_awkward_rows(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of the kind is in there")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[0] == "doc_id"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).where("false").write.parquet(str(tmp_path / f"none/{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0

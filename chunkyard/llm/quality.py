"""Quality by compression: zstandard with a dictionary of good and one of bad labelled text."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkyard.llm.common import Scratch, arrow_map, few

#: The bounded sample: labelled rows of either class, in the order of a hash of doc_id, and the longest text taken for it.
FIT_ROWS, FIT_CHARS = 2500, 30_000
#: Bytes of either dictionary, the compression level, folds that calibrate on text the dictionary hasn't seen.
DICT_BYTES, LEVEL, FOLDS = 400_000, 3, 4
#: About how many bytes of text one task makes a digest of, and how many digests are made one at a time.
LEAF_BYTES, FAN = 8_000_000, 16


def learnable(doc_id: Column) -> Column:
    """True for rows that may be learned from; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def _known(labels: DataFrame, column: str) -> DataFrame:
    known = labels.select("doc_id", F.col(column).alias("label")).where(F.col("label").isin(0, 1) & learnable(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))


def labelled_rows(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """doc_id, text, label of every row with label 0 or 1 that isn't held out, whole. Null labels, ids and texts aren't
    learned from; of rows that repeat an id the least text and label count."""
    text = docs.select("doc_id", "text").where("text is not null")
    return text.join(few(_known(labels, column)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of at most `rows` rows of each of the labels 0 and 1, none held out.

    The ids are chosen by hash before any text is read. FIT_ROWS and FIT_CHARS bound the labelled rows that are learned
    from, and nothing else: every row is scored, whole. Null labels, ids and texts aren't learned from; of rows that
    repeat an id the least text and label count; empty tables give an empty sample.
    """
    known = _known(labels, column)
    order = [F.xxhash64("doc_id", F.lit(7)), "doc_id"]
    chosen = known.where("label = 0").orderBy(*order).limit(rows).union(known.where("label = 1").orderBy(*order).limit(rows))
    text = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= chars))
    got = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).collect()
    return sorted(((r.doc_id, r.text, r.label) for r in got), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))


class QualityModel:
    """Two dictionaries and a logistic calibration of the normalised size difference."""

    def __init__(self, good: bytes, bad: bytes, weights: list[float], centre: list[float], scale: list[float]):
        self.good, self.bad, self.weights, self.centre, self.scale = good, bad, np.array(weights), np.array(centre), np.array(scale)
        self._two = None

    def __getstate__(self):
        return self.__dict__ | {"_two": None}

    def features(self, text: bytes) -> list[float]:
        if self._two is None:
            self._two = compressors(self.good, self.bad)
        a, b = (len(c.compress(text)) for c in self._two)
        return size_features(a, b, len(text))

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        x = expand((np.array(rows).reshape(-1, 3) - self.centre) / self.scale)
        z = (x * self.weights).sum(axis=1)  # row by row: a product of matrices rounds by the number of rows
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def compressors(good: bytes, bad: bytes):
    out = []
    for d in (good, bad):
        d = zstandard.ZstdCompressionDict(d)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    return out


def size_features(a: int, b: int, n: int) -> list[float]:
    """The normalised difference, the length, the mean ratio."""
    return [(a - b) / (a + b), math.log(n + 1), (a + b) / (2 * (n + 16))]


def expand(x: np.ndarray) -> np.ndarray:
    """Second-order terms; values beyond 4 standard deviations of the sample count as 4."""
    x = np.clip(x, -4, 4)
    d, n, r = x.T
    return np.stack([np.ones_like(d), d, n, r, d * n, d * r, n * r, d * d, n * n, r * r], 1)


def dictionary(texts: list[bytes], size: int) -> bytes:
    """Trained on pieces of 2,000 bytes; the texts themselves where there are too few to train on."""
    pieces = [t[i : i + 2000] for t in texts for i in range(0, len(t), 2000)]
    pieces = [p for p in pieces if len(p) > 8]
    size = min(size, max(1024, sum(map(len, pieces)) // 2))
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:].rjust(8)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge-penalised Newton steps, halved until the loss falls."""
    w = np.zeros(x.shape[1])

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + ridge / 2 * w @ w

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        t, now = 1.0, loss(w)
        while t > 1e-4 and loss(w - t * step) > now:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-6:
            break
    return w


def fit_quality(sample: list[tuple[int, str, int]], size: int = DICT_BYTES) -> QualityModel:
    """Dictionaries of the sample; the calibration is fitted on sizes under dictionaries of the other folds."""
    texts, y = [t.encode() for _, t, _ in sample], np.array([q for *_, q in sample], float)
    if len(set(y)) < 2:  # nothing to tell apart: a constant score
        return constant(y.sum(), len(y))
    fold = np.empty(len(y), int)
    for q in (0, 1):
        at = np.flatnonzero(y == q)
        fold[at] = np.arange(len(at)) % FOLDS
    rows = np.zeros((len(y), 3))
    for k in range(FOLDS):
        part = [dictionary([t for t, q, f in zip(texts, y, fold, strict=True) if q == v and f != k], size) for v in (1, 0)]
        two = compressors(*part)
        for i in np.flatnonzero(fold == k):
            rows[i] = size_features(*(len(c.compress(texts[i])) for c in two), len(texts[i]))
    centre, scale = rows.mean(0), rows.std(0) + 1e-9
    weights = logistic(expand((rows - centre) / scale), y)
    return QualityModel(*(dictionary([t for t, q in zip(texts, y, strict=True) if q == v], size) for v in (1, 0)), weights.tolist(), centre.tolist(), scale.tolist())


def constant(good: float, n: float) -> QualityModel:
    """One score for all, where n rows, `good` of them good, tell nothing apart."""
    p = (good + 1) / (n + 2)
    return QualityModel(b" " * 8, b" " * 8, [math.log(p / (1 - p))] + [0.0] * 9, [0.0] * 3, [1.0] * 3)


def digest(texts: list[bytes], size: int) -> list[bytes]:
    """The texts, or what a dictionary keeps of them where they are longer than size."""
    return texts if sum(map(len, texts)) <= size else [dictionary(texts, size)]


def _digests(parts: DataFrame, size: int) -> DataFrame:
    def run(key, group):
        group = group.sort_by([("at", "ascending")])
        texts = digest([t for some in group["texts"].to_pylist() for t in some], size)
        label, fold, leaf = (k.as_py() for k in key)
        return pa.Table.from_arrays([pa.array([label], pa.int32()), pa.array([fold], pa.int32()), pa.array([leaf], pa.int64()), pa.array([leaf], pa.int64()), pa.array([texts], pa.list_(pa.binary()))], names=["label", "fold", "leaf", "at", "texts"])

    return parts.groupBy("label", "fold", "leaf").applyInArrow(run, "label int, fold int, leaf long, at long, texts array<binary>")


def fold_digests(rows: DataFrame, tmp: Scratch, size: int = DICT_BYTES) -> dict[tuple[int, int], list[bytes]]:
    """(label, fold) -> a digest of all its rows (doc_id, text, label, fold): leaves of LEAF_BYTES are digested, their digests
    FAN at a time, and so on until one is left."""
    most = rows.groupBy("label", "fold").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0] or 0
    leaves = max(1, -(-most // LEAF_BYTES))
    leaf = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(leaves))
    parts = tmp.save(_digests(rows.select("label", "fold", leaf.alias("leaf"), F.col("doc_id").cast("long").alias("at"), F.array(F.col("text").cast("binary")).alias("texts")), 2 * size))
    while leaves > 1:
        leaves = -(-leaves // FAN)
        parts = tmp.save(_digests(parts.withColumn("leaf", F.floor(F.col("leaf") / FAN).cast("long")), 2 * size))
    return {(r.label, r.fold): [bytes(t) for t in r.texts] for r in parts.collect()}  # 2 * FOLDS rows of at most 2 * size bytes


def newton(sums, n: int, ridge: float = 1.0) -> np.ndarray:
    """logistic()'s steps, from sums(w): the loss, its gradient and its second derivatives over all rows, without the ridge."""
    w = np.zeros(n)

    def at(w):
        loss, g, h = sums(w)
        return loss + ridge / 2 * w @ w, g + ridge * w, h + ridge * np.eye(n)

    now, g, h = at(w)
    for _ in range(50):
        step, t = np.linalg.solve(h, g), 1.0
        then = at(w - t * step)
        while t > 1e-4 and then[0] > now:
            t /= 2
            then = at(w - t * step)
        w, (now, g, h) = w - t * step, then
        if np.abs(t * step).max() < 1e-6:
            break
    return w


def fit_quality_rows(rows: DataFrame, size: int = DICT_BYTES) -> QualityModel:
    """fit_quality() on all rows (doc_id, text, label) of labelled_rows(), however many: dictionaries of digests of all
    texts, and a calibration on all rows' sizes under dictionaries of the other folds, by sums over tasks."""
    tmp = Scratch(rows.sparkSession)
    rows = tmp.save(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)).cast("int")))
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return constant(n.get(1, 0), sum(n.values()))
    parts = fold_digests(rows, tmp, size)

    def without(k: int) -> tuple[bytes, bytes]:
        good, bad = (dictionary([t for f in range(FOLDS) if f != k for t in parts.get((v, f), ())], size) for v in (1, 0))
        return good, bad

    shared = rows.sparkSession.sparkContext.broadcast([without(k) for k in range(FOLDS)])

    def measure(batches):
        two = {}
        for b in batches:
            out = []
            for t, fold in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if fold not in two:
                    two[fold] = compressors(*shared.value[fold])
                raw = t.as_py().encode()
                out.append(size_features(*(len(c.compress(raw)) for c in two[fold]), len(raw)))
            x = np.array(out, float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(2), *map(pa.array, x.T)], names=["label", "a", "b", "c"])

    sizes = tmp.save(arrow_map(rows.select("text", "fold", "label"), measure, "label int, a double, b double, c double"))
    shared.destroy()
    got = sizes.agg(*(f(c) for f in (F.avg, F.stddev_pop) for c in "abc")).first()
    centre, scale = np.array(got[:3]), np.array(got[3:]) + 1e-9

    def sums(w):
        def part(batches):
            total = np.zeros(111)
            for b in batches:
                y = b.column(0).to_numpy().astype(float)
                x = expand((np.stack([c.to_numpy() for c in b.columns[1:]], 1) - centre) / scale)
                z = x @ w
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                total += np.concatenate([[np.logaddexp(0, z).sum() - y @ z], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        total = sum(np.frombuffer(bytes(r.total)) for r in arrow_map(sizes, part, "total binary").collect())
        return total[0], total[1:11], total[11:].reshape(10, 10)

    weights = newton(sums, 10)
    return QualityModel(*without(-1), weights.tolist(), centre.tolist(), scale.tolist())


def quality_scores(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs's doc_id and text as doc_id, held_out, score, predicted; every row, whole texts.

    Null counts as empty; the empty text has the score that the calibration gives to length 0; a score of just 0.5 is
    predicted 1; an empty table gives no rows. Rows are independent: null or repeated ids and other columns don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICT_BYTES

    def run(batches):
        for b in batches:
            score = shared.value.scores([shared.value.features((t.as_py() or "").encode()) for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(score)], names=["doc_id", "score"])

    scored = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs's rows that the model doesn't reject (score >= 0.5), with all columns. Null counts as empty; each row is judged
    by itself, so repeated rows stay or go together; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            score = shared.value.scores([shared.value.features((t.as_py() or "").encode()) for t in b.column(at)])
            yield b.filter(pa.array(score >= 0.5))

    return arrow_map(docs, run, docs.schema)

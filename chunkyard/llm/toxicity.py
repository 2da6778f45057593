"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkyard.llm.common import GOLD, MASK, Scratch, WordHashes, arrow_map, few, keep_ids, mix, shingle_set, word_hashes, words_of
from chunkyard.llm.near_dedup import band_keys, super_min_hash

#: Features kept for the regression, the fewest toxic sample rows that hold a feature, how many times likelier it is in them at least,
#: by rows and by words.
FEATURES, LEAST_ROWS, LEAST_RATIO = 4000, 3, 10.0
#: Folds of the sample for grades.
FOLDS = 4
#: The bounded sample, as in quality.labelled_sample().
FIT_ROWS = 3000
GRADES = 4
#: Words that a Vocabulary of a worker holds before it is begun anew, and elements of sets that are signed together.
WORDS, SIGNED = 100_000, 60_000
_WORD = re.compile(r"\w+")


#: A feature counts again from so many occurrences on, if one in OFTEN words has it.
LEVELS, OFTEN = (2, 4), 200
_AGAIN = {n: f"\t{n}" for n in LEVELS}


def word_features(word: str) -> list[str]:
    """The word, and its beginnings of 4 to 6 letters."""
    return ["=" + word, *(word[:k] for k in (4, 5, 6) if len(word) >= k)]


class ToxicityModel:
    """Weights shared by the ordered thresholds: P(grade > k) = s(w.x - threshold[k])."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, np.array(thresholds)
        self.telling = {f.split("\t")[0] for f in weights}
        self._words: dict[str, tuple[str, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_words": {}}

    def features(self, text: str) -> list[str]:
        """The distinct features with weights of the whole text, sorted."""
        known, telling = self._words, self.telling
        held: dict[str, int] = {}
        words = _WORD.findall(text.lower())
        for w, count in Counter(words).items():
            f = known.get(w)
            if f is None:
                if len(known) >= 300_000:
                    known.clear()
                f = known[w] = tuple(x for x in word_features(w) if x in telling)
            for x in f:
                held[x] = held.get(x, 0) + count
        out = list(held)
        for n, again in _AGAIN.items():
            out += [x + again for x, count in held.items() if count >= n and count * OFTEN >= len(words)]
        return sorted(x for x in out if x in self.weights)

    def evidence(self, text: str) -> float:
        """w.x; x has 1 for each feature."""
        return sum(self.weights[x] for x in self.features(text))

    def above(self, evidence: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and k."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(evidence, float)[:, None] - self.thresholds, -30, 30)))


def _again(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hashes of features that occur n times."""
    with np.errstate(over="ignore"):
        return mix(hashes + np.uint64(n * GOLD & MASK))


class Vocabulary:
    """Distinct words of texts as numbers, and the hashes of each word's features."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.hashes: list[np.ndarray] = []

    def features(self, text: str) -> np.ndarray:
        """The sorted hashes of a text's distinct features."""
        words = _WORD.findall(text.lower())
        at, times = [], []
        for w, count in Counter(words).items():
            n = self.words.get(w)
            if n is None:
                n = self.words[w] = len(self.hashes)
                self.hashes.append(np.array([xxhash.xxh64_intdigest(f) for f in word_features(w)], np.uint64))
            at.append(self.hashes[n])
            times.append(count)
        if not at:
            return np.empty(0, np.uint64)
        held, where = np.unique(np.concatenate(at), return_inverse=True)
        counts = np.bincount(where, np.repeat(times, [len(x) for x in at]))
        often = counts * OFTEN >= len(words)
        return np.unique(np.concatenate([held, *(_again(held[often & (counts >= n)], n) for n in LEVELS)]))

    def names(self, wanted: np.ndarray) -> dict[int, str]:
        """The features with the wanted hashes."""
        words, flat = list(self.words), np.concatenate([*self.hashes, np.empty(0, np.uint64)])
        begin = np.cumsum([0, *map(len, self.hashes)])
        out = {}
        for again, codes in (("", flat), *((_AGAIN[n], _again(flat, n)) for n in LEVELS)):
            for i in np.flatnonzero(np.isin(codes, wanted)):
                w = int(np.searchsorted(begin, i, "right")) - 1
                out[int(codes[i])] = word_features(words[w])[i - begin[w]] + again
        return out


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, features: int, steps: int = 400, ridge: float = 1e-3, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights, none negative, and ordered thresholds of greatest penalised likelihood, by projected Adam over all rows.
    times: how often each row occurs, once if not given."""
    share = np.full(len(rows), 1 / len(rows)) if times is None else times / times.sum()
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([np.array(r, np.int64) for r in rows] + [np.empty(0, np.int64)])
    cuts = int(grades.max())
    p = np.zeros(features + cuts)  # weights, the first threshold, logs of the gaps
    p[features] = 2.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        z = np.bincount(at, p[col], len(rows))
        gaps = np.exp(np.clip(p[features + 1 :], -6, 6))
        theta = p[features] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = 1 / (1 + np.exp(-np.clip(z[:, None] - theta, -30, 30)))  # P(grade > k)
        edge = np.hstack([np.ones((len(rows), 1)), s, np.zeros((len(rows), 1))])
        i = np.arange(len(rows))
        prob = np.maximum(edge[i, grades] - edge[i, grades + 1], 1e-9)
        slope = s * (1 - s)
        dz_k = np.zeros_like(s)  # d loss / d (z - theta_k)
        up = grades > 0
        dz_k[i[up], grades[up] - 1] -= (slope[i[up], grades[up] - 1] / prob[up])
        low = grades < cuts
        dz_k[i[low], grades[low]] += (slope[i[low], grades[low]] / prob[low])
        dz_k *= share[:, None]
        g = np.empty_like(p)
        g[:features] = np.bincount(col, dz_k.sum(1)[at], features) + ridge * p[:features] / 10
        dtheta = -dz_k.sum(0)
        g[features] = dtheta.sum()
        g[features + 1 :] = gaps * np.cumsum(dtheta[::-1])[::-1][1:]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        np.maximum(p[:features], 0, out=p[:features])
    gaps = np.exp(np.clip(p[features + 1 :], -6, 6))
    return p[:features], p[features] + np.concatenate([[0.0], np.cumsum(gaps)])


def unlike(sample: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The sample without rows that resemble an earlier one (about half of the word pairs): words of
    texts that were copied would else pass for telling ones."""
    known, seen, out = WordHashes(), set(), []
    sets = [shingle_set(word_hashes(words_of(t.encode()), known), 2) for _, t, _ in sample]
    for at in range(0, len(sample), 500):
        part = sets[at : at + 500]
        keys = band_keys(super_min_hash(np.concatenate(part), np.array([len(s) for s in part]), 90), 30, 3)
        for row, s, k in zip(sample[at : at + 500], part, keys.tolist(), strict=True):
            if not len(s) or seen.isdisjoint(k):
                out.append(row)
            seen.update(k if len(s) else ())
    return out


def word_rates(sample: list[tuple[int, str, int]], telling: list[str]) -> tuple[np.ndarray, list[int]]:
    """Occurrences of features in clean and toxic rows (2 rows of counts), and the words of either."""
    known: dict[str, list[int]] = {}
    number: dict[str, list[int]] = {}
    for k, f in enumerate(telling):
        number.setdefault(f.split("\t")[0], []).append(k)
    counts, words = np.zeros((2, len(telling))), [0, 0]
    for _, text, y in sample:
        found = _WORD.findall(text.lower())
        words[y] += len(found)
        for w in found:
            at = known.get(w)
            if at is None:
                at = known[w] = [k for f in word_features(w) for k in number.get(f, ())]
            for k in at:
                counts[y, k] += 1
    return counts, words


def severities(sample: list[tuple[int, str, int]]) -> np.ndarray:
    """For each row how many of its words, repeated ones too, tell toxic rows from clean ones in the other folds."""
    folds = [(t, y, i % FOLDS) for i, (_, t, y) in enumerate(sample)]
    n = Counter((y, k) for _, y, k in folds)
    held: tuple[Counter, Counter] = (Counter(), Counter())  # clean and toxic rows that hold a word
    part = [(Counter(), Counter()) for _ in range(FOLDS)]  # those of a fold
    for label in (1, 0):
        for t, y, k in folds:
            if y == label:
                words = set(_WORD.findall(t.lower()))
                words = words if y else words & held[1].keys()
                held[y].update(words)
                part[k][y].update(words)
        if label:
            for w in [w for w, c in held[1].items() if c < LEAST_ROWS]:
                del held[1][w]
                for some in part:
                    some[1].pop(w, None)
    tells = []
    for k in range(FOLDS):
        clean, toxic = (sum(n[y, j] for j in range(FOLDS) if j != k) for y in (0, 1))
        tells.append({w for w, both in held[1].items() if (a := both - part[k][1][w]) >= LEAST_ROWS and a * clean > LEAST_RATIO * (held[0][w] - part[k][0][w] + 0.5) * toxic})
    return np.array([sum(w in tells[k] for w in _WORD.findall(t.lower())) for t, _, k in folds], float)


def fit_toxicity(sample: list[tuple[int, str, int]]) -> ToxicityModel:
    """From (doc_id, text, label) rows, label 0 or 1.

    Labels tell only clean from toxic. Grades 1 to 3 of the toxic rows are the thirds of their severities(): how much abuse
    a text holds, by the words that tell in rows of other folds, so not by its own label and the model's choice of features.
    Features were chosen for being commoner in toxic rows, so weights aren't negative. Grade 0 is clean.
    """
    sample = unlike(sample)
    y = np.array([t for *_, t in sample], int)
    if len(set(y)) < 2:
        return ToxicityModel({}, [-30.0 if len(y) and y.all() else 30.0] + [30.0] * (GRADES - 2))
    words = Vocabulary()
    rows = [words.features(t) for _, t, _ in sample]
    n = [int((y == v).sum()) for v in (0, 1)]
    features, toxic = np.unique(np.concatenate([r for r, t in zip(rows, y, strict=True) if t]), return_counts=True)
    common = toxic >= LEAST_ROWS
    features, a = features[common], toxic[common].astype(float)
    clean = np.concatenate([r[np.isin(r, features, assume_unique=True)] for r, t in zip(rows, y, strict=True) if not t])
    b = np.bincount(np.searchsorted(features, clean), minlength=len(features)).astype(float)

    def part(k, of, other):  # one cell of the likelihood ratio statistic
        return np.where(k > 0, k * np.log(np.maximum(k, 1) * len(y) / (of * np.maximum(other, 1))), 0.0)

    strength = 2 * (part(a, n[1], a + b) + part(b, n[0], a + b) + part(n[1] - a, n[1], len(y) - a - b) + part(n[0] - b, n[0], len(y) - a - b))
    # Commoner in toxic rows, and so strongly that chance gives hardly one such feature among all that were tried.
    good = (a * n[0] > LEAST_RATIO * b * n[1]) & (strength >= 2.5 * np.log(max(len(features), 2)))
    order = np.lexsort((features, -strength))
    chosen = features[order[good[order]][:FEATURES]]
    named = words.names(chosen)
    telling = [named[h] for h in chosen.tolist()]
    # Long texts hold many rare words, so a few long toxic ones make words look telling: these aren't commoner among the words.
    counts, total = word_rates(sample, telling)
    common = counts[1] * total[0] > LEAST_RATIO * (counts[0] + 0.5) * total[1]
    chosen, telling = chosen[common], [f for f, c in zip(telling, common, strict=True) if c]
    by_hash = np.argsort(chosen)
    cols = [np.sort(by_hash[np.flatnonzero(np.isin(chosen[by_hash], r))]).tolist() for r in rows]
    del words, rows
    severity = severities(sample)
    cut = np.quantile(severity[y == 1], [1 / 3, 2 / 3])
    grades = np.where(y == 1, 1 + (severity > cut[0]) + (severity > cut[1]), 0)
    used = np.unique(grades)
    grades = np.searchsorted(used, grades)  # without gaps
    w, theta = fit_ordinal(cols, grades, len(telling))
    return ToxicityModel(dict(zip(telling, w.tolist(), strict=True)), theta.tolist())


def unlike_rows(rows: DataFrame, tmp: Scratch) -> DataFrame:
    """unlike() of all rows (doc_id, text, label): a row goes if one before it, by crc32 of the id and the id, has one of its keys."""

    def sign(batches):
        known = WordHashes()
        for b in batches:
            sets = [shingle_set(word_hashes(words_of(t.as_py()), known), 2) for t in b.column(1).cast(pa.binary())]
            keys, part, n = [], [], 0
            for i, s in enumerate(sets):
                part.append(s)
                n += len(s)
                if n >= SIGNED or i + 1 == len(sets):
                    signed = band_keys(super_min_hash(np.concatenate(part), np.array([len(x) for x in part]), 90), 30, 3).tolist()
                    keys += [k if len(x) else [] for k, x in zip(signed, part, strict=True)]
                    part, n = [], 0
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "keys"])

    signed = tmp.save(arrow_map(rows.select("doc_id", "text"), sign, "doc_id long, keys array<long>"))
    keyed = signed.select("doc_id", F.explode("keys").alias("key"))
    first = F.min(F.struct(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id"))["doc_id"]
    shared = keyed.groupBy("key").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = keyed.join(few(tmp.save(shared)), "key").where("doc_id <> first").select("doc_id").distinct()
    return keep_ids(rows, tmp.save(copies), "doc_id", "left_anti")


def in_folds(rows: DataFrame) -> DataFrame:
    """rows with fold, their place by crc32 of the id and the id modulo FOLDS: places in buckets of the crc32, after the rows
    of the buckets before."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    ids = rows.select("doc_id", F.shiftright(crc, 20).alias("bucket"), crc.alias("crc"))
    n = {r.bucket: r["count"] for r in ids.groupBy("bucket").count().collect()}  # at most 4096
    before = dict(zip(sorted(n), np.cumsum([0] + [n[k] for k in sorted(n)]).tolist(), strict=False))
    start = rows.sparkSession.createDataFrame(list(before.items()), "bucket long, start long")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("crc", "doc_id")) - 1
    fold = ids.withColumn("place", place).join(F.broadcast(start), "bucket").select("doc_id", F.pmod(F.col("place") + F.col("start"), F.lit(FOLDS)).cast("int").alias("fold"))
    return rows.join(few(fold), "doc_id")


def telling_features(rows: DataFrame, n: list[int], tmp: Scratch) -> list[str]:
    """The features that fit_toxicity() chooses, from n[0] clean and n[1] toxic rows (text, label)."""
    texts = rows.select("text", "label")

    def count(batches):
        words = Vocabulary()
        for b in batches:
            if len(words.words) > WORDS:
                words = Vocabulary()
            held = [words.features(t.as_py()) for t in b.column(0)]
            codes, at = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_inverse=True)
            toxic = np.bincount(at, np.repeat(b.column(1).to_numpy(), [len(h) for h in held]), len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(toxic), pa.array(np.bincount(at, minlength=len(codes)) - toxic)], names=["feature", "a", "b"])

    counted = arrow_map(texts, count, "feature long, a long, b long").groupBy("feature").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    counted = tmp.save(counted.where(F.col("a") >= LEAST_ROWS))
    a, b, total = F.col("a"), F.col("b"), n[0] + n[1]

    def part(k, of, other):
        return F.when(k > 0, k * F.log(F.greatest(k, F.lit(1.0)) * total / (of * F.greatest(other, F.lit(1.0))))).otherwise(0.0)

    strength = 2 * (part(a, n[1], a + b) + part(b, n[0], a + b) + part(n[1] - a, n[1], total - a - b) + part(n[0] - b, n[0], total - a - b))
    good = counted.select("feature", a, b, strength.alias("strength")).where((a * n[0] > LEAST_RATIO * b * n[1]) & (F.col("strength") >= float(2.5 * np.log(max(counted.count(), 2)))))
    unsigned = F.col("feature").bitwiseXOR(F.lit(-(1 << 63)))
    chosen = [r.feature for r in good.orderBy(F.desc("strength"), unsigned).limit(FEATURES).collect()]
    wanted = np.array(chosen, np.int64).view(np.uint64)

    def name(batches):
        words = Vocabulary()

        def found():
            names = words.names(wanted)
            return pa.RecordBatch.from_arrays([pa.array(np.array(list(names), np.uint64).view(np.int64)), pa.array(list(names.values()), pa.string())], names=["feature", "name"])

        for b in batches:
            for t in b.column(0):
                words.features(t.as_py())
            if len(words.words) > WORDS:
                yield found()
                words = Vocabulary()
        yield found()

    named = dict(arrow_map(texts.where("label = 1"), name, "feature long, name string").groupBy("feature").agg(F.min("name")).collect())
    telling = [named[f] for f in chosen]

    def rate(batches):
        counts, words = np.zeros((2, len(telling) + 1)), [0, 0]
        for b in batches:
            some, words = word_rates([(None, t, y) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], telling)
            counts += np.hstack([some, np.array(words)[:, None]])
        at = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *map(pa.array, counts[:, at].astype(np.int64))], names=["at", "clean", "toxic"])

    counts = np.zeros((2, len(telling) + 1))
    for at, *x in arrow_map(texts, rate, "at long, clean long, toxic long").groupBy("at").agg(F.sum("clean"), F.sum("toxic")).collect():
        counts[:, at] = x
    common = counts[1] * counts[0, -1] > LEAST_RATIO * (counts[0] + 0.5) * counts[1, -1]
    return [f for f, c in zip(telling, common, strict=False) if c]


def telling_words(rows: DataFrame, n: dict[tuple[int, int], int]) -> list[set[str]]:
    """For each fold the words that severities() counts in its rows, from rows (text, label, fold), n[label, fold] of each."""

    def count(batches):
        for b in batches:
            held = Counter((w, y * FOLDS + k) for t, y, k in zip(*(c.to_pylist() for c in b.columns), strict=True) for w in set(_WORD.findall(t.lower())))
            word, part = zip(*held, strict=True) if held else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(part, pa.int32()), pa.array(held.values(), pa.int64())], names=["word", "part", "n"])

    found = arrow_map(rows.select("text", "label", "fold"), count, "word string, part int, n long").groupBy("word")
    found = found.agg(*(F.sum(F.when(F.col("part") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(2 * FOLDS)))
    tells = []
    for k in range(FOLDS):
        held = [sum(F.col(f"n{y * FOLDS + j}") for j in range(FOLDS) if j != k) for y in (0, 1)]
        clean, toxic = (sum(n.get((y, j), 0) for j in range(FOLDS) if j != k) for y in (0, 1))
        tells.append((held[1] >= LEAST_ROWS) & (held[1] * clean > LEAST_RATIO * (held[0] + 0.5) * toxic))
    found = found.select("word", F.array(*tells).alias("tells")).where(F.array_contains("tells", True)).collect()
    return [{r.word for r in found if r.tells[k]} for k in range(FOLDS)]


def fit_toxicity_rows(rows: DataFrame) -> ToxicityModel:
    """fit_toxicity() on all rows (doc_id, text, label) of quality.labelled_rows(), however many: what it counts on the
    driver is counted by tasks here, and the regression is fitted to distinct rows of features and how often each occurs. All rows of
    a class together weigh at most as much as FIT_ROWS, so that either class weighs what it does in the bounded sample."""
    spark, tmp = rows.sparkSession, Scratch(rows.sparkSession)
    rows = tmp.save(rows.withColumn("doc_id", F.col("doc_id").cast("long")))
    rows = tmp.save(in_folds(tmp.save(unlike_rows(rows, tmp))))
    n = {(r.label, r.fold): r["count"] for r in rows.groupBy("label", "fold").count().collect()}
    of = [sum(c for (y, _), c in n.items() if y == v) for v in (0, 1)]
    if not all(of):
        return ToxicityModel({}, [-30.0 if of[1] else 30.0] + [30.0] * (GRADES - 2))
    telling = telling_features(rows, of, tmp)
    shared = spark.sparkContext.broadcast((ToxicityModel(dict.fromkeys(telling, 0.0), []), {f: k for k, f in enumerate(telling)}, telling_words(rows, n)))

    def describe(batches):
        model, number, tells = shared.value
        for b in batches:
            texts, labels, folds = (c.to_pylist() for c in b.columns)
            held = [sorted(number[f] for f in model.features(t)) for t in texts]
            severity = [sum(w in tells[k] for w in _WORD.findall(t.lower())) if y else 0 for t, y, k in zip(texts, labels, folds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(severity, pa.int64()), pa.array(held, pa.list_(pa.int32()))], names=["label", "severity", "held"])

    described = tmp.save(arrow_map(rows.select("text", "label", "fold"), describe, "label int, severity long, held array<int>"))
    shared.destroy()
    some = sorted(described.where("label = 1").groupBy("severity").count().collect())
    cut = np.quantile(np.repeat([r.severity for r in some], [r["count"] for r in some]), [1 / 3, 2 / 3])
    grade = F.when(F.col("label") == 1, sum((F.col("severity") > float(c)).cast("int") for c in cut) + 1).otherwise(0)
    distinct = described.groupBy("held", grade.alias("grade")).count().orderBy("held", "grade").toArrow()
    used, grades = np.unique(distinct["grade"].to_numpy(), return_inverse=True)  # without gaps
    toxic = (distinct["grade"].to_numpy() > 0).astype(int)
    times = distinct["count"].to_numpy() * np.array([min(1, FIT_ROWS / c) for c in of])[toxic]
    w, theta = fit_ordinal(distinct["held"].to_pylist(), grades, len(telling), times=times)
    return ToxicityModel(dict(zip(telling, w.tolist(), strict=True)), theta.tolist())


def _above(model: ToxicityModel, texts) -> np.ndarray:
    return model.above(np.array([model.evidence(t.as_py() or "") for t in texts], float))


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, severity (expected grade), grade (the likeliest), toxic (P(grade > 0) >= 0.5) of every row.

    Null and empty texts have no features. Equally likely grades give the lower. An empty table gives no rows. Rows are
    independent: null or repeated ids and other columns don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batches):
        for b in batches:
            s = _above(shared.value, b.column(1))
            edge = np.hstack([np.ones((len(s), 1)), s, np.zeros((len(s), 1))])
            grade = (edge[:, :-1] - edge[:, 1:]).argmax(1)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(s.sum(1)), pa.array(grade.astype(np.int32)), pa.array(s[:, 0] >= 0.5)], names=["doc_id", "severity", "grade", "toxic"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, severity double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs's rows that aren't toxic, with all columns. Null and empty texts have no features; each row is judged by itself,
    so repeated rows stay or go together; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_above(shared.value, b.column(at))[:, 0] < 0.5))

    return arrow_map(docs, run, docs.schema)

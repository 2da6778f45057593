"""Benchmark decontamination: rare word pairs as seeds, then Smith-Waterman alignment by words.

The benchmark is read in blocks of bounded size, and one block is done with before the next. For a block, one pass over
the texts writes the documents that hold any of its word pairs as word numbers. From these a second one counts in how many
documents each pair lies, and a third one joins each item's rarer pairs, sent to all workers, with the documents' pairs, enough
of them that no alignment of the least score can be without one, and aligns the item with the words around them.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkyard.llm.common import Scratch, arrow_map, few

#: Items of fewer words must be found whole; least normalised alignment score; words of the benchmark in one block (about 100 MB in a worker).
SHORT, SCORE, BLOCK_WORDS = 3, 0.5, 500_000
MATCH, MISMATCH, GAP = 2, 1, 1
_EDGE = ".,;:!?\"'()[]{}«»“”‘’%*#$&|-"


def words(text: str | None) -> list[str]:
    """Lower-cased, cut at white space, without punctuation at the edges; empty words are dropped."""
    return [w for w in (x.strip(_EDGE) for x in (text or "").lower().split()) if w]


class Items:
    """One block of the benchmark: word numbers, items as numbers, seed codes and where they lie.

    Between two neighbouring matches of an alignment lie errors (a mismatch or gap each, cost 1; a match gives 2).
    A score of least * 2 * n of an item of n words with M matches leaves at most 2 M - 2 n least errors, so at
    most M - n least of the M - 1 neighbours are two or more errors apart, and at least n least - 1 are at most
    one apart: their places differ by 1 or 2 in the item as well as in the document. Hence pairs of words one or two
    places apart are the seeds; of an item's places that begin a pair, so many must be found (`sure`). If none
    must, single words are seeds.
    """

    def __init__(self, rows: list[tuple[int, list[str]]], least: float = SCORE):
        self.ids, self.least = [i for i, _ in rows], least
        self.vocabulary: dict[str, int] = {}
        self.items = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int64) for _, ws in rows]
        self.forms = sorted({f for x in self.items for f in self.forms_of(len(x))})
        code, item, at = [], [], []
        for i, x in enumerate(self.items):
            for form in self.forms_of(len(x)):
                c = self.codes(x, form)
                code.append(c)
                item.append(np.full(len(c), i))
                at.append(np.arange(len(c)))
        self.code, self.item, self.at = (np.concatenate([np.empty(0, np.int64), *x]) for x in (code, item, at))
        self.all = np.unique(self.code)

    def sure(self, n: int) -> int:
        """Places of an item of n words that begin a pair of any alignment of the least score."""
        return math.ceil(self.least * n - 1 - 1e-9)

    def forms_of(self, n: int) -> tuple[str, ...]:
        if n < SHORT:
            return ((), ("word",), ("row",))[n]
        return ("near", "far") if self.sure(n) > 0 else ("word",)

    def codes(self, numbers: np.ndarray, form: str) -> np.ndarray:
        """A number for each place's word, two words in a row (of a short item), or pair one or two places apart; -1 if one
        isn't in the vocabulary. near and far pairs share their numbers. 2 BLOCK_WORDS ** 2 fits."""
        if form == "word":
            return np.where(numbers > 0, numbers, -1)
        v, step = len(self.vocabulary) + 1, 2 if form == "far" else 1
        a, b = numbers[:-step], numbers[step:]
        return np.where((a > 0) & (b > 0), a * v + b + (v * v if form == "row" else 0), -1)

    def held(self, numbers: np.ndarray) -> np.ndarray:
        """The block's codes in a document of numbered words, once for each place."""
        g = np.concatenate([np.empty(0, np.int64), *(self.codes(numbers, form) for form in self.forms)])
        return g[_among(g, self.all)]

    def rare(self, frequency: np.ndarray) -> tuple[np.ndarray, ...]:
        """Seeds by the frequencies of `all`: their codes, sorted, where each one's places begin, and the places' items
        and words. Of the places of an item that begin a pair, the most frequent are left out, one fewer than are sure."""
        often = frequency[np.searchsorted(self.all, self.code)]
        keep = np.ones(len(self.code), bool)
        ends = np.searchsorted(self.item, np.arange(len(self.items) + 1))
        for x, lo, hi in zip(self.items, ends, ends[1:], strict=False):
            if "near" in self.forms_of(len(x)):
                at = self.at[lo:hi]
                drop = np.argsort(np.bincount(at, often[lo:hi]), kind="stable")[len(x) - self.sure(len(x)) :]
                keep[lo:hi] = ~np.isin(at, drop)
        order = np.flatnonzero(keep)
        order = order[np.argsort(self.code[order], kind="stable")]
        seeds, first = np.unique(self.code[order], return_index=True)
        return seeds, np.append(first, len(order)), self.item[order], self.at[order]


class Numbering(dict):
    """A raw token -> its word's number (0: not in the benchmark); begun anew when too large."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        word = token.strip(_EDGE)
        n = self[token] = self.vocabulary.get(word, 0) if word else -1
        return n

    def numbers(self, text: str | None) -> np.ndarray:
        tokens = (text or "").lower().split()
        n = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return n[n >= 0] if len(n) and n.min() < 0 else n


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of the values that are in the sorted table."""
    at = np.flatnonzero(values >= 0)
    if not len(at) or not len(table):
        return at[:0]
    v = values[at]
    k = np.minimum(np.searchsorted(table, v), len(table) - 1)
    return at[table[k] == v]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman: the best local score of two word sequences (0 in b matches nothing), and where it first ends in b."""
    steps = GAP * np.arange(len(b) + 1)
    h = np.zeros(len(b) + 1, np.int64)
    best, end = 0, 0
    for w in a:
        new = np.empty_like(h)
        new[0] = 0
        new[1:] = np.maximum(np.maximum(h[:-1] + np.where(b == w, MATCH, -MISMATCH), h[1:] - GAP), 0)
        h = np.maximum.accumulate(new + steps) - steps  # gaps along b
        k = int(h.argmax())
        if h[k] > best or (h[k] == best and k < end):
            best, end = int(h[k]), k
    return best, end


def _windows(starts: list[int], n: int, slack: int, most: int) -> list[list[int]]:
    """The words that an alignment through a seed can cover, for an item beginning at each start; joined where they overlap."""
    windows: list[list[int]] = []
    for s in starts:
        lo, hi = max(0, s - slack), min(most, s + n + slack)
        if windows and lo <= windows[-1][1]:
            windows[-1][1] = hi
        else:
            windows.append([lo, hi])
    return windows


def _pairs(item: np.ndarray, part: np.ndarray) -> int:
    """Places of the item whose word and the next or next but one lie one or two places apart in part."""
    same = np.zeros((len(item) + 2, len(part) + 2), bool)
    same[:-2, :-2] = item[:, None] == part
    then = same[1:-1, 1:-1] | same[1:-1, 2:] | same[2:, 1:-1] | same[2:, 2:]
    return int((same[:-2, :-2] & then).any(axis=1).sum())


def leaks_in(numbers: np.ndarray, items: Items, seeds: tuple[np.ndarray, ...]) -> list[tuple[int, float, int, int]]:
    """(item_id, score, start, end) for the items found in a document of numbered words; start and end in words."""
    codes, first, of, begin = seeds
    spots: dict[int, set[int]] = {}
    for form in items.forms:
        g = items.codes(numbers, form)
        at = _among(g, codes)
        k = np.searchsorted(codes, g[at])
        for p, lo, hi in zip(at.tolist(), first[k].tolist(), first[k + 1].tolist(), strict=True):
            for e in range(lo, hi):
                spots.setdefault(int(of[e]), set()).add(p - int(begin[e]))
    out = []
    for i, starts in spots.items():
        item = items.items[i]
        n = len(item)
        need = items.least * MATCH * n
        slack = max(0, int(MATCH * n - need)) + 1  # more words put in cost more than the score has to spare
        sure = items.sure(n) if n >= SHORT else 0
        bag, held = np.unique(item, return_counts=True)

        def hopeful(lo: int, hi: int) -> bool:
            """False if no alignment within can reach the score: too few words, or pairs, of the item."""
            part = numbers[lo:hi]
            k = np.minimum(np.searchsorted(bag, part), len(bag) - 1)
            have = np.bincount(k[bag[k] == part], minlength=len(bag))
            return MATCH * np.minimum(have, held).sum() >= need and (sure < 2 or _pairs(item, part) >= sure)

        starts = [s for s in sorted(starts) if hopeful(max(0, s - slack), s + n + slack)]
        best = (0.0, 0, 0)
        for lo, hi in _windows(starts, n, slack, len(numbers)):
            part = numbers[lo:hi]
            score, end = align(item, part)
            if score >= need and score / (MATCH * n) > best[0]:
                back, start = align(item[::-1], part[:end][::-1])
                best = (score / (MATCH * n), lo + end - start, lo + end)
        if best[0]:
            out.append((items.ids[i], *best))
    return sorted(out)


def item_blocks(benchmark: DataFrame, most: int = BLOCK_WORDS, least: float = SCORE):
    """The benchmark's items in blocks of at most `most` words (or one longer item), one at a time."""
    rows, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        w = words(r.text)
        if rows and size + len(w) > most:
            yield Items(rows, least)
            rows, size = [], 0
        rows.append((r.item_id, w))
        size += len(w)
    if rows:
        yield Items(rows, least)


def _numbered(docs: DataFrame, shared, key: str) -> DataFrame:
    """key and numbered words (32 bits each) of the documents (key, text) that hold any code of the block; the others hold
    no item."""

    def run(batches):
        block, known = shared.value, Numbering(shared.value.vocabulary)
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1)):
                n = known.numbers(t.as_py())
                if len(block.held(n)):
                    at.append(i)
                    rows.append(n.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(rows, pa.binary())], names=["key", "numbers"])

    return arrow_map(docs, run, f"key {key}, numbers binary")


def _numbers(column):
    """The documents of _numbered()."""
    return (np.frombuffer(x.as_py(), "<i4").astype(np.int64) for x in column)


def _frequencies(numbered: DataFrame, items: Items, shared) -> np.ndarray:
    """In how many of all documents each code of the block lies."""

    def count(batches):
        block, counts = shared.value, np.zeros(len(shared.value.all), np.int64)
        for b in batches:
            for n in _numbers(b.column(0)):
                counts[np.searchsorted(block.all, np.unique(block.held(n)))] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(block.all[at]), pa.array(counts[at])], names=["g", "n"])

    found = arrow_map(numbered.select("numbers"), count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    found = found.toArrow()  # at most the block's codes
    frequency = np.zeros(len(items.all), np.int64)
    frequency[np.searchsorted(items.all, found["g"].to_numpy())] = found["n"].to_numpy()
    return frequency


def _by_block(docs: DataFrame, benchmark: DataFrame, score: float, rows_of, schema: str) -> DataFrame:
    """What rows_of(key, leaks) makes of each document (key, text) and its leaks, for each block of the benchmark; written
    block by block, so that memory holds one block, however many there are."""
    sc, tmp = docs.sparkSession.sparkContext, Scratch(docs.sparkSession)
    out = docs.sparkSession.createDataFrame([], schema)
    names, dtypes = out.columns, out.dtypes
    for items in item_blocks(benchmark, least=score):
        shared = sc.broadcast(items)
        numbered = tmp.save(_numbered(docs, shared, docs.dtypes[0][1]))
        seeds = sc.broadcast(items.rare(_frequencies(numbered, items, shared)))

        def run(batches, shared=shared, seeds=seeds):
            for b in batches:
                rows = [r for key, n in zip(b.column(0), _numbers(b.column(1)), strict=True) for r in rows_of(key.as_py(), leaks_in(n, shared.value, seeds.value))]
                kinds = [pa.int64() if k == "bigint" else pa.float64() if k == "double" else pa.string() for _, k in dtypes]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

        out = out.unionAll(tmp.save(arrow_map(numbered, run, schema)))
        tmp.drop(numbered)
        for b in (shared, seeds):
            b.destroy()
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, *, score: float = SCORE) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word: a row for each document and benchmark item found in it.

    score is the best Smith-Waterman score by words (match 2, mismatch and gap -1) over the most possible, at
    least `score`; the words are those of words(), counted from 0, end excluded. Equal scores: the first
    end, then the last start. Every alignment of that score is found, see Items; only items of one or two words must lie in the document
    whole and in a row, as a single word would score 0.5. Null and empty texts and items match nothing. Repeated rows each give their rows, repeated
    items too; null ids are carried. Without documents or items there are no rows. Other columns are ignored.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _by_block(ids, benchmark, score, lambda key, leaks: [(key, *x) for x in leaks], "doc_id long, item_id long, score double, start_word long, end_word long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, score: float = SCORE) -> DataFrame:
    """docs's rows in which no benchmark item is found, with all columns. Which are found is contaminated()'s matter: rows
    with null, empty or blank texts stay, repeated rows stay or go together, and without items all stay. What is found
    depends on the text alone, so texts are dropped by their digest; ids may be null or repeated. An empty table gives none."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    texts = docs.select(digest.alias("digest"), "text")
    found = _by_block(texts, benchmark, score, lambda key, leaks: [(key,)] if leaks else [], "_leak string")
    return docs.join(few(found.distinct()), digest == F.col("_leak"), "left_anti")

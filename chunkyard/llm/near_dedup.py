"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find.

Rows with equal shingle sets form a class; only one row of a class (its smallest doc_id) goes on.
Classes that share a band key are candidates. They are not paired off: in each bucket every member
is verified on its full set against a hub (the member with the most bucket mates), and what is linked is
grouped. In buckets that still hold several groups, the members outside the largest group are then
compared in bounded blocks with all members of other groups, so that no candidate pair whose
verdict could join two groups goes unverified. Nothing is capped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from chunkyard.llm.common import GOLD, MASK, Scratch, WordHashes, arrow_map, few, keep_ids, mix, shingle_set, word_hashes, words_of

#: 32 bands of 5 ranks: a pair at the similarity 0.8 has no common band once in 300,000 times, at 0.9 once in 10^12.
BANDS, ROWS = 32, 5
#: Set elements in one block of the exact stage, of either side; members of a bucket that one task joins; tasks that a
#: component is dealt over.
BLOCK_ELEMENTS, SALT, SPREAD = 1_000_000, 1000, 16
_EMPTY = np.int64(np.iinfo(np.int64).max)
#: Elements that are signed together: they may need a permutation of 320 bytes each.
_CHUNK = 60_000


def super_min_hash(elements: np.ndarray, sizes: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (one row a set) of sets given as concatenated distinct uint64 hashes.

    Step j gives each element its j-th rank: the slot from its own Fisher-Yates permutation and
    the value j + fraction. A set is done when its largest slot value is below j, since no later
    rank can lower a slot. All the elements of many sets take a step together.
    """
    out = np.full((len(sizes), slots), _EMPTY, np.int64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    perm, past = None, []
    for j in range(slots):
        if not len(elements):
            break
        with np.errstate(over="ignore"):
            x = mix(elements + np.uint64(GOLD * (j + 1) & MASK))
        low = (x & np.uint64(0xFFFFFFFF)).astype(np.int64)
        pick = j + ((x >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if perm is None and j > 10:  # few elements last this long: from here whole permutations
            perm = np.tile(np.arange(slots, dtype=np.int16), (len(elements), 1))
            at = np.arange(len(elements))
            for i, p in enumerate(past):
                perm[at, i], perm[at, p] = perm[at, p], perm[at, i].copy()
        if perm is None:
            slot = pick
            for i in range(j - 1, -1, -1):  # undo the swaps: which slot lay at `pick`
                slot = np.where(slot == past[i], i, slot)
            past.append(pick)
        else:
            at = np.arange(len(elements))
            slot = perm[at, pick].astype(np.int64)
            perm[at, pick] = perm[at, j]
        np.minimum.at(flat, owner * slots + slot, (np.int64(j) << np.int64(32)) | low)
        live = (out.max(axis=1) >> np.int64(32)) > j
        keep = live[owner]
        if not keep.all():
            elements, owner = elements[keep], owner[keep]
            past = [p[keep] for p in past]
            perm = None if perm is None else perm[keep]
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each set and band."""
    s = signatures.astype(np.uint64).reshape(-1, bands, rows)
    with np.errstate(over="ignore"):
        key = mix(np.broadcast_to((np.arange(bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(GOLD), s.shape[:2]).copy())
        for r in range(rows):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + s[:, :, r])
    return key.astype(np.int64)


def _print_of(elements: np.ndarray) -> bytes | None:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None


def _signatures(width: int, bands: int, rows: int):
    def run(batches):
        known = WordHashes()
        for b in batches:
            ids, nids, texts = b.column(0), b.column(1), b.column(2).cast(pa.binary())
            sets, prints, seen, which = [], [], {}, []
            for t in texts:
                s = shingle_set(word_hashes(words_of(t.as_py()), known), width)
                fp = _print_of(s)
                if fp not in seen:  # equal sets of one batch are signed once
                    seen[fp] = len(sets)
                    sets.append(s)
                which.append(seen[fp])
                prints.append(fp)
            keys = np.zeros((len(sets), bands), np.int64)
            at = 0
            while at < len(sets):
                end, n = at, 0
                while end < len(sets) and (end == at or n + len(sets[end]) <= _CHUNK):
                    n += len(sets[end])
                    end += 1
                part = sets[at:end]
                sig = super_min_hash(np.concatenate(part), np.array([len(s) for s in part]), bands * rows)
                keys[at:end] = band_keys(sig, bands, rows)
                at = end
            sizes = np.array([len(s) for s in sets], np.int64)
            w = np.array(which, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * bands), pa.array(keys[w].reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids, nids, pa.array(sizes[w]), pa.array(prints, pa.binary()), lists], names=["doc_id", "nid", "n", "fp", "bands"])

    return run


def _sets(width: int):
    def run(batches):
        known = WordHashes()
        for b in batches:
            sets = [shingle_set(word_hashes(words_of(t.as_py()), known), width) for t in b.column(1).cast(pa.binary())]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(map(_print_of, sets), pa.binary()), lists], names=["fp", "s"])

    return run


def _forest(batches):
    """Union-find over one partition's links: each node once, with its root, the smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.setdefault(top, top)) != top:
            top = p
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = root(a), root(c)
            if a != c:
                parent[max(a, c)] = min(a, c)
    pairs = [(x, root(x)) for x in parent]
    pairs = [p for p in pairs if p[0] != p[1]]
    for i in range(0, len(pairs), 50_000):
        part = pairs[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], names=["u", "v"])


def star_forest(tmp: Scratch, links: DataFrame, most: int) -> DataFrame:
    """(u, v) of every linked node but the roots; v, the root, is the smallest node reachable. most: a bound of the
    links' count.

    Union-find inside partitions, then alternating large and small stars on what is left, until
    each node hangs on one root. Links stay distributed.
    """
    edges = tmp.save(arrow_map(links.toDF("u", "v"), _forest, "u long, v long").distinct(), most)
    while True:
        hanging = edges.groupBy("u").agg(F.count("*").alias("k"))
        roots = edges.select(F.col("v").alias("u")).distinct().withColumn("root", F.lit(1))
        if hanging.join(roots, "u", "left").where("k > 1 or root = 1").isEmpty():
            return edges
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v")
        new = tmp.save(arrow_map(small, _forest, "u long, v long").distinct(), 2 * most)
        tmp.drop(edges)
        edges = new


def _linked(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose full sets have 100 * intersection >= percent * union."""
    one = edges.join(sets.select(F.col("nid").alias("a"), F.col("s").alias("sa")), "a")
    two = one.join(sets.select(F.col("nid").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return two.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _block_links(percent: int):
    """Links between the queries and the other groups' members of one block, each pair only in the
    first bucket the two share, and one link for each query and foreign group."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        key = block.column("key")[0].as_py()
        nid, comp = (block.column(c).to_numpy() for c in ("nid", "comp"))
        query = block.column("query").to_numpy(zero_copy_only=False)
        sets = [np.asarray(s.values) for s in block.column("s")]
        keys = [np.asarray(s.values) for s in block.column("ks")]
        members = np.flatnonzero(~query)
        empty = np.empty(0, np.int64)
        sizes = np.array([len(sets[i]) for i in members], np.int64)
        flat = np.concatenate([*(sets[i] for i in members), empty])
        owner = np.repeat(np.arange(len(members)), sizes)
        earlier = [keys[i][keys[i] < key] for i in members]
        early = np.concatenate([*earlier, empty])
        early_owner = np.repeat(np.arange(len(members)), [len(e) for e in earlier])
        found = []
        for q in np.flatnonzero(query):
            n = len(sets[q])
            use = (comp[members] != comp[q]) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
            use[early_owner[np.isin(early, keys[q])]] = False
            if not use.any():
                continue
            mask = use[owner]
            common = np.bincount(owner[mask][np.isin(flat[mask], sets[q])], minlength=len(members))
            hit = use & (100 * common >= percent * (sizes + n - common))
            for m in np.unique(comp[members][hit], return_index=True)[1]:
                found.append((nid[q], nid[members][hit][m]))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def _by_bucket(members: DataFrame, of: DataFrame) -> DataFrame:
    """members (with key, nid and c, the bucket's size) joined with of's row of their bucket. A large bucket is dealt
    over as many tasks as its size calls for, so `of` has its size as `size`."""
    pieces = lambda c: F.ceil(F.col(c) / SALT)
    dealt = of.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), pieces("size") - 1))).drop("size")
    return members.withColumn("salt", F.pmod(F.xxhash64("nid"), pieces("c"))).join(dealt, ["key", "salt"]).drop("salt")


def _classes(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, text): signed, which has doc_id, n and fp (the set's digest) of each row, and fp, comp of
    the sets that documents with an id have; comp is the smallest doc_id of all sets reachable.

    A set is a node, numbered by one of its rows, so ids that repeat with other texts don't merge."""
    tmp = Scratch(docs.sparkSession)
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("nid"), "text")
    signed = tmp.save(arrow_map(numbered, _signatures(shingle, bands, rows), "doc_id long, nid long, n long, fp binary, bands array<long>"))
    usable = signed.where("n > 0 and doc_id is not null")
    classes = tmp.save(usable.groupBy("fp").agg(F.min("nid").alias("nid"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    banded = classes.select("nid", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = tmp.save(banded.join(shared, "key"))
    count = members.count()
    wanted = classes.select("fp", "nid", "least").join(members.select("nid").distinct(), "nid", "left_semi")
    made = arrow_map(keep_ids(docs, wanted.select(F.col("least").alias("doc_id")).distinct(), "doc_id"), _sets(shingle), "fp binary, s array<long>")
    sets = tmp.save(made.join(wanted.select("fp", "nid"), "fp").groupBy("nid").agg(F.first("s").alias("s")))

    mates = members.groupBy("nid").agg(F.sum("c").alias("mates"))
    hubs = members.join(mates, "nid").groupBy("key").agg(F.max("c").alias("size"), F.max_by(F.struct(F.col("nid").alias("hub"), F.col("n").alias("hub_n")), F.struct("mates", -F.col("nid"))).alias("h")).select("key", "size", "h.*")
    close = (F.col("nid") != F.col("hub")) & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    edges = _by_bucket(members, hubs).where(close).select(F.col("nid").alias("a"), F.col("hub").alias("b")).distinct()
    links = tmp.save(_linked(edges, sets, percent), count)

    def open_buckets(forest: DataFrame) -> DataFrame:
        """Members of the buckets of over two that hold several groups; query: outside the largest; qb, db: the
        blocks of queries and of all members."""
        comps = forest.select(F.col("u").alias("nid"), F.col("v").alias("comp"))
        of = members.where("c > 2").join(comps, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
        groups = of.groupBy("key", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("w"), F.max("c").alias("c"))
        order = F.struct("k", -F.col("comp"))
        blocks = lambda w: F.ceil(w / BLOCK_ELEMENTS).cast("int")
        largest = groups.groupBy("key").agg(F.max("c").alias("size"), F.max_by("comp", order).alias("main"), F.count("*").alias("groups"), blocks(F.sum("w") - F.max_by("w", order)).alias("qb"), blocks(F.sum("w")).alias("db"))
        return _by_bucket(of, largest.where("groups > 1").drop("groups")).withColumn("query", F.col("comp") != F.col("main")).drop("main")

    forest = star_forest(tmp, links, count)
    tmp.drop(links)
    still = tmp.save(open_buckets(forest), count)
    # A second hub for the open buckets: any member of the largest group, another one in each bucket.
    second = still.where("not query").groupBy("key").agg(F.max("c").alias("size"), F.min_by(F.struct(F.col("nid").alias("hub"), F.col("n").alias("hub_n")), F.xxhash64("key", "nid")).alias("h")).select("key", "size", "h.*")
    edges = _by_bucket(still.where("query"), second).where(close).select(F.col("nid").alias("a"), F.col("hub").alias("b")).distinct()
    more = tmp.save(_linked(edges, sets, percent), count)
    if not more.isEmpty():
        before = forest
        forest = star_forest(tmp, forest.union(more), 2 * count)
        tmp.drop(before, still)
        still = tmp.save(open_buckets(forest), count)
    tmp.drop(more)

    keys = still.groupBy("nid").agg(F.sort_array(F.collect_set("key")).alias("ks"))  # at most one for each band
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("nid"), F.col(n)).cast("int")
    ask = still.where("query").withColumn("i", own("qb")).withColumn("j", F.explode(spread("db")))
    answer = still.withColumn("query", F.lit(False)).withColumn("j", own("db")).withColumn("i", F.explode(spread("qb")))
    columns = ["key", "i", "j", "nid", "comp", "query"]
    rows_in = ask.select(columns).union(answer.select(columns)).join(keys, "nid").join(sets, "nid")
    last = tmp.save(rows_in.groupBy("key", "i", "j").applyInArrow(_block_links(percent), "a long, b long"), count)
    if not last.isEmpty():
        before = forest
        forest = star_forest(tmp, forest.union(last), 2 * count)
        tmp.drop(before)
    tmp.drop(sets, members, still, last)

    of = classes.select("fp", "nid", "least").join(forest.select(F.col("u").alias("nid"), F.col("v").alias("root")), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    # A component may hold a large part of all sets: its least id is dealt over several tasks.
    least = of.groupBy("root").agg(F.min("least").alias("comp")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    named = of.withColumn("salt", F.pmod(F.xxhash64("nid"), F.lit(SPREAD)).cast("int")).join(least, ["root", "salt"])
    return signed.select("doc_id", "n", "fp"), named.select("fp", "comp")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Words are runs of other than blanks and the controls 9 to 13, A-Z lower-cased; a document's set
    holds its distinct runs of `shingle` words (fewer words: the whole sequence). Documents link when
    100 * intersection >= percent * union of the full sets; a component's id is its smallest doc_id,
    and kept marks that document. Null and empty texts have n_shingles 0 and link with nothing. A
    null doc_id links with nothing, has a null component_id and is kept. Rows that repeat a doc_id with one text
    are one document; with other texts each row goes by its own text, so the same id may be in several components,
    and in each that it is the smallest of, its rows are kept. Ties don't arise: ids order all choices. An empty
    table gives no rows. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed, named = _classes(docs, shingle, percent, bands, rows)
    component = F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    out = signed.join(named, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with one document (the smallest doc_id) of each near-duplicate group; all columns. Which rows stay is
    near_duplicates()' kept: of an id that repeats with other texts, those whose own text isn't a copy, so that no text
    goes without one that stays for it. Null and empty texts and rows without an id stay; an empty table gives none."""
    signed, named = _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle, percent, bands, rows)
    tmp = Scratch(docs.sparkSession)
    known = signed.where("n > 0 and doc_id is not null").join(named, "fp")
    gone = tmp.save(known.where("doc_id != comp").select("doc_id", "fp"))  # no distinct(): a set may have many rows
    stay = known.where("doc_id = comp").select("doc_id").distinct()
    mixed = tmp.save(gone.select("doc_id").distinct().join(stay, "doc_id", "left_semi"))
    left = keep_ids(docs, gone.select("doc_id").distinct(), "doc_id", "left_anti")
    if mixed.isEmpty():
        return left
    # Ids with rows of both kinds: their rows are told apart by their sets.
    at = docs.columns.index("text")
    printed = StructType([*docs.schema, StructField("_fp", BinaryType())])

    def run(batches):
        words = WordHashes()
        for b in batches:
            fp = [_print_of(shingle_set(word_hashes(words_of(t.as_py()), words), shingle)) for t in b.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp, pa.binary())], schema=pa.schema([*b.schema, pa.field("_fp", pa.binary())]))

    some = arrow_map(keep_ids(docs, mixed, "doc_id"), run, printed)
    copies = few(gone.join(mixed, "doc_id", "left_semi").select(F.col("doc_id").alias("_id"), F.col("fp").alias("_gone")))
    return left.unionAll(some.join(copies, (F.col("doc_id") == F.col("_id")) & (F.col("_fp") == F.col("_gone")), "left_anti").drop("_fp"))

"""N-gram Jaccard join with Bayesian candidate pruning (after Satuluri and Parthasarathy, "Bayesian locality sensitive
hashing for fast similarity search").

A text's words are its runs of code points other than blanks, A-Z lower-cased; its shingles are the sets of five
consecutive words (of all its words, if it has fewer than five). Rows whose shingle sets are equal form a class, held
once. Classes get MinHash values; those that agree on a band of values are candidates. For each candidate pair the
values are compared a few at a time, and the pair is dropped as soon as the posterior probability of a similarity of
`threshold` or more falls below `tolerance`; the pairs that stay are verified on the whole shingle sets. Links are
counted and joined inside the tasks: pairs are never rows. A bucket of many classes is dealt to several tasks by pairs
of blocks, each class to one block, so no task holds an unbounded bucket and no pair is lost.

Defined cases: null or empty texts and texts of blanks link with nothing and are groups of their own; shorter texts
than five words have one shingle; copies, rows that repeat and texts of any length take part whole; an empty table
gives an empty result; ids may be null (such a row's class is the smallest id of its group, if any).
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_batches, connected_components, forget_kept, free_name, identity, written


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    bands: int = 24
    rows: int = 4
    #: MinHash values compared between two looks at the posterior.
    step: int = 8
    tolerance: float = 1e-5
    seed: int = 11
    #: Classes of one bucket that a task compares with each other or with as many more.
    block: int = 256


# ---- shingles -------------------------------------------------------------------------------------------------------

_ODD = 0x9E3779B97F4A7C15
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """64 bits for each word, by a polynomial in its bytes."""
    raw = np.frombuffer(text.lower(), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:-1], out=total[1:])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """The sorted distinct shingles of a text, 64 bits each."""
    h = word_hashes(text or b"")
    if not len(h):
        return h
    k = min(words, len(h))
    s = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            s = s * np.uint64(0xD6E8FEB86659FD93) + h[i : i + len(s)]
    return np.unique(_mix(s))


def minhash_family(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(s.seed)
    n = s.bands * s.rows
    return rng.integers(1, 1 << 63, n, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def minhash(sh: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = family
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(sh), 1024):
        v = a[:, None] * sh[i : i + 1024]
        v += b[:, None]
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(low, (v >> np.uint64(32)).min(1).astype(np.uint32), out=low)
    return low


# ---- pruning --------------------------------------------------------------------------------------------------------


def posterior(matches: int, n: int, threshold: float) -> float:
    """P(similarity >= threshold) after so many matches among n values, from a uniform prior: a beta tail."""
    # I_x(a, b) with whole a, b is a binomial tail
    a, t = matches + 1, n + 1
    return 1 - sum(comb(t, i) * threshold**i * (1 - threshold) ** (t - i) for i in range(a, t + 1))


def least_matches(s: Settings) -> list[tuple[int, int]]:
    """(n, the fewest matches among the first n values with which a pair is kept)."""
    out = []
    for n in range(s.step, s.bands * s.rows + 1, s.step):
        out.append((n, next(m for m in range(n + 1) if posterior(m, n, s.threshold) >= s.tolerance)))
    return out


def prune(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs (i, j) stay: the values are compared step by step, and only pairs still in play are compared on."""
    alive, matches, done = np.arange(len(i)), np.zeros(len(i), np.int32), 0
    for n, fewest in least:
        matches = matches + (sig[i[alive], done:n] == sig[j[alive], done:n]).sum(1)
        keep = matches >= fewest
        alive, matches, done = alive[keep], matches[keep], n
        if not len(alive):
            break
    return alive


def candidate_pairs(group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs in sorted groups that are to be compared there: of different sides, or any where the side is -1."""
    n = len(group)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, n])
    left = np.repeat(first + sizes, sizes) - np.arange(n) - 1  # members of the group after each
    i = np.repeat(np.arange(n), left)
    start = np.repeat(np.cumsum(left) - left, left)
    j = i + 1 + (np.arange(len(i)) - start)
    ok = (side[i] < 0) | (side[i] != side[j])
    return i[ok], j[ok]


def first_met(sig: np.ndarray, i: np.ndarray, j: np.ndarray, band: np.ndarray, s: Settings) -> np.ndarray:
    """Whether a pair agrees on no band before the one whose bucket it is met in: so it is counted once."""
    same = (sig[i] == sig[j]).reshape(len(i), s.bands, s.rows).all(2)
    return same.argmax(1) == band[i]


def surviving(group: np.ndarray, side: np.ndarray, band: np.ndarray, sig: np.ndarray, s: Settings, least) -> tuple[np.ndarray, np.ndarray]:
    i, j = candidate_pairs(group, side)
    out_i, out_j = [], []
    for at in range(0, len(i), 1 << 15):
        a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        keep = prune(sig, a, b, least)
        a, b = a[keep], b[keep]
        ok = first_met(sig, a, b, band, s)
        out_i.append(a[ok])
        out_j.append(b[ok])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (i, j)


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets i and j."""
    if len(i) < 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    used = np.unique(np.concatenate([i, j]))
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    own = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, ids, count = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    shared = count[ids] > 1
    own, ids = own[shared], ids[shared]
    ids = np.unique(ids, return_inverse=True)[1] if len(ids) else ids
    order = np.argsort(ids, kind="stable")
    own, ids = own[order], ids[order]
    both = np.zeros((len(used), len(used)), np.float64)
    width, top = 4096, int(ids[-1]) + 1 if len(ids) else 0
    for lo in range(0, top, width):
        a, b = np.searchsorted(ids, [lo, lo + width])
        part = np.zeros((len(used), min(width, top - lo)), np.float32)
        part[own[a:b], ids[a:b] - lo] = 1
        both += part @ part.T
    return both[place[i], place[j]].astype(np.int64)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def whole_groups(batches, key: int = 0):
    """Arrow batches sorted by a long in column `key`, cut anew so that no value is in two of them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(k, k[-1]))
        if last == 0 and held and held[-1].column(key)[-1].as_py() == k[-1]:
            held.append(b)
            continue
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks()
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


# ---- the join -------------------------------------------------------------------------------------------------------


def _binary(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def signatures(documents: DataFrame, s: Settings) -> DataFrame:
    """__row, doc_id, __text (identity() of the row), h1, h2 (of the shingle set; null if it is empty), __sig: a written table."""
    sent = documents.select(F.monotonically_increasing_id().alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), identity().alias("__text"), F.col("text").cast("binary").alias("__bytes"))

    def run(batches):
        forget_kept()
        family = minhash_family(s)
        for b in batches:
            h1, h2, sigs = [], [], []
            for text in b.column(3).to_pylist():
                sh = shingles(text, s.words)
                if not len(sh):
                    h1.append(None), h2.append(None), sigs.append(None)
                    continue
                with np.errstate(over="ignore"):
                    h1.append(int(_mix(sh).sum().view(np.int64)))
                    h2.append(int((_mix(sh ^ np.uint64(_ODD)).sum() + np.uint64(len(sh))).view(np.int64)))
                sigs.append(minhash(sh, family).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary())], names=["__row", "doc_id", "__text", "h1", "h2", "__sig"])

    return written(sent.mapInArrow(run, "__row long, doc_id long, __text struct<a:long,b:long>, h1 long, h2 long, __sig binary"), "jaccard-sig")


def _dealt(members: DataFrame, s: Settings) -> DataFrame:
    """Members of buckets (__key, __band, __n, __row) dealt to pairs of blocks: __task, __side, __band, __row."""
    blocks = F.ceil(F.col("__n") / s.block).cast("int")
    mine = F.pmod(F.xxhash64("__row"), blocks).cast("int")
    m = members.select("__key", "__band", "__row", blocks.alias("__blocks"), mine.alias("__mine"))
    m = m.select("*", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__other"))
    return m.select(
        F.when(F.col("__blocks") == 1, F.col("__key")).otherwise(F.xxhash64("__key", F.least("__mine", "__other"), F.greatest("__mine", "__other"))).alias("__task"),
        F.when(F.col("__mine") == F.col("__other"), -1).otherwise(F.col("__mine")).alias("__side"), "__band", "__row")


def links(rows: DataFrame, documents: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Of the classes of signatures(): (classes: h1, h2, __class, __copies), (linked: __class, __other, __links).

    linked has a row for each class and task that found links of it: __links rows (copies counted) in classes linked with
    it, and __other, a class it is joined with; these joins span the components.
    """
    full = rows.where("h1 is not null")
    classes = written(full.groupBy("h1", "h2").agg(F.min("__row").alias("__class"), F.count(F.lit(1)).alias("__copies")), "jaccard-classes")
    kept = classes.join(full.select(F.col("__row").alias("__class"), "__text", "__sig"), "__class")
    sigs = written(kept.select(F.col("__class").alias("__row"), "__copies", "__text", "__sig"), "jaccard-reps")
    width = s.rows * 4
    keyed = sigs.select(
        F.col("__row"),
        F.posexplode(F.array(*(F.xxhash64(F.lit(b), F.substring("__sig", b * width + 1, width)) for b in range(s.bands)))).alias("__band", "__key"),
    )
    counts = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    members = written(keyed.join(counts, "__key").select("__key", "__band", "__n", "__row"), "jaccard-buckets")
    least = least_matches(s)
    dealt = _dealt(members, s).join(sigs.select("__row", "__sig"), "__row").select("__task", "__side", "__band", "__row", "__sig")

    def pruned(batches):
        for t in whole_groups(batches):
            task, side, band, row = (t.column(i).to_numpy() for i in range(4))
            sig = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint32).reshape(len(task), -1)
            i, j = surviving(task, side, band, sig, s, least)
            at = np.unique(np.concatenate([i, j])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (task, side, band, row)], names=["__task", "__side", "__band", "__row"])

    stay = written(dealt.repartition("__task").sortWithinPartitions("__task").mapInArrow(pruned, "__task long, __side int, __band int, __row long"), "jaccard-stay")
    needed = sigs.join(stay.select("__row").distinct(), "__row", "left_semi").select("__row", "__text", "__sig", "__copies")
    texts = documents.select(identity().alias("__text"), F.col("text").cast("binary").alias("__bytes"))
    whole = texts.join(needed, "__text").select("__row", "__copies", "__sig", "__bytes")

    def sets(batches):
        for b in batches:
            out = [shingles(x, s.words).tobytes() for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], names=["__row", "__copies", "__sig", "__set"])

    dealt = stay.join(whole.mapInArrow(sets, "__row long, __copies long, __sig binary, __set binary"), "__row")
    dealt = dealt.select("__task", "__side", "__band", "__row", "__copies", "__sig", "__set")

    def verified(batches):
        for t in whole_groups(batches):
            task, side, band, row, copies = (t.column(i).to_numpy() for i in range(5))
            _, once = np.unique(np.stack([task, row]), axis=1, return_index=True)  # rows that repeat an id and a text
            if len(once) < len(task):
                t = t.take(np.sort(once))
                task, side, band, row, copies = (t.column(i).to_numpy() for i in range(5))
            sig = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint32).reshape(len(task), -1)
            held = _binary(t.column(6))
            size = np.array([len(x) for x in held])
            i, j = surviving(task, side, band, sig, s, least)
            group = task[i]
            cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(i) else []
            links, forest = np.zeros(len(task), np.int64), Forest(len(task))
            for lo, hi in zip(cut, [*cut[1:], len(i)], strict=True):
                a, b = i[lo:hi], j[lo:hi]
                low = a.min()
                n = overlaps(held[low : max(a.max(), b.max()) + 1], a - low, b - low)
                ok = n >= s.threshold * (size[a] + size[b] - n) - 1e-9
                a, b = a[ok], b[ok]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    forest.join(x, y)
            at = np.flatnonzero(links)
            roots = np.array([forest.root(x) for x in at.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(row[roots]), pa.array(links[at])], names=["__class", "__other", "__links"])

    found = dealt.repartition("__task").sortWithinPartitions("__task").mapInArrow(verified, "__class long, __other long, __links long")
    return classes, written(found, "jaccard-links")


def similar(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, class_id, n_links, copy_id, kept, __text for every row of documents.

    class_id: the smallest id of those reachable by links (equal shingle sets or a Jaccard similarity of s.threshold or
    more); n_links: how many other rows a row is linked with directly; copy_id: the smallest id of those with the same
    shingle set; kept: true for one row of each class_id.
    """
    bounded_batches(documents.sparkSession)
    rows = signatures(documents, s)
    classes, linked = links(rows, documents, s)
    parts = written(connected_components(linked.select(F.col("__class").alias("a"), F.col("__other").alias("b"))), "jaccard-components")
    counts = linked.groupBy("__class").agg(F.sum("__links").alias("__links"))
    known = classes.join(counts, "__class", "left").join(parts.withColumnRenamed("id", "__class"), "__class", "left")
    known = known.select("h1", "h2", "__class", (F.coalesce("__links", F.lit(0)) + F.col("__copies") - 1).alias("n_links"), F.coalesce("component", "__class").alias("__part"))
    full = rows.where("h1 is not null").select("__row", "doc_id", "__text", "h1", "h2").join(known, ["h1", "h2"])
    full = written(full.select("__row", "doc_id", "__text", "__class", "__part", "n_links"), "jaccard-rows")
    # the smallest id, and among rows that repeat it the first: partial minima, so a large class is no burden
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("id"), F.col("__row").alias("row")))
    by_part = full.groupBy("__part").agg(first.alias("p"))
    by_class = full.groupBy("__class").agg(first.alias("c"), F.first("__part").alias("__part"))
    ids = by_class.join(by_part, "__part").select("__class", F.col("c.id").alias("copy_id"), F.col("p.id").alias("class_id"), F.col("p.row").alias("__kept"))
    out = full.join(ids, "__class").select("doc_id", "class_id", "n_links", "copy_id", (F.col("__row") == F.col("__kept")).alias("kept"), "__text")
    alone = rows.where("h1 is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_id"), F.lit(True).alias("kept"), "__text")
    return out.unionByName(alone)


def jaccard_query(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    return similar(documents.select("doc_id", "text"), s).drop("__text")


def keep_one(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """documents, whole, without the rows whose class keeps another row."""
    kept = similar(documents.select("doc_id", "text"), s).where("kept").select("__text")
    name = free_name(documents, "__text")
    out = documents.withColumn(name, identity()).join(kept.withColumnRenamed("__text", name), name, "left_semi")
    # rows that repeat both id and text of a kept row go; the join has already brought them together
    return out.dropDuplicates([name]).select(*(F.col(f"`{c}`") for c in documents.columns))

"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

Tokens: words, A-Z lower-cased, and one end for each text. Every token has a cell: a class and one of its `per_class`
members. The most frequent `words` tokens have cells of their own, by rank; all others share the members of `kinds` rare
classes, the class by the token's form and the member by its hash. With h a token's history,
P(token) = P(class | h) P(member | class, h) P(token | cell). The first two factors are softmaxes of sums of weights: of
the class itself, of the word before (n-gram), of the word two before (skip), and, for classes, of both together. Histories
are hashes of the very words, whatever their rank, and lead to hashed rows of weights, whose number follows the number of
distinct tokens. In a shared cell P(token | cell) = (c + 0.5) / (N' + 0.5 (V' + 1)), with the cell's counts, so unseen words
have a share.

Counts cover all training tokens. Training is one pass over all training texts in `rounds` rounds, dealt by a hash of id and
size: each task starts from the current weights, makes gradient steps over its texts in numpy batches, and hands on how its
weights moved and how often it touched each row; sums of these, taken in groups of `fan_in` tasks and then of groups, give
the mean move by touches, the next round's start. Only that mean reaches the driver. Tasks are parts of the table, so
another cut of the table into files gives slightly other weights; reruns on the same files agree.

The most frequent tokens (at most `head`, of up to `head_bytes` bytes each, so a bounded table) are broadcast; the counts of all
others are joined by token, so no table of all tokens is ever in one place.

Defined cases: null and empty texts consist of the end; texts of any length are scored whole; repeated rows count and are
scored row by row; if there are no training texts, every score is that of the counts' priors; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, fields
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_batches, forget_kept, kept_in_worker, stretch_hashes, written

END = b" end"


@dataclass(frozen=True)
class Settings:
    words: int = 2048
    per_class: int = 64
    kinds: int = 16
    head: int = 1 << 18
    head_bytes: int = 64
    #: Rows of weights for each kind of history: a power of two near the distinct tokens over types_a_row, but not above a
    #: training task's tokens over tokens_a_row, which keeps what tasks hand on in proportion to what they read; within these.
    types_a_row: int = 64
    tokens_a_row: int = 700
    least_rows: int = 1 << 10
    most_rows: int = 1 << 16
    rounds: int = 2
    rate: float = 0.25
    batch: int = 4096
    fan_in: int = 32
    #: Distinct tokens that a counting task holds before it hands them on.
    held: int = 250_000
    #: Bytes of text encoded together.
    together: int = 1 << 19
    folds: int = 5
    held_out: int = 1

    @property
    def classes(self) -> int:
        return self.words // self.per_class + self.kinds

    @property
    def rare_cells(self) -> int:
        return self.kinds * self.per_class

    def rows(self, distinct: int, tokens_a_task: int) -> int:
        near = min(distinct // self.types_a_row, tokens_a_task // self.tokens_a_row)
        return min(self.most_rows, max(self.least_rows, 1 << near.bit_length()))


def tokens(text: bytes | None) -> list[bytes]:
    out = (text or b"").lower().split()
    out.append(END)
    return out


_BLANK = np.zeros(256, bool)
_BLANK[np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)] = True
#: Hashes of the end, which holds a blank, so it is read from no text.
END_HASHES = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))


@dataclass
class Words:
    """What is known of tokens from their bytes alone."""

    hash: np.ndarray
    other: np.ndarray  # 64 bits more
    rare: np.ndarray  # the rare cell each would have: its class by its form, its member by its hash
    symbol: np.ndarray  # what each is in histories: 16 bits of hash, the start of a text being 0


def describe(codes: np.ndarray, start: np.ndarray, end: np.ndarray, s: Settings) -> Words:
    """codes: lower-cased bytes; a token of no bytes is the end."""
    h, other = stretch_hashes(codes, start, end), stretch_hashes(codes, start, end, 1)
    last, n = codes[end - 1] if len(codes) else np.zeros(len(end), np.uint8), end - start
    high = np.append(0, np.cumsum(codes > 127, dtype=np.int32))
    mark = np.isin(last, np.frombuffer(b".,;:?", np.uint8))
    k = np.where((last >= 97) & (last <= 122), 0, np.where(mark, 1, np.where(last < 128, 2, 3)))
    k = ((k << 2) | ((n > 9) << 1) | (high[end] > high[start])) % s.kinds
    is_end = n == 0
    h[is_end], other[is_end], k[is_end] = *END_HASHES, 0
    rare = k * s.per_class + ((h >> np.uint64(20)) % np.uint64(s.per_class)).astype(np.int64)
    return Words(h, other, rare, ((h >> np.uint64(40)) % np.uint64(65535)).astype(np.uint16) + np.uint16(1))


def describe_tokens(words: list[bytes], s: Settings) -> Words:
    """In portions of `together` bytes, since hashing needs many times the bytes of what is hashed at once."""
    n = np.fromiter((0 if w == END else len(w) for w in words), np.int64, len(words))
    portion = np.cumsum(n) // s.together
    cuts = [0, *(np.flatnonzero(portion[1:] != portion[:-1]) + 1).tolist(), len(words)]
    parts = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        ends = np.cumsum(n[a:b])
        parts.append(describe(np.frombuffer(b"".join(w for w in words[a:b] if w != END), np.uint8), ends - n[a:b], ends, s))
    return Words(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Words)))


class Places:
    """Numbers of tokens by their hashes: a table with open addressing, looked up for many at once."""

    def __init__(self, h: np.ndarray, other: np.ndarray):
        self.bits = max(8, (4 * len(h)).bit_length())
        self.other, self.at = other, np.full(1 << self.bits, -1, np.int32)
        self.h, todo, step = h, np.arange(len(h)), 0
        while len(todo):
            slot = self._slot(h[todo], step)
            free = self.at[slot] < 0
            self.at[slot[free]] = todo[free]
            todo, step = todo[self.at[slot] != todo], step + 1

    def _slot(self, h: np.ndarray, step: int) -> np.ndarray:
        return ((h >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def get(self, h: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The number of each token, -1 if it has none."""
        if not len(self.h):
            return np.full(len(h), -1, np.int64)
        out, todo, step = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        while len(todo):
            found = self.at[self._slot(h[todo], step)]
            hit = (found >= 0) & (self.h[found] == h[todo]) & (self.other[found] == other[todo])
            out[todo[hit]] = found[hit]
            todo, step = todo[~hit & (found >= 0)], step + 1
        return out


#: Rows of a stretch that are summed one after another.
PIECE = 16


def segment_sums(q: np.ndarray, first: np.ndarray, n: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Sums of stretches of rows of q (of q[order], if given; from `first`, n each). A stretch is cut into pieces, the pieces
    are summed side by side, longest ones first, and so are then their sums. Nothing is moved at the end where n falls."""
    while True:
        most, k = int(n.max()), -(-n // PIECE)
        begin = np.cumsum(k) - k
        if most > PIECE:
            done = PIECE * (np.arange(k.sum()) - np.repeat(begin, k))
            first, n = np.repeat(first, k) + done, np.minimum(np.repeat(n, k) - done, PIECE)
        by = np.argsort((PIECE - n).astype(np.uint8), kind="stable")
        longer = (len(n) - np.cumsum(np.bincount(n, minlength=PIECE + 1))).tolist()
        at = first[by]
        out = q.take(at if order is None else order[at], axis=0)
        for j in range(1, min(most, PIECE)):
            x = at[: longer[j]] + j
            out[: longer[j]] += q.take(x if order is None else order[x], axis=0)
        back = np.empty_like(by)
        back[by] = np.arange(len(by))
        if most <= PIECE:
            return out if (by[1:] > by[:-1]).all() else out.take(back, axis=0)
        q, first, n, order = out, begin, k, back


class Weights:
    """One flat float32 array: class rows (itself, word before, word two before, pair) and member rows."""

    def __init__(self, s: Settings, rows: int, flat: np.ndarray | None = None):
        self.s, self.rows = s, rows
        self.class_rows, self.member_rows = 1 + 3 * rows, s.classes + 2 * rows
        a = self.class_rows * s.classes
        self.flat = np.zeros(a + self.member_rows * s.per_class, np.float32) if flat is None else flat
        self.by_class = self.flat[:a].reshape(self.class_rows, s.classes)
        self.by_member = self.flat[a:].reshape(self.member_rows, s.per_class)

    def _hashed(self, x: np.ndarray, rows: int) -> np.ndarray:
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (rows.bit_length() - 1))).astype(np.int64)

    def class_features(self, h1, h2):
        r, a, b = self.rows, h1.astype(np.uint64), h2.astype(np.uint64)
        return 1 + self._hashed(a, r), 1 + r + self._hashed(b, r), 1 + 2 * r + self._hashed((a << np.uint64(16)) | b, r)

    def member_features(self, h1, h2, c):
        c_, n = c.astype(np.uint64) << np.uint64(17), self.s.classes
        return c, *(n + self._hashed(c_ | (h.astype(np.uint64) << np.uint64(1)) | np.uint64(salt), 2 * self.rows) for h, salt in ((h1, 0), (h2, 1)))

    @staticmethod
    def _softmax(table, common, rows, y):
        """(exp(z), its sums, log P(y)) for the sums z of the rows, and of the row `common` of all, if there is one."""
        z = table.take(rows[0], axis=0)
        if common is not None:
            z += table[common]
        for r in rows[1:]:
            z += table.take(r, axis=0)
        # where no number is large, nothing has to be taken off before exp
        if len(z) and max(z.max(), -z.min()) > 60:
            z -= z.max(1, keepdims=True)
        hit = z[np.arange(len(y)), y]
        p = np.exp(z, out=z)
        total = np.einsum("ij->i", p)
        return p, total, hit - np.log(total)

    def log_p(self, cell, h1, h2) -> np.ndarray:
        """Natural logs of P(class) P(member | class)."""
        c, member = np.divmod(cell, self.s.per_class)
        _, _, out = self._softmax(self.by_class, 0, self.class_features(h1, h2), c)
        _, _, more = self._softmax(self.by_member, None, self.member_features(h1, h2, c), member)
        return out.astype(np.float64) + more

    def learn(self, cell, h1, h2, rate: float, touched: dict) -> None:
        """One step on a batch."""
        c, member = np.divmod(cell, self.s.per_class)
        self._step(self.by_class, 0, (self.class_features(h1, h2),), c, rate, touched["class"])
        # (the rows of words before and two before are of one range, so they are moved in turn)
        own, before, skip = self.member_features(h1, h2, c)
        self._step(self.by_member, None, ((own, before), (skip,)), member, rate, touched["member"])

    def _step(self, table, common, groups, y, rate, touched) -> None:
        """groups: kinds of rows, those of a group having no row in common."""
        p, total, _ = self._softmax(table, common, [r for rows in groups for r in rows], y)
        p /= total[:, None]
        p[np.arange(len(y)), y] -= 1
        # a row's steps fall with the root of how often it was touched
        if common is not None:
            touched[common] += len(y)
            table[common] -= np.float32(rate / np.sqrt(len(y) * touched[common])) * p.sum(0)
        for rows in groups:
            # 16 bits are sorted by their digits
            r = np.concatenate(rows)
            order = np.argsort(r.astype(np.uint16) if len(table) <= 1 << 16 else r, kind="stable")
            key = r[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.append(first, len(key)))
            falling = np.argsort(-np.minimum(n, 1 << 14).astype(np.int16), kind="stable")
            first, n = first[falling], n[falling]
            at = key[first]
            g = segment_sums(p, first, n, order % len(y))
            touched[at] += n
            g *= (rate / np.sqrt(n * touched[at])).astype(np.float32)[:, None]
            table[at] = np.subtract(table.take(at, axis=0), g, out=g)


def histories(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two before each, texts starting anew at `ends` (of each text, in flat)."""
    starts = np.concatenate([[0], ends[:-1]])
    h1 = np.empty_like(flat)
    h1[1:] = flat[:-1]
    h1[starts] = 0
    h2 = np.empty_like(flat)
    h2[1:] = h1[:-1]
    h2[starts] = 0
    return h1, h2


def _held_out(s: Settings):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % s.folds == s.held_out, F.lit(False))


def count_tokens(documents: DataFrame, s: Settings) -> DataFrame:
    """token binary, c long, k int (rare cell) over all training texts: counted in each task, then summed by token."""

    def run(batches):
        def out():
            keys = list(counts)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(list(counts.values()), pa.int64()), pa.array(describe_tokens(keys, s).rare, pa.int32())], names=["token", "c", "k"])

        forget_kept()
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                counts.update(tokens(text))
                if len(counts) > s.held:
                    yield out()
                    counts = Counter()
        yield out()

    parts = documents.where(~_held_out(s)).select(F.col("text").cast("binary").alias("t")).mapInArrow(run, "token binary, c long, k int")
    return written(parts.groupBy("token").agg(F.sum("c").alias("c"), F.first("k").alias("k")), "lm-counts")


@dataclass
class Vocabulary:
    s: Settings
    head: list  # tokens by rank
    log_c: np.ndarray  # log10(c + 0.5) of the head
    cell: np.ndarray  # of the head
    total: int
    distinct: int
    rare_log: np.ndarray  # log10 of each rare cell's N' + 0.5 (V' + 1)
    #: Of weights; set when the number of training tasks is known.
    rows: int = 0


def vocabulary(counts: DataFrame, s: Settings) -> Vocabulary:
    # a histogram of counts, of some thousand rows at most, tells from which count on all tokens fit the head: none are sorted
    few, level = counts.where(F.octet_length("token") <= s.head_bytes), F.floor(F.ln("c") * 64).cast("int")
    least, room = None, s.head
    for r in sorted(few.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        room -= r.n
        if room < 0:
            break
        least = r.l
    top = few.where(level >= least if least is not None else F.lit(False)).toArrow().sort_by([("c", "descending"), ("token", "ascending")])
    head, c, k = top.column("token").to_pylist(), top.column("c").to_numpy().astype(np.float64), top.column("k").to_numpy()
    sums = {r.k: (r.n, r.v) for r in counts.groupBy("k").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}  # one row a rare cell
    n, v = np.zeros(s.rare_cells), np.zeros(s.rare_cells)
    for i, (a, b) in sums.items():
        n[i], v[i] = a, b
    total, distinct = int(n.sum()), int(v.sum())
    np.subtract.at(n, k[: s.words], c[: s.words])
    np.subtract.at(v, k[: s.words], 1)
    cell = np.where(np.arange(len(c)) < s.words, np.arange(len(c)), s.words + k)
    return Vocabulary(s, head, np.log10(c + 0.5), cell.astype(np.int64), total, distinct, np.log10(n + 0.5 * (v + 1)))


class Reader:
    """Reads texts with the head's tokens by number; all else is told from tokens' bytes."""

    def __init__(self, v: Vocabulary):
        self.v, self.s = v, v.s
        w = describe_tokens(v.head, v.s)
        self.places = Places(w.hash, w.other)
        self.log_c = np.append(v.log_c, 0.0)

    def read(self, texts: list) -> list[tuple]:
        """Of each text: number of tokens, of those of the head, base and fixed logs of the head, cells, symbols, tail, tail_n."""
        v, s = self.v, self.s
        raw = b"\n".join([t or b"" for t in texts]).lower() + b"\n"
        codes = np.frombuffer(raw, np.uint8)
        blank = _BLANK[codes]
        # (each text is followed by a blank)
        start = np.flatnonzero(~blank & np.append(True, blank[:-1]))
        end = np.flatnonzero(blank & np.append(False, ~blank[:-1]))
        sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts)) + 1
        ends = np.cumsum(sizes)
        k = np.diff(np.searchsorted(start, np.append(ends - sizes, ends[-1])))
        # the end of each text, a token of no bytes, after its words
        at = np.cumsum(k)
        start, end = np.insert(start, at, ends - 1), np.insert(end, at, ends - 1)
        n = k + 1
        firsts = np.cumsum(n) - n
        w = describe(codes, start, end, s)
        ids = self.places.get(w.hash, w.other)
        tail = ids < 0
        cell = np.where(tail, s.words + w.rare, v.cell[ids] if len(v.cell) else 0).astype(np.uint16)
        log_c = self.log_c[ids]
        rare = cell >= s.words
        fixed = np.where(rare, log_c - v.rare_log[np.where(rare, cell - np.uint16(s.words), 0)], 0.0)
        known, logs, fix = (np.add.reduceat(x, firsts).tolist() for x in (~tail * 1, log_c, fixed))
        cells, syms = memoryview(cell.tobytes()), memoryview(w.symbol.tobytes())
        at = np.flatnonzero(tail)
        cut = np.searchsorted(at, np.append(firsts, len(ids))).tolist()
        words = [raw[a:b] if b > a else END for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        out = []
        for i, (a, m) in enumerate(zip(firsts.tolist(), n.tolist(), strict=True)):
            c = Counter(words[cut[i] : cut[i + 1]])
            out.append((m, known[i], logs[i], fix[i], cells[2 * a : 2 * (a + m)], syms[2 * a : 2 * (a + m)], list(c), list(c.values())))
        return out


def portions(batch: pa.RecordBatch, s: Settings):
    """Parts of a batch, whose last column are texts, of up to `together` bytes of text or of one row."""
    sizes, i = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist(), 0
    while i < len(sizes):
        j, size = i + 1, sizes[i]
        while j < len(sizes) and size + sizes[j] <= s.together:
            size += sizes[j]
            j += 1
        yield batch.slice(i, j - i)
        i = j


def encode(documents: DataFrame, v: Vocabulary) -> DataFrame:
    """A written table: __row, doc_id, held_out, n_tokens, head_known, head_log (log10(c + 0.5) summed over head tokens),
    fixed (the same over rare ones, less their cell's share), cells and symbols (uint16s), tail, tail_n (tokens outside the head)."""
    s = v.s
    shared = documents.sparkSession.sparkContext.broadcast(v)
    names = ["__row", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "fixed", "cells", "symbols", "tail", "tail_n"]
    types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
    mark = crc32(repr((v.total, v.distinct, v.head[:1000])).encode())

    def run(batches):
        reader = kept_in_worker(("lm", s, mark), lambda: Reader(shared.value))
        for b in batches:
            # each portion is handed on before the next is read: their many small objects would pile up
            for part in portions(b, s):
                got = list(zip(*reader.read(part.column(3).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(x, t) for x, t in zip(got, types, strict=True))], names=names)

    sent = documents.select(F.monotonically_increasing_id().alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), _held_out(s).alias("held_out"), F.col("text").cast("binary").alias("t"))
    return written(sent.mapInArrow(run, "__row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, fixed double, cells binary, symbols binary, tail array<binary>, tail_n array<int>"), "lm-encoded")


def _texts(cells, symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cells, symbols before, symbols two before, ends of texts) of a batch."""
    raw = cells.to_pylist()
    ends = np.cumsum([len(x) // 2 for x in raw])
    h1, h2 = histories(np.frombuffer(b"".join(symbols.to_pylist()), np.uint16), ends)
    return np.frombuffer(b"".join(raw), np.uint16), h1, h2, ends


def counted_weights(v: Vocabulary) -> Weights:
    """The weights of training without histories: classes and members weigh as often as they occur."""
    s, w = v.s, Weights(v.s, v.rows)
    c = np.full(s.words, 0.5)
    c[: len(v.head)] = 10 ** v.log_c[: s.words]
    c = np.concatenate([c, 10**v.rare_log]).reshape(-1, s.per_class)
    w.by_member[: s.classes] = np.log(c / c.sum(1, keepdims=True))
    w.by_class[0] = np.log(c.sum(1) / c.sum())
    return w


def train(encoded: DataFrame, v: Vocabulary) -> Weights:
    """Rounds of local gradient steps and averaging; each training text is in one round."""
    spark, s = encoded.sparkSession, v.s
    tasks = encoded.rdd.getNumPartitions()
    v.rows = s.rows(v.distinct, v.total // max(1, tasks * s.rounds))
    now = counted_weights(v)
    rows = np.concatenate([np.repeat(np.arange(now.class_rows), s.classes), now.class_rows + np.repeat(np.arange(now.member_rows), s.per_class)])
    chunks = max(16, len(now.flat) >> 17)
    size = -(-len(now.flat) // chunks)
    bounds = [(rows[i * size], rows[min((i + 1) * size, len(rows)) - 1] + 1) if i * size < len(rows) else (0, 0) for i in range(chunks)]
    for turn in range(s.rounds):
        shared = spark.sparkContext.broadcast(now.flat)

        def run(batches, turn=turn, shared=shared):
            forget_kept()
            start = np.concatenate([np.full(now.class_rows, 20.0 + 2000.0 * turn), np.full(now.member_rows, 20.0 + 200.0 * turn)])
            w, touched = Weights(s, v_rows, shared.value.copy()), start.copy()
            parts = {"class": touched[: w.class_rows], "member": touched[w.class_rows :]}
            for b in batches:
                cells, h1, h2, _ = _texts(b.column(0), b.column(1))
                order = np.random.default_rng(len(cells)).permutation(len(cells))
                for i in range(0, len(cells), s.batch):
                    at = order[i : i + s.batch]
                    w.learn(cells[at].astype(np.int64), h1[at], h2[at], s.rate, parts)
            n = (touched - start).astype(np.float32)
            if n.any():
                from pyspark import TaskContext

                group = TaskContext.get().partitionId() // s.fan_in
                each = np.concatenate([np.repeat(n[: w.class_rows], s.classes), np.repeat(n[w.class_rows :], s.per_class)])
                for i, (a, b) in enumerate(bounds):
                    part = slice(i * size, (i + 1) * size)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([group], pa.int32()), pa.array([((w.flat[part] - shared.value[part]) * each[part]).tobytes()], pa.binary()), pa.array([n[a:b].tobytes()], pa.binary())], names=names)

        def add(batches):
            """Sums of moves and touches by chunk and group; groups of groups have the next numbers."""
            sums: dict = {}
            for b in batches:
                for i, g, w, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    w, n = np.frombuffer(w, np.float32), np.frombuffer(n, np.float32)
                    if (i, g) in sums:
                        sums[i, g][0] += w
                        sums[i, g][1] += n
                    else:
                        sums[i, g] = [w.copy(), n.copy()]
            for (i, g), (w, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([g // s.fan_in], pa.int32()), pa.array([w.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=names)

        names, v_rows, form = ["chunk", "grp", "w", "n"], v.rows, "chunk int, grp int, w binary, n binary"
        mine = encoded.where(~F.col("held_out") & (F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(s.rounds)) == turn)).select("cells", "symbols")
        moved, groups = mine.mapInArrow(run, form), -(-tasks // s.fan_in)
        while True:
            moved = moved.repartition("chunk", "grp").mapInArrow(add, form)
            if groups <= 1:
                break
            groups = -(-groups // s.fan_in)
        flat = now.flat.copy()
        for r in moved.toLocalIterator():
            part = slice(r.chunk * size, (r.chunk + 1) * size)
            a, b = bounds[r.chunk]
            n = np.frombuffer(r.n, np.float32)[rows[part] - a]
            flat[part] += np.frombuffer(r.w, np.float32) / np.maximum(n, 1)
        now = Weights(s, v.rows, flat)
        shared.unpersist()
    return now


def score(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of documents."""
    spark = documents.sparkSession
    bounded_batches(spark, 8)
    counts = count_tokens(documents, s)
    v = vocabulary(counts, s)
    encoded = encode(documents, v)
    model = train(encoded, v)
    shared, rows = spark.sparkContext.broadcast(model.flat), model.rows

    def run(batches):
        w = Weights(s, rows, shared.value)
        for b in batches:
            cells, h1, h2, ends = _texts(b.column(0), b.column(1))
            out = np.concatenate([w.log_p(cells[i : i + s.batch].astype(np.int64), h1[i : i + s.batch], h2[i : i + s.batch]) for i in range(0, len(cells), s.batch)])
            sums = np.add.reduceat(out, np.concatenate([[0], ends[:-1]])) / np.log(10)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(sums)], names=[*names, "__model"])

    names = ["__row", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "fixed"]
    modelled = encoded.select("cells", "symbols", *names).mapInArrow(run, "__row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, fixed double, __model double")
    tail = encoded.select("__row", F.explode(F.arrays_zip("tail", "tail_n")).alias("x")).select("__row", F.col("x.tail").alias("token"), F.col("x.tail_n").alias("n"))
    # (a token outside the head occurs at most as often as the head's last one: none is hot)
    tail = tail.join(counts.select("token", "c"), "token", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    tail = tail.groupBy("__row").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("__tail"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("__known"))
    log_all = float(np.log10(v.total + 0.5 * (v.distinct + 1)))
    rare = F.coalesce("__tail", F.lit(0.0))
    return modelled.join(tail, "__row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("__known", F.lit(0))).cast("long").alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("head_log") + rare - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), (F.col("__model") + F.col("fixed") + rare).alias("score"))

"""SentencePiece encoding with seeded merge dropout, and lossless decoding.

The vocabulary (pieces and scores) of a given merge-type model is used; nothing is trained. A text is cut into units, none
of which a piece can span: a run of spaces with the run of other characters after it, and newlines by themselves. In a
unit, an agenda holds the pairs of neighbours whose union is a piece; turn by turn the pair of the best score (the leftmost
among equals) is taken, unless a keyed hash of the document's id, the unit's ordinal and the turn skips it, which it does
with probability `dropout`: then the pair leaves the agenda until one of its sides changes. Every occurrence of a unit has
its own draws, and reruns agree. Characters that are not pieces become their UTF-8 bytes' pieces.

The agendas of many units run side by side in numpy: a turn is one step in all of them. Distinct units are numbered once in
a worker and keep their cut without skips and its number of turns; an occurrence that no skip meets within these turns has
that cut, and only the others run an agenda of their own.

Without dropout the ids are those of the model's library for a text whose first space the library put there itself. Decoding is lossless for
every text: a space is the mark U+2581, and a mark that the text itself holds is written as bytes.

Defined cases: null and empty texts have no ids and decode to the empty text; texts of any length are encoded whole
(units of over `long_unit` characters by a heap); repeated rows are encoded row by row; a null doc_id counts as 0; an empty
table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import bounded_batches, free_name, kept_in_worker

MARK = "▁"
#: No pair; and the width of a symbol's field in a pair's key, and of a place's field beside a rank.
NONE, SYMBOL_BITS, PLACE_BITS = (1 << 31) - 1, 21, 6


@dataclass(frozen=True)
class Settings:
    model: str = "/opt/tokenizers/piece_bpe_32k.model"
    dropout: float = 0.1
    seed: int = 3
    #: Distinct units that a worker keeps; beyond that it starts anew.
    cache: int = 120_000
    #: Characters of the longest unit that runs side by side with others; 63 at most.
    long_unit: int = 48
    #: Bytes of text, and agendas, taken together.
    together: int = 1 << 19
    rows: int = 1 << 15


class Pieces:
    """A vocabulary: symbols (pieces by rank, then other characters of pieces), and the ids of pieces and bytes."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], model: bytes = b""):
        self.model = model
        order = sorted((i for i, k in enumerate(kinds) if k == "normal"), key=lambda i: (-scores[i], i))
        self.rank = {pieces[i]: r for r, i in enumerate(order)}
        self.id = {pieces[i]: i for i in order}
        self.ids_by_rank = order
        self.bytes = [0] * 256
        self.raw: list[bytes] = [b""] * len(pieces)
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == "byte":
                self.bytes[int(p[3:-1], 16)] = i
                self.raw[i] = bytes([int(p[3:-1], 16)])
            elif k == "normal":
                self.raw[i] = p.replace(MARK, " ").encode()
        self.alone = "\n" not in "".join(self.id)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
        return cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], [kind(i) for i in range(n)], model)


class Pairs:
    """Which pairs of symbols are pieces: a table with open addressing, looked up for many pairs at once."""

    def __init__(self, found: dict[int, int]):
        self.bits = max(8, (8 * len(found)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        todo, step = np.fromiter(found, np.int64, len(found)), 0
        values = np.fromiter(found.values(), np.int32, len(found))
        while len(todo):
            at = self._slot(todo, step)
            free = self.keys[at] < 0
            self.keys[at[free]] = todo[free]
            placed = self.keys[at] == todo
            self.values[at[placed]] = values[placed]
            todo, values, step = todo[~placed], values[~placed], step + 1

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        x = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (x.astype(np.int64) + step) & ((1 << self.bits) - 1)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbol of each a + b, NONE if it is no piece; -1 stands for no symbol."""
        keys = ((a.astype(np.int64) + 1) << SYMBOL_BITS) | (b.astype(np.int64) + 1)
        at = self._slot(keys, 0)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], NONE)
        far = np.flatnonzero((held != keys) & (held >= 0))
        step = 1
        while len(far):
            at = self._slot(keys[far], step)
            held = self.keys[at]
            out[far] = np.where(held == keys[far], self.values[at], NONE)
            far, step = far[(held != keys[far]) & (held >= 0)], step + 1
        return out


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.room, self.n = np.empty(1 << 12, dtype), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.empty(self.n + len(more), self.room.dtype)])
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)


class Encoder:
    def __init__(self, vocabulary: Pieces, s: Settings):
        self.v, self.s = vocabulary, s
        v = vocabulary
        assert s.long_unit < 1 << PLACE_BITS
        self.cut = re.compile(rb"\n| *[^ \n]+| +" if v.alone else rb" *[^ ]+| +").findall
        #: A turn is skipped if its hash is below this.
        self.below = np.uint64(min(1 << 32, max(0, round(s.dropout * (1 << 32)))))
        symbol = dict(v.rank)
        for p in v.rank:
            for c in p:
                symbol.setdefault(c, len(symbol))
        pairs = {}
        for p, r in v.rank.items():
            for i in range(1, len(p)):
                a, b = symbol.get(p[:i]), symbol.get(p[i:])
                if a is not None and b is not None:
                    pairs[(a + 1) << SYMBOL_BITS | (b + 1)] = r
        self.pairs, self.pair = Pairs(pairs), pairs
        #: Symbols of code points; -1 before one is met that no piece holds.
        self.of_char = np.full(0x110000, -1, np.int32)
        self.out_start, self.out_n, self.out = Grown(np.int64), Grown(np.int64), Grown(np.int32)
        self.out_start.add(np.arange(len(v.ids_by_rank)))
        self.out_n.add(np.ones(len(v.ids_by_rank), np.int64))
        self.out.add(np.array(v.ids_by_rank, np.int32))
        for c, i in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
            if i >= len(v.rank):
                self._new_symbol(c.encode())
        # a space is the mark's symbol, and a mark of the text has one of its own, which no piece holds
        self.of_char[0x20] = self.of_char[ord(MARK)]
        self.of_char[ord(MARK)] = self.out_n.n
        self._new_symbol(MARK.encode())
        if self.of_char[0x20] < 0:
            self.of_char[0x20] = self.out_n.n
            self._new_symbol(b" ")
        self._forget()

    def _new_symbol(self, raw: bytes) -> None:
        self.out_start.add(np.array([self.out.n]))
        self.out_n.add(np.array([len(raw)]))
        self.out.add(np.array([self.v.bytes[b] for b in raw], np.int32))

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        # of each unit: where its symbols (and the pieces they make with the next) are, where its cut without skips is, and its turns
        self.start, self.n, self.cut_start, self.cut_n, self.turns = (Grown(np.int64) for _ in range(5))
        self.symbols, self.next_pair, self.cuts = Grown(np.int32), Grown(np.int32), Grown(np.int32)

    # ---- skips ------------------------------------------------------------------------------------------------------

    def keys(self, doc_ids: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
        """A 64-bit key for each unit of a text."""
        x = doc_ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ordinals.astype(np.uint64) + np.uint64(self.s.seed << 40)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)

    def skips(self, keys: np.ndarray, turn: int) -> np.ndarray:
        """Whether the candidate of this turn (from 0) is skipped."""
        x = (keys ^ (keys >> np.uint64(31))) + np.uint64((turn + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(32)) < self.below

    # ---- agendas ----------------------------------------------------------------------------------------------------

    def agendas(self, units: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, how many for each unit, turns of each) of numbered units, in order; without keys nothing is skipped."""
        n = self.n.room[units]
        counts, turns = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
        order = np.argsort(n, kind="stable")
        parts = []
        for i in range(0, len(order), self.s.rows):
            rows = order[i : i + self.s.rows]
            got, counts[rows], turns[rows] = self._run(units[rows], n[rows], None if keys is None else keys[rows])
            parts.append(got)
        flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
        # back from the order of lengths
        sizes = counts[order]
        place = np.empty(len(units), np.int64)
        place[order] = np.cumsum(sizes) - sizes
        return flat[ranges(place, counts)], counts, turns

    def _run(self, units, n, keys):
        """The agendas of units of similar lengths: rows are places, columns units; the last row is no place."""
        wide, m = int(n.max()), len(units)
        place = np.arange(wide + 1)[:, None]
        at = np.minimum(self.start.room[units] + place, max(0, self.symbols.n - 1))
        inside = place < n
        part = np.where(inside, self.symbols.room[at], -1).astype(np.int32)
        made = self.next_pair.room[at]
        rank = np.where(inside & (made != NONE), (made << PLACE_BITS) | place.astype(np.int32), NONE).astype(np.int32)
        after = np.where(place + 1 < n, place + 1, wide).astype(np.int16).ravel()
        before = np.where(place > 0, place - 1, wide).astype(np.int16)
        before = np.broadcast_to(before, (wide + 1, m)).copy().ravel()
        flat, ranks, turns = part.ravel(), rank.ravel(), np.zeros(m, np.int64)
        turn = 0
        while True:
            best = rank.min(axis=0)
            live = np.flatnonzero(best != NONE)
            if not len(live):
                break
            turns[live] += 1
            i = (best[live] & ((1 << PLACE_BITS) - 1)).astype(np.int64)
            ranks[i * m + live] = NONE
            if keys is not None:
                stay = ~self.skips(keys[live], turn)
                live, i = live[stay], i[stay]
            turn += 1
            if not len(live):
                continue
            left = i * m + live
            new = best[live] >> PLACE_BITS
            right = after[left].astype(np.int64) * m + live
            flat[left], flat[right], ranks[right] = new, -1, NONE
            k = after[right]
            after[left] = k
            far = k.astype(np.int64) * m + live
            before[far] = i
            h = before[left]
            near = h.astype(np.int64) * m + live
            # both new pairs, with the place of their left side
            sides = np.concatenate([new, flat[near]])
            pair = self.pairs.get(sides, np.concatenate([flat[far], new]))
            at = np.concatenate([i, h])
            ranks[np.concatenate([left, near])] = np.where((sides >= 0) & (pair != NONE), (pair << PLACE_BITS) | at, NONE)
        out = part[:wide].T
        stay = out >= 0
        return out[stay], stay.sum(1), turns

    def merge_long(self, chars: list[int], key: int | None) -> list[int]:
        """The same agenda as a heap, for one long unit of symbols."""
        n, pair = len(chars), self.pair
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        version, heap, turn = [0] * n, [], 0
        draws: np.ndarray = np.empty(0, bool)

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (r := pair.get((chars[i] + 1) << SYMBOL_BITS | (chars[after[i]] + 1))) is not None:
                heapq.heappush(heap, (r, i, version[i], version[after[i]]))

        for i in range(n):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or version[i] != a or version[j] != b:
                continue
            if key is not None:
                if turn >= len(draws):
                    draws = np.concatenate([draws, [bool(self.skips(np.array([key], np.uint64), t)[0]) for t in range(turn, turn + 256)]])
                turn += 1
                if draws[turn - 1]:
                    continue
            chars[i] = r
            version[i] += 1
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [c for c, x in zip(chars, alive, strict=True) if x]

    # ---- units ------------------------------------------------------------------------------------------------------

    def spell(self, text: str) -> np.ndarray:
        """The symbols of characters."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.of_char[codes]
        if len(out) and out.min() < 0:
            for c in np.unique(codes[out < 0]).tolist():
                self.of_char[c] = self.out_n.n
                self._new_symbol(chr(c).encode("utf-8", "surrogateescape"))
            out = self.of_char[codes]
        return out

    def learn(self, new: list[bytes]) -> None:
        """Numbers units, with their cuts without skips; long ones get a number and nothing else."""
        texts = [u.decode("utf-8", "surrogateescape") for u in new]
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        long = n > self.s.long_unit
        if long.any():
            texts = [t if k <= self.s.long_unit else "" for t, k in zip(texts, n.tolist(), strict=True)]
            n[long] = 0
        symbols = self.spell("".join(texts))
        pair = np.full(len(symbols), NONE, np.int32)
        pair[:-1] = self.pairs.get(symbols[:-1], symbols[1:])
        ends = np.cumsum(n)
        pair[ends[n > 0] - 1] = NONE
        first = self.n.n
        self.start.add(self.symbols.n + ends - n)
        self.n.add(n)
        self.symbols.add(symbols)
        self.next_pair.add(pair)
        self.number.update(zip(new, range(first, first + len(new)), strict=True))
        cut, counts, turns = self.agendas(np.arange(first, first + len(new)), None)
        self.cut_start.add(self.cuts.n + np.cumsum(counts) - counts)
        self.cut_n.add(counts)
        self.cuts.add(cut)
        turns[long] = -1
        self.turns.add(turns)

    def encode_texts(self, texts: list[bytes | None], doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        flat, counts, i = [], [], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j] or b"") <= self.s.together):
                size += len(texts[j] or b"")
                j += 1
            ids, n = self._encode(texts[i:j], doc_ids[i:j])
            flat.append(ids)
            counts.append(n)
            i = j
        return (np.concatenate(flat), np.concatenate(counts)) if flat else (np.empty(0, np.int32), np.empty(0, np.int64))

    def _encode(self, texts, doc_ids):
        per = [self.cut(t) if t else [] for t in texts]
        lengths = np.fromiter(map(len, per), np.int64, len(per))
        units = [u for x in per for u in x]
        if not units:
            return np.empty(0, np.int32), lengths
        if len(self.number) > self.s.cache:
            self._forget()
        numbers = list(map(self.number.get, units))
        if None in numbers:
            self.learn(list(dict.fromkeys(u for u, x in zip(units, numbers, strict=True) if x is None)))
            numbers = list(map(self.number.get, units))
        unit = np.array(numbers, np.int64)
        firsts = np.cumsum(lengths) - lengths
        keys = self.keys(np.repeat(doc_ids, lengths), np.arange(len(unit)) - np.repeat(firsts, lengths))
        turns = self.turns.room[unit]
        # occurrences that a skip meets before the agenda would end without one
        met, rest, turn = np.zeros(len(unit), bool), np.flatnonzero(turns > 0), 0
        while self.below and len(rest):
            hit = self.skips(keys[rest], turn)
            met[rest[hit]] = True
            turn += 1
            rest = rest[~hit & (turns[rest] > turn)]
        own = np.flatnonzero(met)
        start, n = self.cut_start.room[unit], self.cut_n.room[unit]
        held = [self.cuts.room[: self.cuts.n]]
        if len(own):
            got, counts, _ = self.agendas(unit[own], keys[own])
            start[own], n[own] = self.cuts.n + np.cumsum(counts) - counts, counts
            held.append(got)
        size = sum(map(len, held))
        for i in np.flatnonzero(turns < 0).tolist():
            got = self.merge_long(self.spell(units[i].decode("utf-8", "surrogateescape")).tolist(), int(keys[i]) if self.below else None)
            held.append(np.array(got, np.int32))
            start[i], n[i] = size, len(got)
            size += len(got)
        symbols = (np.concatenate(held) if len(held) > 1 else held[0])[ranges(start, n)]
        per_text = np.add.reduceat(np.append(n, 0), firsts) * (lengths > 0)
        if symbols.max() < len(self.v.ids_by_rank):
            return self.out.room[symbols], per_text
        # characters that are no pieces have several ids
        more = self.out_n.room[symbols]
        ends = np.append(0, np.cumsum(more))
        bounds = np.append(0, np.cumsum(per_text))
        return self.out.room[ranges(self.out_start.room[symbols], more)], np.diff(ends[bounds])

    def encode(self, text: str | None, doc_id: int | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "surrogatepass")
        return self.encode_texts([raw], np.array([doc_id or 0], np.int64))[0]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.v.raw.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "surrogatepass")


def _encoder(shared, s: Settings) -> Encoder:
    v = shared.value
    return kept_in_worker(("pieces", s, len(v.model), crc32(v.model), len(v.rank)), lambda: Encoder(v, s))


def _encoded(e: Encoder, docs: pa.Array, texts: pa.Array):
    """Of a batch: all ids, where each text's end, and whether they decode to the very text."""
    raw = texts.to_pylist()
    doc_ids = docs.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ids, n = e.encode_texts(raw, doc_ids)
    ends = np.append(0, np.cumsum(n))
    ok = [e.decode_bytes(ids[a:b]) == (t or b"") for a, b, t in zip(ends[:-1].tolist(), ends[1:].tolist(), raw, strict=True)]
    return ids, ends, n, ok


def encode(documents: DataFrame, s: Settings = Settings(), ids: str = "ids", vocabulary: Pieces | None = None) -> DataFrame:
    """documents and `ids` array<int>, `n_pieces` long, `lossless` boolean (whether the ids decode to the very text)."""
    spark = documents.sparkSession
    bounded_batches(spark, 8)
    shared = spark.sparkContext.broadcast(vocabulary or Pieces.load(s.model))
    n = len(documents.columns)
    sent = documents.select("*", F.col("text").cast("binary").alias(free_name(documents, "__text")), F.col("doc_id").cast("long").alias(free_name(documents, "__doc")))
    added = [T.StructField(free_name(documents, c), t) for c, t in ((ids, T.ArrayType(T.IntegerType())), ("n_pieces", T.LongType()), ("lossless", T.BooleanType()))]
    schema = T.StructType([*documents.schema.fields, *added])

    def run(batches):
        e = _encoder(shared, s)
        for b in batches:
            flat, ends, count, ok = _encoded(e, b.column(n + 1), b.column(n))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], lists, pa.array(count, pa.int64()), pa.array(ok, pa.bool_())], names=schema.names)

    return sent.mapInArrow(run, schema)


def pieces_query(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_pieces, lossless, ids_sha256 (of the ids as little-endian 32-bit numbers; computed beside the encoding)."""
    spark = documents.sparkSession
    bounded_batches(spark, 8)
    shared = spark.sparkContext.broadcast(Pieces.load(s.model))

    def run(batches):
        e = _encoder(shared, s)
        for b in batches:
            flat, ends, count, ok = _encoded(e, b.column(0), b.column(1))
            raw = memoryview(flat.astype("<i4").tobytes())
            sha = [sha256(raw[4 * a : 4 * z]).hexdigest() for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(ok, pa.bool_()), pa.array(sha, pa.string())], names=["doc_id", "n_pieces", "lossless", "ids_sha256"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_pieces long, lossless boolean, ids_sha256 string")

"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A text is cut into pre-tokens by the vocabulary's pattern; each is encoded on its own, so a text's count is a sum over its
pre-tokens. The leaves of a document's tree are blocks of pre-tokens; inner nodes hold the code points and tokens below
them. An edit replaces the code points [start, end) by others: the tree is descended to the block, cutting starts anew
`context` code points before the edit, and ends at the first cut behind it that is also an old one: from there on the
text is the old one, so its cuts and counts are. Only the pre-tokens between are encoded; the sums above the touched
blocks follow. Leaves can be kept as a table beside the texts: later edits start from them and encode nothing else.

Defined cases: null and empty texts have 0 tokens and can be edited; texts of any length are read whole; places beyond a
text's end are its end; repeated rows are counted row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_batches, kept_in_worker


@dataclass(frozen=True)
class Settings:
    ranks: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    # Fixed value: the public pattern of the vocabulary. Its cuts look at most two code points ahead.
    pattern: str = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    context: int = 2
    block: int = 128
    #: Pre-tokens kept in each of the two generations of a worker's cache.
    cache: int = 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Counter:
    """Tokens of a pre-token, with a cache of two generations."""

    def __init__(self, ranks: dict[bytes, int], s: Settings):
        import tiktoken

        self.s, self.cut = s, regex.compile(s.pattern).findall
        self.encode = tiktoken.Encoding("own", pat_str=s.pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def miss(self, piece: str) -> int:
        n = self.old.get(piece) or len(self.encode(piece.encode("utf-8", "surrogatepass")))
        if len(self.young) >= self.s.cache:
            self.old, self.young = self.young, {}
        self.young[piece] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        get, miss = self.young.get, self.miss
        return [get(p) or miss(p) for p in pieces]


class TokenTree:
    """A document: blocks of (pre-tokens, their counts) under a binary tree of sums."""

    def __init__(self, text: str | None, counter: Counter):
        self.c, self.encoded = counter, 0
        self._build(self._blocks(counter.cut(text or "")))

    def _blocks(self, pieces: list[str]) -> list:
        counts, n = self.c.counts(pieces), self.c.s.block
        self.encoded += len(pieces)
        return [(pieces[i : i + n], counts[i : i + n]) for i in range(0, len(pieces), n)]

    def _build(self, blocks: list) -> None:
        self.blocks = blocks or [([], [])]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (p, c) in enumerate(self.blocks):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(map(len, p)), sum(c)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def __len__(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join("".join(p) for p, _ in self.blocks)

    def find(self, place: int) -> tuple[int, int]:
        """The block that holds a code point, and the place where it starts; the last block for the end."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if place >= start + self.chars[i] and i + 1 - self.size < len(self.blocks) << (self.size.bit_length() - (i + 1).bit_length()) and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return min(i - self.size, len(self.blocks) - 1), start

    def edit(self, start: int, end: int, new: str) -> None:
        start, end = max(0, min(start, len(self))), max(0, min(end, len(self)))
        end = max(start, end)
        safe = max(0, start - self.c.s.context)
        first, at = self.find(safe)
        pieces, _ = self.blocks[first]
        # the last cut from which everything before the edit's surroundings is kept
        k = 0
        while k < len(pieces) and at + len(pieces[k]) <= safe:
            at += len(pieces[k])
            k += 1
        last, head = first, at - sum(map(len, pieces[:k]))
        # old cuts behind the edit, block after block, until the new cuts meet one
        old = pieces[k:]
        begin = at
        stop = head + self.chars[self.size + first]
        while True:
            body = "".join(old)
            fresh_text = body[: start - begin] + new + body[end - begin :]
            if stop >= end:
                fresh, shift = self.c.cut(fresh_text), len(new) - (end - start)
                whole = last + 1 >= len(self.blocks)
                cuts, x = {}, begin
                for i, p in enumerate(old):
                    if x >= end:
                        cuts[x + shift] = i
                    x += len(p)
                x, met = begin, None
                # the last cuts of a part of the text may be others in the whole: they are not trusted
                trust = len(fresh_text) + begin - self.c.s.context
                for i, p in enumerate(fresh):
                    if x in cuts and (x <= trust):
                        met = (i, cuts[x])
                        break
                    x += len(p)
                if met or whole:
                    i, j = met or (len(fresh), len(old))
                    break
            last += 1
            old = old + self.blocks[last][0]
            stop += self.chars[self.size + last]
        keep = self.blocks[first]
        tail_counts = [c for b in range(first, last + 1) for c in self.blocks[b][1]][k:]
        added = fresh[:i]
        self.encoded += len(added)
        merged = keep[0][:k] + added + old[j:]
        counts = keep[1][:k] + self.c.counts(added) + tail_counts[j:]
        n = self.c.s.block
        touched = last - first + 1
        if touched <= len(merged) <= 2 * n * touched:
            # as many blocks as before, filled evenly: only their sums and those above them change
            for i in range(touched):
                lo, hi = len(merged) * i // touched, len(merged) * (i + 1) // touched
                self.blocks[first + i] = (merged[lo:hi], counts[lo:hi])
                leaf = self.size + first + i
                self.chars[leaf], self.tokens[leaf] = sum(map(len, merged[lo:hi])), sum(counts[lo:hi])
            lo, hi = (self.size + first) // 2, (self.size + last) // 2
            while lo:
                for i in range(lo, hi + 1):
                    self._sum(i)
                lo, hi = lo // 2, hi // 2
        else:
            self._build(self.blocks[:first] + [(merged[i : i + n], counts[i : i + n]) for i in range(0, len(merged), n)] + self.blocks[last + 1 :])

    def leaves(self) -> tuple[list[int], list[int]]:
        """Code points and tokens of all pre-tokens: with the text, what a tree is made from again."""
        return [len(x) for p, _ in self.blocks for x in p], [c for _, cs in self.blocks for c in cs]

    @classmethod
    def restored(cls, text: str | None, chars: list[int], tokens: list[int], counter: Counter) -> TokenTree:
        """A tree from its text and leaves: nothing is cut or encoded."""
        tree, n, at, pieces = cls.__new__(cls), counter.s.block, 0, []
        for k in chars:
            pieces.append((text or "")[at : at + k])
            at += k
        tree.c, tree.encoded = counter, 0
        tree._build([(pieces[i : i + n], tokens[i : i + n]) for i in range(0, len(pieces), n)])
        return tree


def _counter(shared, s: Settings) -> Counter:
    return kept_in_worker(("counts", s, len(shared.value)), lambda: Counter(shared.value, s))


_TREES = "doc_id long, text string, piece_chars array<int>, piece_tokens array<int>, n_tokens long, n_encoded long"


def _tree_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64())
    names = [c.split()[0] for c in _TREES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def build_trees(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, text, piece_chars, piece_tokens, n_tokens, n_encoded for every row: the leaves of its tree, to be kept as a table
    that edit_trees() goes on from."""
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(load_ranks(s.ranks))

    def run(batches):
        counter = _counter(shared, s)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tree = TokenTree(text, counter)
                rows.append((doc, text or "", *tree.leaves(), tree.n_tokens, tree.encoded))
            yield _tree_batch(rows)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _TREES)


def edit_trees(trees: DataFrame, edits: str, s: Settings = Settings()) -> DataFrame:
    """The table of build_trees() after a column of edits (see count_edits()): the same columns, n_encoded counting the
    pre-tokens that the edits had encoded anew."""
    spark = trees.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(load_ranks(s.ranks))

    def run(batches):
        counter = _counter(shared, s)
        for b in batches:
            rows = []
            for doc, text, chars, tokens, todo in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tree = TokenTree.restored(text, chars, tokens, counter)
                for e in todo or []:
                    tree.edit(e["start"], e["end"], e["text"])
                rows.append((doc, tree.text(), *tree.leaves(), tree.n_tokens, tree.encoded))
            yield _tree_batch(rows)

    return trees.select("doc_id", "text", "piece_chars", "piece_tokens", F.col(edits)).mapInArrow(run, _TREES)


def count_edits(documents: DataFrame, edits: str, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, n_edited (tokens after the edits), n_reencoded (pre-tokens encoded for them).

    edits: a column array<struct<start: int, end: int, text: string>>, applied in order, each to the text that the ones
    before it left; null for none.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(load_ranks(s.ranks))

    def run(batches):
        counter = _counter(shared, s)
        for b in batches:
            out: list = [[], [], [], []]
            for text, todo in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                tree = TokenTree(text, counter)
                built, before = tree.encoded, tree.n_tokens
                for e in todo or []:
                    tree.edit(e["start"], e["end"], e["text"])
                for x, y in zip(out, (built, before, tree.n_tokens, tree.encoded - built), strict=True):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in out)], names=["doc_id", "n_pretokens", "n_tokens", "n_edited", "n_reencoded"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(edits)).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, n_edited long, n_reencoded long")


def counts_query(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Counts of every text, before and after three edits at places hashed from its id: 12 code points go, a phrase comes
    in, 6 code points are replaced."""
    n = F.length(F.coalesce("text", F.lit("")))
    at = lambda i: F.pmod(F.xxhash64(F.lit(i), "doc_id"), n + 1).cast("int")
    edit = lambda i, size, text: F.struct(at(i).alias("start"), (at(i) + size).alias("end"), F.lit(text).alias("text"))
    return count_edits(documents.select("doc_id", "text", F.array(edit(1, 12, ""), edit(2, 0, " an edited 2nd phrase"), edit(3, 6, "X-1 ")).alias("__edits")), "__edits", s)

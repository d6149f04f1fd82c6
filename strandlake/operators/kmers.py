"""K-mer operators: content and hasher specifications, spectra, hashes and their decoding, mismatch windows, edit balls."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequences as sq

# Alphabets in the order of their codes, and the words of specifications.
ALPHABETS = {"dna": "ACGT", "dna_cs": "ACGTacgt", "protein": "ACDEFGHIKLMNOPQRSTUVWY"}
STRANDS = {"ss": 1, "SS": 1, "single-stranded": 1, "ds": 2, "DS": 2, "double-stranded": 2}
CASES = {"ci": False, "case-insensitive": False, "cs": True, "case-sensitive": True}
ACTIONS = {"split": "split", "ignore": "ignore", "skip": "ignore", "error": "error", "abort": "error"}


@dataclass(frozen=True)
class Content:
    """What sequences are made of. kind: dna, protein or text (tokens from a dictionary file at `path`)."""

    kind: str
    strands: int = 1
    case_sensitive: bool = False
    unknown: str = "split"
    path: str = ""

    @classmethod
    def parse(cls, spec: str) -> Content:
        short = {"ss-DNA": 1, "SS-DNA": 1, "single-stranded-DNA": 1, "ds-DNA": 2, "DS-DNA": 2, "double-stranded-DNA": 2}
        try:
            if spec in short:
                return cls("dna", short[spec])
            if spec == "protein":
                return cls("protein")
            name, inner = re.fullmatch(r"(DNA|protein|text)\((.*)\)", spec, re.S).groups()
            if name == "DNA":
                strand, case, action = inner.split(",")
                return cls("dna", STRANDS[strand], CASES[case], ACTIONS[action])
            if name == "protein":
                return cls("protein", unknown=ACTIONS[inner])
            case, action, path = inner.split(",", 2)
            return cls("text", 1, CASES[case], ACTIONS[action], path)
        except (AttributeError, KeyError, ValueError):
            raise ValueError(f"unknown content {spec!r}") from None

    def __str__(self) -> str:
        case = "case-sensitive" if self.case_sensitive else "case-insensitive"
        if self.kind == "dna":
            return f"DNA({'double' if self.strands == 2 else 'single'}-stranded,{case},{self.unknown})"
        return f"protein({self.unknown})" if self.kind == "protein" else f"text({case},{self.unknown},{self.path})"

    @property
    def alphabet(self) -> str:
        return ALPHABETS["protein" if self.kind == "protein" else "dna_cs" if self.case_sensitive else "dna"]

    def lint(self, s: Column) -> Column:
        if self.kind == "dna":
            return sq.dnaize(s, keep_lowercase=self.case_sensitive)
        if self.kind == "protein":
            return sq.proteinize(s)
        return s if self.case_sensitive else F.lower(s)


@dataclass(frozen=True)
class Hasher:
    k: int
    gap: int | None = None

    @classmethod
    def parse(cls, spec: str) -> Hasher:
        if m := re.fullmatch(r"k-mers\((\d+)\)", spec):
            return cls(int(m[1]))
        if m := re.fullmatch(r"gapped\((\d+),(\d+)\)", spec):
            return cls(int(m[1]), int(m[2]))
        raise ValueError(f"unknown hasher {spec!r}")


def segments(s: Column, content: Content) -> Column:
    """The stretches of known letters in a linted sequence, by what is to be done about unknown ones."""
    unknown = f"[^{content.alphabet}]"
    if content.unknown == "ignore":
        return F.array(F.regexp_replace(s, unknown, ""))
    if content.unknown == "error":
        return F.array(F.when(s.rlike(unknown), F.raise_error(F.concat(F.lit("unknown character in "), s))).otherwise(s))
    return F.split(s, unknown + "+")


def canonical(kmer: Column) -> Column:
    """The smaller of a word and its reverse complement: byte order of A, C, G, T is code order."""
    return F.least(kmer, sq.rc(kmer))


def spectrum(df: DataFrame, content: Content, hasher: Hasher, seq: str = "seq", weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., kmer, weight): weights summed over (canonical, if double-stranded) k-mers, those above 0.

    Words are exploded and summed: the sums are partial before the one shuffle by word. Gapped words are left_right.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    parts = df.select(*by, F.explode(segments(content.lint(F.col(seq)), content)).alias("__s"), w.alias("__w"))
    k, gap = hasher.k, hasher.gap
    if gap is None:
        words = parts.select(*by, F.explode(sq.windows(F.col("__s"), k)).alias("kmer"), "__w")
        if content.strands == 2:
            words = words.withColumn("kmer", canonical(F.col("kmer")))
    else:
        words = parts.select(*by, F.explode(sq.windows(F.col("__s"), 2 * k + gap)).alias("__x"), "__w")
        left, right = F.substring("__x", 1, k), F.substring("__x", k + gap + 1, k)
        words = words.select(*by, left.alias("__a"), right.alias("__b"), "__w")
        pair = F.struct(F.col("__a").alias("a"), F.col("__b").alias("b"))
        if content.strands == 2:
            pair = F.least(pair, F.struct(sq.rc(F.col("__b")).alias("a"), sq.rc(F.col("__a")).alias("b")))
        words = words.select(*by, pair.alias("__p"), "__w").select(*by, F.concat_ws("_", "__p.a", "__p.b").alias("kmer"), "__w")
    return words.groupBy(*by, "kmer").agg(F.sum("__w").alias("weight")).where("weight > 0")


def bits_per_symbol(n: int) -> int:
    return max(1, (n - 1).bit_length())


def encode_hex(kmer: str, alphabet: str) -> str:
    bits = bits_per_symbol(len(alphabet))
    h = reduce(lambda a, c: (a << bits) | alphabet.index(c), kmer, 0)
    return f"{h:0{-(-bits * len(kmer) // 4)}x}"


def decode_hex(hash_: str, alphabet: str, k: int, gap: int | None = None, gap_char: str = "-") -> str:
    """The word of a hash; of a gapped one (left_right), with its gap shown."""
    bits, blocks = bits_per_symbol(len(alphabet)), hash_.split("_")
    if len(blocks) != (1 if gap is None else 2):
        raise ValueError(f"wrong number of blocks in {hash_!r}")
    words = []
    for b in blocks:
        if len(b) != -(-bits * k // 4):
            raise ValueError(f"wrong width of {b!r}")
        h = int(b, 16)
        if h >> (bits * k):
            raise ValueError(f"high bits set in {b!r}")
        codes = [(h >> (bits * i)) & ((1 << bits) - 1) for i in range(k - 1, -1, -1)]
        if max(codes) >= len(alphabet):
            raise ValueError(f"symbol out of range in {b!r}")
        words.append("".join(alphabet[c] for c in codes))
    return (gap_char * (gap or 0)).join(words)


def hex_column(kmer: Column, content: Content, k: int) -> Column:
    """Hash of words, of gapped ones part by part: in the plan while two bits a base fit a long, else by an Arrow function."""
    if content.alphabet == ALPHABETS["dna"] and k <= 31:
        return F.array_join(F.transform(F.split(kmer, "_"), lambda p: sq.hex_hash(p, k)), "_")
    alphabet = content.alphabet

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: "_".join(encode_hex(p, alphabet) for p in x.split("_")))

    return run(kmer)


def decode_column(hash_: Column, content: Content, hasher: Hasher) -> Column:
    alphabet, k, gap = content.alphabet, hasher.k, hasher.gap

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: decode_hex(x, alphabet, k, gap))

    return run(hash_)


def trie_pattern(tokens: list[str]) -> str:
    """A pattern for the longest of the tokens that stands at a place: alternatives share their beginnings as in a trie, so a
    place is tried letter by letter, whatever the size of the dictionary."""
    trie: dict = {}
    for t in tokens:
        node = trie
        for c in t:
            node = node.setdefault(c, {})
        node[""] = True

    def one(node: dict) -> str:
        further = [re.escape(c) + one(x) for c, x in sorted(node.items()) if c]
        return f"(?:{'|'.join(further)}){'?' if '' in node else ''}" if further else ""

    return one(trie)


def token_stretches(text: Column, tokens: list[str], unknown: str = "split") -> Column:
    """array<string>: the longest tokens, left to right; an empty string for each character at which none stands (none of them
    if unknown is "ignore"; an error if it is "error")."""
    tokens = [t for t in tokens if t]
    mark = next(chr(c) for c in range(1, 1 << 16) if not any(chr(c) in t for t in tokens))
    found = F.split(F.regexp_replace(text, f"({trie_pattern(tokens)})|[\\s\\S]" if tokens else "()[\\s\\S]", f"$1{mark}"), re.escape(mark), -1)
    found = F.slice(found, F.lit(1), F.size(found) - 1)  # a mark stands behind the last one, too
    if unknown == "ignore":
        return F.filter(found, lambda t: t != "")
    return F.when(F.array_contains(found, ""), F.raise_error(F.lit("an unknown character")).cast("array<string>")).otherwise(found) if unknown == "error" else found


def text_spectrum(df: DataFrame, tokens: list[str], k: int, column: str = "text", unknown: str = "split", case_sensitive: bool = False) -> DataFrame:
    """k-mers of dictionary tokens: (kmer, weight), a kmer being its tokens' ids, dash-joined. The dictionary is the caller's; of a
    token that it has twice the last id counts.

    Texts are cut to tokens by one pattern, in the plan; ids are joined to the k-mers when they are counted. Where unknown
    characters split, texts are cut to runs of tokens, equal runs are counted, and only one of each is cut to its tokens."""
    text = F.coalesce(F.col(column), F.lit(""))
    x = df.select((text if case_sensitive else F.lower(text)).alias("run"), F.lit(1).cast("long").alias("n"))
    known = [t for t in tokens if t]
    if unknown == "split":
        runs = F.regexp_extract_all("run", F.lit(f"(?:{trie_pattern(known)})++" if known else "(?!)"), F.lit(0))
        x = x.select(F.explode(runs).alias("run")).where(F.length("run") >= k * min(map(len, known), default=1)).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    found = x.select(token_stretches(F.col("run"), tokens, unknown).alias("ts"), "n").where(F.size("ts") >= k)
    every = F.transform(F.sequence(F.lit(1), F.size("ts") - k + 1), lambda i: F.slice("ts", i, k))
    words = found.select(F.explode(F.filter(every, lambda w: ~F.array_contains(w, ""))).alias("w"), "n").groupBy("w").agg(F.sum("n").cast("double").alias("weight"))
    ids = df.sparkSession.createDataFrame(list({t: i for i, t in enumerate(tokens)}.items()), "token string, id int")
    each = words.select("w", "weight", F.posexplode("w").alias("place", "token")).join(ids, "token")
    in_order = F.array_sort(F.collect_list(F.struct("place", "id")))
    return each.groupBy("w", "weight").agg(F.array_join(F.transform(in_order, lambda x: x["id"].cast("string")), "-").alias("kmer")).select("kmer", "weight")


def mismatch_windows(a: Column, b: Column, k: int) -> Column:
    """array<int>: for each place, how many of the last k aligned characters (fewer at the start) differ."""
    n = F.least(F.length(a), F.length(b))
    differ = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))).cast("int"))
    total = lambda i: F.aggregate(F.slice(differ, F.greatest(i - k + 1, F.lit(1)), F.least(i, F.lit(k))), F.lit(0), lambda s, x: s + x)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), total)).otherwise(F.array().cast("array<int>"))


def ball(word: str, radius: int = 1, left: str = "", right: str = "", alphabet: str = "ACGT") -> set[str]:
    """Words of the same length within `radius` edits; where letters go, those of the surroundings move in."""
    k = len(word)
    found, edge = {(left, word, right)}, {(left, word, right)}
    for _ in range(radius):
        fresh = set()
        for a, w, b in edge:
            for i in range(k):
                fresh |= {(a, w[:i] + c + w[i + 1 :], b) for c in alphabet if c != w[i]}
                if b:
                    fresh.add((a, w[:i] + w[i + 1 :] + b[0], b[1:]))
                if a:
                    fresh.add((a[:-1], a[-1] + w[:i] + w[i + 1 :], b))
                for c in alphabet:
                    fresh.add((a, w[:i] + c + w[i:-1], w[-1] + b))
                    fresh.add((a + w[0], w[1 : i + 1] + c + w[i + 1 :], b))
        edge = fresh - found
        found |= fresh
    return {w for _, w, _ in found}


def ball_column(word: Column, radius: int = 1) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: sorted(ball(x, radius)))

    return run(word)


# ---- dictionaries ---------------------------------------------------------------------------------------------------


def prefix_lookup(words: DataFrame, queries: DataFrame) -> DataFrame:
    """query, presence, exact, completions for words (id, word) and queries (query).

    presence: contained (a word, and others start with it), unique (a word, none does; or no word, one starts with it),
    ambiguous (several words start with it), not_found. A range of the sorted words holds a query's completions, so words
    are looked up by all their prefixes: an equi-join, not a scan.
    """
    p = words.select("id", "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("n")).select("id", "word", F.substr("word", F.lit(1), F.col("n")).alias("query"))
    hits = queries.select("query").distinct().join(p, "query", "left")
    out = hits.groupBy("query").agg(F.count("word").alias("n"), F.max(F.when(F.col("word") == F.col("query"), F.col("id"))).alias("exact"), F.array_sort(F.collect_set("id")).alias("completions"))
    presence = (
        F.when(F.col("n") == 0, "not_found").when(F.col("exact").isNotNull() & (F.col("n") > 1), "contained").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    )
    return out.select("query", presence.alias("presence"), "exact", "completions")


def longest_prefix(words: DataFrame, queries: DataFrame) -> DataFrame:
    """query, length: of the longest beginning of each query that a word begins with."""
    heads = words.where("word <> ''").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.substr("word", F.lit(1), n))).alias("head")).distinct()
    own = queries.select("query").distinct()
    parts = own.where("query <> ''").select("query", F.explode(F.sequence(F.lit(1), F.length("query"))).alias("n"))
    hits = parts.select("query", "n", F.substr("query", F.lit(1), F.col("n")).alias("head")).join(heads, "head").groupBy("query").agg(F.max("n").alias("length"))
    return own.join(hits, "query", "left").select("query", F.coalesce("length", F.lit(0)).cast("int").alias("length"))


def find_present(words: DataFrame, queries: DataFrame) -> DataFrame:
    """query, id: the word that a query is; null if it is none."""
    return queries.select("query").distinct().join(words.select(F.col("word").alias("query"), "id"), "query", "left")


def find_unambiguous(words: DataFrame, queries: DataFrame) -> DataFrame:
    """query, id: the word that a query is, or else the only one that it begins."""
    p = prefix_lookup(words, queries)
    return p.select("query", F.coalesce("exact", F.when(F.size("completions") == 1, F.try_element_at("completions", F.lit(1)))).alias("id"))


def nth_word(words: DataFrame, ids: DataFrame) -> DataFrame:
    """id, word; an id that is not there is an error."""
    out = ids.select("id").join(words.select("id", "word"), "id", "left")
    return out.withColumn("word", F.coalesce("word", F.raise_error(F.concat(F.lit("no word "), F.col("id").cast("string"))).cast("string")))

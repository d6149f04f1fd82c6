"""Scalar functions on sequences, as Column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions import genetic_code as code

# The letters that linters keep.
DNA, PROTEIN = "ACGT", "ACDEFGHIKLMNOPQRSTUVWY*"


def _lint(s: Column, letters: str, unknown: str, keep_lowercase: bool, keep_dashes: bool) -> Column:
    kept = letters + (letters.lower() if keep_lowercase else "") + ("-" if keep_dashes else "")
    kept = kept.replace("*", "\\*").replace("-", "\\-")
    # an ASCII upper-casing: other letters are unknown either way
    s = s if keep_lowercase else F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.regexp_replace(s, f"[^{kept}]", unknown)


def dnaize(s: Column, keep_lowercase: bool = False, keep_dashes: bool = False) -> Column:
    """Everything but A, C, G, T (either case if kept) becomes N."""
    return _lint(s, DNA, "N", keep_lowercase, keep_dashes)


def proteinize(s: Column, keep_lowercase: bool = False, keep_dashes: bool = False) -> Column:
    """Everything but amino-acid letters and the stop becomes X."""
    return _lint(s, PROTEIN, "X", keep_lowercase, keep_dashes)


def linter(kind: str):
    found = {"none": lambda s, **_: s, "dna": dnaize, "DNA": dnaize, "protein": proteinize}.get(kind)
    if found is None:
        raise ValueError(f"unknown linter {kind!r}")
    return found


def rc(s: Column) -> Column:
    """Reverse complement; letters other than ACGTacgt stay as they are."""
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def windows(s: Column, k: int) -> Column:
    """All substrings of length k, in order; none if s is shorter. In one pass: a substring by its place is counted from the start
    of s, which takes the square of the length of a whole text."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))


def codes_2bit(s: Column) -> Column:
    """A DNA word of at most 31 bases as a long, two bits a base."""
    return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a * 4 + F.position(c, F.lit("ACGT")) - 1))


def hex_hash(s: Column, k: int) -> Column:
    """A DNA word as zero-padded lower-case hexadecimal digits, two bits a base."""
    return F.lpad(F.lower(F.hex(codes_2bit(s))), -(-2 * k // 4), "0")


# ---- places ---------------------------------------------------------------------------------------------------------


def strand(s: Column) -> Column:
    return (
        F.when(s.isin("F", "f", "+", "forward"), "+").when(s.isin("R", "r", "-", "reverse"), "-")
        .otherwise(F.raise_error(F.concat(F.lit("unknown strand: "), s)))
    )


def pointer(s: Column) -> Column:
    """`name:strand:position[:length]`, 1-based, as a struct (name, strand, low, length), 0-based."""
    p = F.split(s, ":")
    n = F.size(p)
    return F.when((n < 3) | (n > 4), F.raise_error(F.concat(F.lit("not a pointer: "), s))).otherwise(
        F.struct(p[0].alias("name"), strand(p[1]).alias("strand"), (p[2].cast("long") - 1).alias("low"), F.when(n == 4, F.get(p, 3).cast("long")).alias("length")))


def format_interval(name: Column, strand_: Column, low: Column, length: Column | None = None) -> Column:
    parts = [name, strand_, (low + 1).cast("string")] + ([length.cast("string")] if length is not None else [])
    return F.concat_ws(":", *parts)


def slice_sequence(seq: Column, low: Column, length: Column, strand_: Column | None = None) -> Column:
    """The interval of a sequence, from the reverse complement where the strand is '-'; an error out of bounds."""
    bad = (low < 0) | (length < 0) | (low + length > F.length(seq))
    s = seq if strand_ is None else F.when(strand_ == "-", rc(seq)).otherwise(seq)
    return F.when(bad, F.raise_error(F.lit("interval out of bounds"))).otherwise(F.substr(s, (low + 1).cast("int"), length.cast("int")))


# ---- codons ---------------------------------------------------------------------------------------------------------


def residue(codon: Column, table: int = 1) -> Column:
    items = [F.lit(x) for kv in sorted(code.residues(table).items()) for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*items), codon), F.lit("X"))


def codon_places(s: Column, codons: list[str], frames=(0, 1, 2)) -> Column:
    """0-based places of these codons whose place is in one of the frames, ascending."""
    n = F.length(s)
    every = F.when(n >= 3, F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: (i % 3).isin(*frames) & F.substr(s, i + 1, F.lit(3)).isin(*codons))


def start_places(s: Column, table: int = 1, frames=(0, 1, 2), alternative: bool = False) -> Column:
    return codon_places(s, code.starts(table, alternative), frames)


def stop_places(s: Column, table: int = 1, frames=(0, 1, 2)) -> Column:
    return codon_places(s, code.stops(table), frames)


def translate(s: Column, table: int = 1, phase: int = 0, replace_alternative: bool = False, stop_on_first: bool = True) -> Column:
    """Residues of the codons from `phase` on; up to, without, the first stop if asked. A phase beyond the end gives ''."""
    n = F.length(s) - phase
    first = F.sequence(F.lit(phase), F.greatest(F.length(s) - 3, F.lit(phase)), F.lit(3))

    def one(i: Column) -> Column:
        codon = F.substr(s, i + 1, F.lit(3))
        if replace_alternative:
            return F.when((i == phase) & codon.isin(*code.starts(table, True)), "M").otherwise(residue(codon, table))
        return residue(codon, table)

    out = F.when(n >= 3, F.array_join(F.transform(first, one), "")).otherwise("")
    return F.substring_index(out, "*", 1) if stop_on_first else out


def translate_by(s: Column, table: Column, replace_alternative: bool = False, stop_on_first: bool = True) -> Column:
    """translate() from the first letter on, by the table that a column names; null for a table that there is not."""
    codes = F.from_json(F.lit(json.dumps({t: code.residues(t) for t in code.TABLES})), "map<string,map<string,string>>")
    begins = F.from_json(F.lit(json.dumps({t: code.starts(t, True) for t in code.TABLES})), "map<string,array<string>>")
    key = table.cast("string")
    own, starts = F.try_element_at(codes, key), F.try_element_at(begins, key)
    first = F.sequence(F.lit(0), F.greatest(F.length(s) - 3, F.lit(0)), F.lit(3))

    def one(i: Column) -> Column:
        codon = F.substr(s, i + 1, F.lit(3))
        made = F.coalesce(F.try_element_at(own, codon), F.lit("X"))
        return F.when((i == 0) & F.array_contains(starts, codon), "M").otherwise(made) if replace_alternative else made

    out = F.when(F.length(s) >= 3, F.array_join(F.transform(first, one), "")).otherwise("")
    return F.when(own.isNotNull(), F.substring_index(out, "*", 1) if stop_on_first else out)


def open_frames(s: Column, table: int = 1, alternative: bool = False, replace: bool = False, minimum: int = 0) -> Column:
    """array<struct<start: int, product: string>> in frame 0: for each start that is the first after a stop, the residues up
    to and with the next stop's symbol. Frames without a stop before the end are not reported."""
    begin, end = start_places(s, table, (0,), alternative), stop_places(s, table, (0,))
    no_stop = 1 << 30
    next_stop = lambda i: F.coalesce(F.array_min(F.filter(end, lambda e: e >= i)), F.lit(no_stop))
    pairs = F.transform(begin, lambda i: F.struct(i.alias("start"), next_stop(i).alias("stop")))
    # one stop ends one frame: the smallest start that reaches it stays
    firsts = F.filter(pairs, lambda p: (p["stop"] < no_stop) & (p["start"] == F.array_min(F.filter(F.transform(pairs, lambda q: F.when(q["stop"] == p["stop"], q["start"])), lambda x: x.isNotNull()))))

    def product(p: Column) -> Column:
        r = F.array_join(F.transform(F.sequence(p["start"], p["stop"], F.lit(3)), lambda i: residue(F.substr(s, i + 1, F.lit(3)), table)), "")
        return F.concat(F.lit("M"), F.substring(r, 2, 1 << 30)) if replace else r

    made = F.transform(firsts, lambda p: F.struct(p["start"].alias("start"), product(p).alias("product")))
    return F.filter(made, lambda p: F.length(p["product"]) >= minimum)


def decode_percent(s: Column) -> Column:
    """%HH escapes decoded as bytes, so escapes of several bytes make one character; what is not an escape stays."""
    parts = F.split(s, "%")
    raw = lambda c: F.hex(c.cast("binary"))

    def one(p: Column, i: Column) -> Column:
        escape = p.rlike("^[0-9A-Fa-f]{2}")
        return F.when(i == 0, raw(p)).when(escape, F.concat(F.substring(p, 1, 2), raw(F.substring(p, 3, 1 << 30)))).otherwise(F.concat(F.lit("25"), raw(p)))

    return F.unhex(F.array_join(F.transform(parts, one), "")).cast("string")


def encode_percent(s: Column) -> Column:
    for c, e in (("%", "%25"), (";", "%3B"), ("=", "%3D"), ("&", "%26"), (",", "%2C"), ("\t", "%09"), ("\n", "%0A")):
        s = F.replace(s, F.lit(c), F.lit(e))
    return s


def strip_quotes(s: Column) -> Column:
    return F.regexp_replace(s, '^"(.*)"$', "$1")

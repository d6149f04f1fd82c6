"""Readers and writers of GFF3, GTF and GenBank."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import sequences as sq
from strandlake.operators import annotation as an
from strandlake.plans.tables import remove, written
from strandlake.sources.formats import lines, text_rows


def _fields(x: DataFrame) -> DataFrame:
    p = F.split("value", "\t", -1)
    fail = F.raise_error(F.concat(F.lit("not nine columns: "), F.col("value"))).cast("array<string>")
    x = x.select("ordinal", F.when(F.size(p) == 9, p).otherwise(fail).alias("p"))
    f = lambda i: F.col("p")[i]
    none = lambda c: F.when(~c.isin(".", ""), c)
    lo, hi = f(3).cast("long"), f(4).cast("long")
    strand = F.when(f(6).isin("+", "-"), f(6)).when(~f(6).isin(".", "?"), F.raise_error(F.concat(F.lit("bad strand "), f(6))).cast("string"))
    phase = F.when(f(7).isin("0", "1", "2"), f(7).cast("int")).when(f(7) != ".", F.raise_error(F.concat(F.lit("bad phase "), f(7))).cast("int"))
    length = F.when(hi < lo, F.raise_error(F.lit("an end before its start")).cast("long")).otherwise(hi - lo + 1)
    return x.select(F.col("ordinal").alias("n"), f(0).alias("seq"), none(f(1)).alias("source"), f(2).alias("type"), (lo - 1).alias("low"), length.alias("length"), none(f(5)).alias("score"), strand.alias("strand"), phase.alias("phase"), f(8).alias("attrs"))


def _framed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    x = lines(spark, path)
    pragmas = x.where("startswith(value, '##') and value <> '###'").select("ordinal", F.substring("value", 3, 1 << 30).alias("v"))
    meta = pragmas.select(F.col("ordinal").alias("pos"), F.substring_index("v", " ", 1).alias("key"), F.when(F.instr("v", " ") > 0, F.substr("v", F.instr(F.col("v"), " ") + 1)).otherwise("").alias("value"))
    return x.where("trim(value) <> '' and not startswith(value, '#')"), meta


def read_gff3(spark: SparkSession, path: str, dialect: str = "standard", hierarchy: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, metadata). The first parent counts; a path outside the hierarchy is an error."""
    rows, meta = _framed(spark, path)
    x = _fields(rows)
    pair = F.transform(F.filter(F.split("attrs", ";"), lambda a: F.trim(a) != ""), lambda a: F.struct(F.trim(F.substring_index(a, "=", 1)).alias("k"), F.transform(F.split(F.substring_index(F.concat(F.lit("="), a), "=", -1), ","), sq.decode_percent).alias("v")))
    # of repeated keys the last counts
    last = F.filter(F.transform("__kv", lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), (F.size(F.filter(F.slice("__kv", i + 2, F.size("__kv")), lambda o: o["k"] == e["k"])) == 0).alias("l"))), lambda e: e["l"])
    x = x.withColumn("__kv", pair).withColumn("attributes", F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))).drop("__kv", "attrs")
    x = x.withColumns({"id": F.try_element_at(F.try_element_at("attributes", F.lit("ID")), F.lit(1)), "parent": F.try_element_at(F.try_element_at("attributes", F.lit("Parent")), F.lit(1))})
    placed = an.place(x)
    bad = an.check_paths(placed, an.hierarchy(spark, hierarchy or an.HIERARCHIES["gff3", dialect])).first()
    if bad:
        raise ValueError(f"not in the hierarchy: {'->'.join(bad.path)}")
    return placed.orderBy("ord"), meta


_GTF_PAIR = re.compile(r'\s*([^\s;"]+)\s+(?:"((?:[^"\\]|\\.)*)"|([^\s;"]+))\s*(?:;|\Z)')


def gtf_attributes(text: str) -> dict[str, list[str]]:
    """The keys of `key "value"; ...`, each with its values in order; bare values are taken too. Anything else is an error."""
    out: dict = {}
    at, text = 0, text.strip()
    while at < len(text) and text != ".":
        m = _GTF_PAIR.match(text, at)
        if not m:
            raise ValueError(f"unreadable attributes: {text[at : at + 40]!r}")
        key, quoted, bare = m.groups()
        if quoted is not None and "\\" in quoted:
            quoted = re.sub(r"\\(.)", r"\1", quoted)
        out.setdefault(key, []).append(bare if quoted is None else quoted)
        at = m.end()
    return out


def read_gtf(spark: SparkSession, path: str, hierarchy: str | None = None, ordered: bool = True) -> DataFrame:
    """n, seq, type, low, length, strand, gene_id, transcript_id, source, score, phase, attributes, synthesized, path, id, ord,
    with missing parents made up, in the order of ord. A path outside the hierarchy is an error.

    Not ordered, rows come in any order and without ord; then rows of the file are never shuffled."""
    rows, _ = _framed(spark, path)

    # as Arrow arrays: maps in pandas are turned row by row and value by value
    @F.arrow_udf("map<string,array<string>>")
    def attributes(s: pa.Array) -> pa.Array:
        keys, values, key_ends, value_ends = [], [], [0], [0]
        for text in s.to_pylist():
            for k, vs in gtf_attributes(text).items():
                keys.append(k)
                values += vs
                value_ends.append(len(values))
            key_ends.append(len(keys))
        lists = pa.ListArray.from_arrays(pa.array(value_ends, pa.int32()), pa.array(values, pa.string()))
        return pa.MapArray.from_arrays(pa.array(key_ends, pa.int32()), pa.array(keys, pa.string()), lists)

    # parsed once, though parents are made up from several sides of it
    x = written(_fields(rows).withColumn("attributes", attributes("attrs")).drop("attrs"), "gtf-rows")
    first = lambda k: F.try_element_at(F.try_element_at("attributes", F.lit(k)), F.lit(1))
    rows = an.synthesize_parents(x.withColumns({"gene_id": first("gene_id"), "transcript_id": first("transcript_id")}), keep=True)
    bad = an.check_paths(an.gtf_paths(rows, ordered=False), an.hierarchy(spark, hierarchy or an.HIERARCHIES["gtf", "standard"])).first()
    if bad:
        raise ValueError(f"not in the hierarchy: {'->'.join(bad.path)}")
    placed = an.gtf_paths(rows, ordered)
    return placed.orderBy("ord") if ordered else placed


# ---- GenBank --------------------------------------------------------------------------------------------------------

_LOCATION = re.compile(r"\s*(complement|join|order|\(|\)|,|\.\.|\^|[<>]?\d+|[A-Za-z_][\w.]*:)")


def parse_location(text: str) -> tuple[list[tuple[int, int]], str | None]:
    """([(low, length)], strand): flattened; a place between bases has length 0; the strand is that of the last part: none
    without a complement, and turned by each one."""
    toks = _LOCATION.findall(text)
    if "".join(toks) != re.sub(r"\s", "", text):
        raise ValueError(f"not a location: {text!r}")
    at = 0

    def one(strand: str | None) -> list[tuple[int, int, str | None]]:
        nonlocal at
        t = toks[at]
        at += 1
        if t in ("complement", "join", "order"):
            at += 1
            if t == "complement":
                strand = "+" if strand == "-" else "-"
            out = one(strand)
            while toks[at] == ",":
                at += 1
                out += one(strand)
            at += 1
            return out
        if t.endswith(":"):
            return one(strand)
        a = int(t.lstrip("<>"))
        if at < len(toks) and toks[at] in ("..", "^"):
            sep, b = toks[at], int(toks[at + 1].lstrip("<>"))
            at += 2
            return [(a, 0, strand)] if sep == "^" else [(a - 1, b - a + 1, strand)]
        return [(a - 1, 1, strand)]

    parts = one(None)
    return [(a, b) for a, b, _ in parts], parts[-1][2]


def parse_genbank(text: str) -> dict:
    """headers, features (type, location, qualifiers) and origin of one record."""
    headers: list = []
    feats: list = []
    origin, mode = [], "headers"
    for line in text.split("\n"):
        if not line.strip():
            continue
        if line.startswith("FEATURES"):
            mode = "features"
        elif line.startswith("ORIGIN"):
            mode = "origin"
        elif mode == "headers":
            if line[0] != " ":
                key, _, v = line.partition(" ")
                headers.append([key, v.strip()])
            elif headers:
                headers[-1][1] += " " + line.strip()
        elif mode == "features":
            body = line.strip()
            if len(line) - len(line.lstrip()) <= 5:
                name, _, loc = body.partition(" ")
                feats.append((name, [loc.strip()], []))
            elif body.startswith("/"):
                k, _, v = body[1:].partition("=")
                feats[-1][2].append([k, v])
            elif feats[-1][2]:
                feats[-1][2][-1][1] += body
            else:
                feats[-1][1].append(body)
        else:
            origin.append(re.sub(r"[\d\s]", "", line))
    unquote = lambda v: v[1:-1].replace('""', '"') if len(v) > 1 and v[0] == v[-1] == '"' else v
    return {"headers": headers, "features": [(n, "".join(loc), [(k, unquote(v)) for k, v in q]) for n, loc, q in feats], "origin": "".join(origin)}


def locus_and_length(headers) -> tuple[str, int]:
    """The LOCUS line's name, and the number before its `bp`."""
    words = next((v.split() for k, v in headers if k == "LOCUS"), [])
    size = next((a for a, b in zip(words[1:], words[2:]) if b == "bp"), "0")
    return words[0] if words else "", int(size) if size.isdigit() else 0


def _records(spark: SparkSession, path: str) -> DataFrame:
    return text_rows(spark, path, "record", "\n//").select("record", F.regexp_replace("value", "\r", "").alias("value")).where("trim(replace(value, '\\n', '')) <> ''")


def read_genbank(spark: SparkSession, path: str, hierarchy: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, reference): one row an interval, under the record's source; a type that the hierarchy lacks is an error."""
    raw, allowed = _records(spark, path), set(an.parse_hierarchy(hierarchy or an.HIERARCHIES["genbank", "standard"]))

    def run(batches):
        for pdf in batches:
            rows = []
            for n, text in zip(pdf["record"], pdf["value"], strict=True):
                r = parse_genbank(text)
                locus, size = locus_and_length(r["headers"])
                feats = list(r["features"])
                if not any(f[0] == "source" for f in feats):
                    feats.insert(0, ("source", f"1..{size}", []))
                # a record's source comes first, and only once
                feats.sort(key=lambda f: f[0] != "source")
                feats = [f for i, f in enumerate(feats) if f[0] != "source" or not i]
                for i, (kind, loc, quals) in enumerate(feats):
                    q = dict(reversed(quals))
                    parts, strand = parse_location(loc)
                    path_ = ["source"] if kind == "source" else ["source", kind]
                    if tuple(path_) not in allowed and kind != "source":
                        raise ValueError(f"not in the hierarchy: {kind}")
                    id_ = locus if kind == "source" else q.get("locus_tag") or q.get("gene")
                    attrs: dict = {}
                    for k, v in quals:
                        attrs.setdefault(k, []).append(v)
                    rows += [(n, i, path_, id_, locus, a, b, None if kind == "source" else strand, part, attrs) for part, (a, b) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["record", "n", "path", "id", "seq", "low", "length", "strand", "part", "attributes"])

    schema = "record long, n int, path array<string>, id string, seq string, low long, length long, strand string, part int, attributes map<string,array<string>>"
    features = raw.mapInPandas(run, schema).withColumn("ord", F.array(F.col("record"), F.col("n").cast("long")))

    def origins(batches):
        for pdf in batches:
            rs = [parse_genbank(t) for t in pdf["value"]]
            yield pd.DataFrame({"name": [next((v.split()[0] for k, v in r["headers"] if k == "LOCUS"), "") for r in rs], "seq": [r["origin"] for r in rs]})

    reference = raw.mapInPandas(origins, "name string, seq string").where("seq <> ''").select("name", sq.dnaize(F.col("seq")).alias("seq"))
    return features, reference


def read_genbank_metadata(spark: SparkSession, path: str) -> DataFrame:
    """record, pos, key, value of the records' headers but LOCUS, which the writer makes anew."""

    def run(batches):
        for pdf in batches:
            rows = [(n, i, k, v) for n, text in zip(pdf["record"], pdf["value"], strict=True) for i, (k, v) in enumerate(parse_genbank(text)["headers"]) if k != "LOCUS"]
            yield pd.DataFrame(rows, columns=["record", "pos", "key", "value"])

    return _records(spark, path).mapInPandas(run, "record long, pos long, key string, value string")


READERS = {"gff3": read_gff3, "gtf": read_gtf, "genbank": read_genbank}


def read_annotation(spark: SparkSession, kind: str, path: str, **options):
    name = an.FORMATS.get(kind.lower())
    if not name:
        raise ValueError(f"unknown annotation format {kind!r}")
    return READERS[name](spark, path, **options)


# ---- writers --------------------------------------------------------------------------------------------------------

_DOT = lambda c: F.coalesce(c.cast("string"), F.lit("."))


def gff3_lines(features: DataFrame, encode: bool = True) -> DataFrame:
    """line, in the features' order; values percent-encoded unless told not to."""
    enc = sq.encode_percent if encode else lambda v: v
    attrs = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], enc), ","))), ";")
    attrs = F.when(F.size("attributes") > 0, attrs).otherwise(".")
    row = F.concat_ws("\t", "seq", _DOT(F.col("source")), F.element_at("path", -1), (F.col("low") + 1).cast("string"), (F.col("low") + F.col("length")).cast("string"), F.lit("."), _DOT(F.col("strand")), _DOT(F.col("phase")), attrs)
    return features.orderBy("ord").select(row.alias("line"))


def gff3_header(meta: DataFrame) -> DataFrame:
    """line: the metadata as pragmas, by key and place, after the version's line unless the metadata has one."""
    own = meta.select(F.lit(1).alias("k"), "key", "pos", F.concat(F.lit("##"), F.col("key"), F.lit(" "), F.col("value")).alias("line"))
    lacks = meta.where("key = 'gff-version'").agg((F.count(F.lit(1)) == 0).alias("lacks")).where("lacks")
    first = lacks.select(F.lit(0).alias("k"), F.lit("").alias("key"), F.lit(0).cast("long").alias("pos"), F.lit("##gff-version 3").alias("line"))
    return first.union(own.select("k", "key", F.col("pos").cast("long"), "line")).orderBy("k", "key", "pos").select("line")


def gtf_lines(features: DataFrame, source: str = "strandlake") -> DataFrame:
    """line, in the order of ord, else of n with parents first; all attributes, the ids first where they are columns only."""
    q = lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    pair = lambda k, v: F.concat(k, F.lit(' "'), q(v), F.lit('";'))
    if "attributes" in features.columns:
        each = F.flatten(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.transform(e["value"], lambda v: pair(e["key"], v))))
        text = F.array_join(each, " ")
    else:
        text = F.concat_ws(" ", *(F.when(F.col(k).isNotNull(), pair(F.lit(k), F.col(k))) for k in ("gene_id", "transcript_id")))
    src = F.coalesce("source", F.lit(source)) if "source" in features.columns else F.lit(source)
    phase = _DOT(F.col("phase")) if "phase" in features.columns else F.lit(".")
    row = F.concat_ws("\t", "seq", src, "type", (F.col("low") + 1).cast("string"), (F.col("low") + F.col("length")).cast("string"), F.lit("."), _DOT(F.col("strand")), phase, text)
    order = F.col("ord") if "ord" in features.columns else F.struct("n", F.when(F.col("type") == "gene", 0).when(F.col("type") == "transcript", 1).otherwise(2))
    # lines are sorted, not features: they are less
    return features.select(row.alias("line"), order.alias("__order")).orderBy("__order").select("line")


# ---- saved annotations ----------------------------------------------------------------------------------------------


def save_annotation(path: str, features: DataFrame, meta: DataFrame | None = None, reference: DataFrame | None = None) -> None:
    """Tables of an annotation in one folder, read back without parsing."""
    features.write.parquet(f"{path}/features")
    for name, df in (("metadata", meta), ("reference", reference)):
        if df is not None:
            df.write.parquet(f"{path}/{name}")


def load_annotation(spark: SparkSession, path: str, *parts: str) -> tuple[DataFrame, ...]:
    """The features, and the other parts asked for ("metadata", "reference")."""
    return tuple(spark.read.parquet(f"{path}/{p}") for p in ("features", *parts))


def genbank_text(features: DataFrame, reference: DataFrame, headers: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """seq, record: a GenBank record for each sequence, with the headers given; a sequence's features are one task's."""

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"seq": [], "record": []})
        name, end = left["seq"].iloc[0], int((left["low"] + left["length"]).max())
        out = [f"LOCUS       {name:<16}{end} bp    DNA", *(f"{k:<12}{v}" for k, v in headers), "FEATURES             Location/Qualifiers"]
        for _, f in left.groupby("n", sort=True):
            spans = [f"{a + 1}..{a + b}" for a, b in zip(f["low"], f["length"], strict=True)]
            loc = spans[0] if len(spans) == 1 else f"join({','.join(spans)})"
            out.append(f"     {f['path'].iloc[0][-1]:<16}{'complement(' + loc + ')' if f['strand'].iloc[0] == '-' else loc}")
            for k, vs in dict(f["attributes"].iloc[0]).items():
                out += [" " * 21 + f'/{k}="' + v.replace('"', '""') + '"' for v in vs]
        if len(right):
            s = right["sequence"].iloc[0].lower()
            out.append("ORIGIN")
            out += [f"{i + 1:>9} " + " ".join(s[i + j : i + j + 10] for j in range(0, min(60, len(s) - i), 10)) for i in range(0, len(s), 60)]
        return pd.DataFrame({"seq": [name], "record": ["\n".join([*out, "//"])]})

    return features.groupBy("seq").cogroup(reference.withColumnsRenamed({"seq": "sequence", "name": "seq"}).groupBy("seq")).applyInPandas(one, "seq string, record string")

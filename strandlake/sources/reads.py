"""Readers and writers of sequence records: read_id, segment, tag, seq, qua."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import sequences as sq
from strandlake.sources.formats import lines, numbered, text_rows

_FAIL = "string"


def fasta(spark: SparkSession, path: str, linter: str = "dna", allow_empty: bool = True, **lint) -> DataFrame:
    """The tag is the whole header; sequence lines are joined and linted. Files are split at headers, so they are read in
    parallel. Text before the first header of a file, and an empty sequence unless allowed, are errors."""
    raw = text_rows(spark, path, "n", "\n>", "first")
    v = F.regexp_replace("value", "\r", "")
    lead = F.when(F.col("first"), F.regexp_replace(v, "^\\s+", "")).otherwise(F.concat(F.lit(">"), v))
    rows = raw.select("n", lead.alias("v")).where("v <> ''")
    rows = rows.select("n", F.when(~F.col("v").startswith(">"), F.raise_error(F.lit("no header before the first sequence")).cast(_FAIL)).otherwise(F.substring("v", 2, 1 << 30)).alias("v"))
    tag = F.substring_index("v", "\n", 1)
    body = F.when(F.instr("v", "\n") > 0, F.regexp_replace(F.substr("v", F.instr(F.col("v"), "\n") + 1), "\n", "")).otherwise("")
    seq = sq.linter(linter)(body, **lint)
    if not allow_empty:
        seq = F.when(seq == "", F.raise_error(F.concat(F.lit("empty sequence: "), tag)).cast(_FAIL)).otherwise(seq)
    return numbered(rows.select(tag.alias("tag"), seq.alias("seq")), "read_id").select("read_id", F.lit(0).alias("segment"), "tag", "seq", F.lit("").alias("qua"))


def _fastq(spark: SparkSession, path: str, linter: str, **lint) -> DataFrame:
    """n, tag, seq, qua of strict records of four lines."""
    x = lines(spark, path)
    pick = lambda i: F.max(F.when(F.col("ordinal") % 4 == i, F.col("value")))
    r = x.groupBy(F.floor(F.col("ordinal") / 4).cast("long").alias("n")).agg(pick(0).alias("a"), pick(1).alias("b"), pick(2).alias("c"), pick(3).alias("d"))
    bad = F.col("d").isNull() | ~F.col("a").startswith("@") | ~F.col("c").startswith("+")
    tag = F.when(bad, F.raise_error(F.concat(F.lit("malformed record "), F.col("n").cast("string"))).cast(_FAIL)).otherwise(F.substring("a", 2, 1 << 30))
    return r.select("n", tag.alias("tag"), sq.linter(linter)(F.col("b"), **lint).alias("seq"), F.col("d").alias("qua"))


def fastq(spark: SparkSession, path: str, linter: str = "dna", **lint) -> DataFrame:
    return _fastq(spark, path, linter, **lint).select(F.col("n").alias("read_id"), F.lit(0).alias("segment"), "tag", "seq", "qua")


def paired_fastq(spark: SparkSession, first: str, second: str, linter: str = "dna", **lint) -> DataFrame:
    """Two files in step; an error if one has more records."""
    a, b = (_fastq(spark, p, linter, **lint).select("n", F.struct(F.lit(i).alias("segment"), "tag", "seq", "qua").alias(f"s{i}")) for i, p in enumerate((first, second)))
    both = a.join(b, "n", "full_outer")
    fail = F.when(F.col("s0").isNull() | F.col("s1").isNull(), F.raise_error(F.lit("files of different lengths")).cast("array<string>"))
    both = both.select("n", F.explode(F.array("s0", "s1")).alias("s"), fail.alias("__f")).where("__f is null")
    return both.select(F.col("n").alias("read_id"), "s.segment", "s.tag", "s.seq", "s.qua")


def interleaved_fastq(spark: SparkSession, path: str, linter: str = "dna", **lint) -> DataFrame:
    r = _fastq(spark, path, linter, **lint)
    return r.select(F.floor(F.col("n") / 2).cast("long").alias("read_id"), (F.col("n") % 2).cast("int").alias("segment"), "tag", "seq", "qua")


def from_tabular(rows: DataFrame, linter: str = "dna", **lint) -> DataFrame:
    """Rows (ordinal, value) of 2, 3 or 6 tab-separated fields: FASTA, a single read, a pair."""
    p, n = F.split("value", "\t", -1), F.size(F.split("value", "\t", -1))
    one = lambda i, seg, qua: F.struct(F.lit(seg).alias("segment"), F.get(p, F.lit(i)).alias("tag"), F.get(p, F.lit(i + 1)).alias("seq"), qua.alias("qua"))
    kinds = (
        F.when(n == 2, F.array(one(0, 0, F.lit("")))).when(n == 3, F.array(one(0, 0, F.get(p, F.lit(2)))))
        .when(n == 6, F.array(one(0, 0, F.get(p, F.lit(2))), one(3, 1, F.get(p, F.lit(5)))))
        .otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), n.cast("string"))).cast("array<struct<segment:int,tag:string,seq:string,qua:string>>"))
    )
    x = rows.select(F.col("ordinal").alias("read_id"), F.explode(kinds).alias("s"))
    return x.select("read_id", "s.segment", "s.tag", sq.linter(linter)(F.col("s.seq"), **lint).alias("seq"), "s.qua")


def tabular(spark: SparkSession, path: str, linter: str = "dna", **lint) -> DataFrame:
    return from_tabular(lines(spark, path), linter, **lint)


READERS = {"fasta": fasta, "single_end_fastq": fastq, "paired_end_fastq": paired_fastq, "interleaved_fastq": interleaved_fastq, "tabular": tabular}


def read_sequences(spark: SparkSession, kind: str, *paths: str, linter: str = "dna", **lint) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unknown format {kind!r}")
    return READERS[kind](spark, *paths, linter=linter, **lint)


def junctions(spark: SparkSession, path: str, default_coverage: int = 0) -> DataFrame:
    """line, name, strand, donor, acceptor (0-based), coverage from rows of 4/5 fields (name, strand, two places) or 6/7
    (both ends with name and strand), the last being a coverage."""
    p, n = F.split("value", "\t", -1), F.size(F.split("value", "\t", -1))
    f = lambda i: F.get(p, F.lit(i))
    short = n.isin(4, 5)
    other = ~n.isin(4, 5, 6, 7) | (n.isin(6, 7) & ((f(0) != f(3)) | (sq.strand(f(1)) != sq.strand(f(4)))))
    donor, acceptor = f(2).cast("long") - 1, F.when(short, f(3)).otherwise(f(5)).cast("long") - 1
    cover = F.coalesce(F.when(short, F.try_element_at(p, F.lit(5))).otherwise(F.try_element_at(p, F.lit(7))).cast("long"), F.lit(default_coverage))
    bad = other | (donor < 0) | (acceptor < 0) | (cover < 0)
    rows = lines(spark, path).where("value <> ''")
    return rows.select(F.col("ordinal").alias("line"), F.when(bad, F.raise_error(F.concat(F.lit("bad junction at line "), F.col("ordinal").cast("string"))).cast("string")).otherwise(f(0)).alias("name"), sq.strand(f(1)).alias("strand"), donor.alias("donor"), acceptor.alias("acceptor"), cover.alias("coverage"))


def reference(spark: SparkSession, path: str, tables: str = "", linter: str = "dna") -> DataFrame:
    """name, seq, table_id; with a table file (name, table), a name without a table is an error, else it is 1. The last
    sequence of a name counts."""
    seqs = fasta(spark, path, linter).groupBy(F.col("tag").alias("name")).agg(F.max_by("seq", "read_id").alias("seq"))
    if not tables:
        return seqs.withColumn("table_id", F.lit(1))
    t = spark.read.text(tables).where("value <> ''").select(F.split("value", "\t")[0].alias("name"), F.split("value", "\t")[1].cast("int").alias("t")).groupBy("name").agg(F.last("t").alias("t"))
    fail = F.raise_error(F.concat(F.lit("no translation table for "), F.col("name"))).cast("int")
    return seqs.join(t, "name", "left").select("name", "seq", F.coalesce("t", fail).alias("table_id"))


def dictionary(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """id, word: non-empty lines, numbered from the last one up."""
    words = numbered(text_rows(spark, path).where("value <> ''"), "n").select("n", F.lower("value").alias("word") if lower else F.col("value").alias("word"))
    last = F.broadcast(words.agg(F.max("n").alias("top")))
    return words.crossJoin(last).select((F.col("top") - F.col("n")).alias("id"), "word")


def write_records(df: DataFrame, path: str) -> None:
    """FASTA and FASTQ files in a folder for each kind of record: fasta, SE, PE_1, PE_2."""
    from strandlake.operators.records import expand, output_kind

    kinds = df.withColumn("kind", output_kind())
    out = expand(df).join(kinds.select("read_id", "segment", "kind"), ["read_id", "segment"])
    out.sortWithinPartitions("read_id").select("kind", "record").write.partitionBy("kind").text(path)


def write_tabular(df: DataFrame, path: str) -> None:
    from strandlake.operators.records import compact

    compact(df).sortWithinPartitions("read_id").select("line").write.text(path)

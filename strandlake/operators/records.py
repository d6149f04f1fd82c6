"""Operators on reads: (read_id, segment, tag, seq, qua), one row a segment, qua '' for FASTA records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import sequences as sq


def java_regex(pattern: str) -> str:
    r"""A pattern whose groups and alternatives are \( \) \| (bare ones being literal) in Java's syntax."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            d = pattern[i + 1]
            out.append(d if d in "()|" else c + d)
            i += 2
            continue
        if c == "[":
            end = pattern.find("]", i + 2)
            if end > 0:
                out.append(pattern[i : end + 1].replace("[", "\\[").replace("\\[", "[", 1))
                i = end + 1
                continue
        out.append("\\" + c if c in "(){}|" else c)
        i += 1
    return "".join(out)


def compact(df: DataFrame) -> DataFrame:
    """line: a tab-separated row for each read: two fields for FASTA, three for single reads, six for pairs."""
    one = F.when(F.col("qua") == "", F.concat_ws("\t", "tag", "seq")).otherwise(F.concat_ws("\t", "tag", "seq", "qua"))
    return (
        df.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("segment", one.alias("row")))).alias("rows"))
        .select("read_id", F.array_join(F.transform("rows", lambda r: r["row"]), "\t").alias("line"))
    )


def expand(df: DataFrame) -> DataFrame:
    """record: the lines of a FASTA or FASTQ record, without the last end of line."""
    fasta = F.concat(F.lit(">"), F.col("tag"), F.lit("\n"), F.col("seq"))
    fastq = F.concat(F.lit("@"), F.col("tag"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qua"))
    return df.select("read_id", "segment", F.when(F.col("qua") == "", fasta).otherwise(fastq).alias("record"))


def match(df: DataFrame, pattern: str) -> DataFrame:
    """Reads of which a segment's tag matches somewhere: both mates stay if either matches."""
    hit = F.max(F.col("tag").rlike(java_regex(pattern))).over(Window.partitionBy("read_id"))
    return df.withColumn("__hit", hit).where("__hit").drop("__hit")


def rename(df: DataFrame, pattern: str, template: str) -> DataFrame:
    r"""Every match in tags replaced; \0 to \9 in the template are groups."""
    out = re.sub(r"\\([0-9])", r"$\1", template.replace("$", "\\$"))
    return df.withColumn("tag", F.regexp_replace("tag", java_regex(pattern), out))


def reverse_complement(df: DataFrame) -> DataFrame:
    return df.withColumns({"seq": sq.rc(F.col("seq")), "qua": F.reverse("qua")})


def drop_qualities(df: DataFrame) -> DataFrame:
    return df.withColumn("qua", F.lit(""))


def lint(df: DataFrame, kind: str = "dna", keep_lowercase: bool = False, keep_dashes: bool = False) -> DataFrame:
    return df.withColumn("seq", sq.linter(kind)(F.col("seq"), keep_lowercase=keep_lowercase, keep_dashes=keep_dashes))


def store_length(df: DataFrame) -> DataFrame:
    """n_reads, n_segments, n_bases."""
    return df.agg(F.count_distinct("read_id").alias("n_reads"), F.count(F.lit(1)).alias("n_segments"), F.sum(F.length("seq")).alias("n_bases"))


CLASSES = {0: "singleton", 1: "selected", 2: "unmarked"}


def classify(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Reads with their class (of classes: read_id, class) before the tag; every read must have one."""
    names = F.create_map(*(F.lit(x) for kv in CLASSES.items() for x in kv))
    joined = df.join(classes.select("read_id", "class"), "read_id", "left")
    name = F.coalesce(F.try_element_at(names, F.col("class").cast("int")), F.raise_error(F.lit("a read without a class")).cast("string"))
    return joined.withColumn("tag", F.concat(name, F.lit("__"), F.col("tag"))).drop("class")


def output_kind() -> Column:
    """The file a record goes to: fasta, SE.fastq, PE_1.fastq or PE_2.fastq."""
    pair = F.count(F.lit(1)).over(Window.partitionBy("read_id")) > 1
    return F.when(F.col("qua") == "", "fasta").when(pair, F.concat(F.lit("PE_"), (F.col("segment") + 1).cast("string"))).otherwise("SE")

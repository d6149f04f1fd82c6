"""The operators that need no state, and k-mer counts, over streams of tabular reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import sequences as sq
from strandlake.operators.kmers import Content, Hasher, spectrum
from strandlake.sources.reads import from_tabular


def stream_tabular(spark: SparkSession, folder: str, linter: str = "dna") -> DataFrame:
    """Reads of the files that arrive in a folder; read_id hashes the line, as a stream has no line numbers."""
    raw = spark.readStream.schema("value string").text(folder).select(F.xxhash64("value").alias("ordinal"), F.regexp_replace("value", "\r", "").alias("value"))
    return from_tabular(raw, linter)


def stream_reverse_complement(reads: DataFrame) -> DataFrame:
    return reads.withColumns({"seq": sq.rc(F.col("seq")), "qua": F.reverse("qua")})


def stream_spectrum(reads: DataFrame, content: Content, hasher: Hasher) -> DataFrame:
    """The running spectrum: for output mode update or complete."""
    return spectrum(reads, content, hasher)

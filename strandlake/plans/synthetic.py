"""Stand-ins for biological data, derived from the driver's tables alike in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.plans.tables import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(text: Column) -> Column:
    return F.translate(F.md5(F.coalesce(text, F.lit("")).cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")


DNA_SQL = "translate(md5(coalesce(text, '')), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, segment, tag, seq, qua: one row a document, documents 2n and 2n + 1 being mates."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    md5 = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return d.select(F.floor(F.col("doc_id") / 2).cast("long").alias("read_id"), (F.col("doc_id") % 2).cast("int").alias("segment"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("tag"), dna(F.col("text")).alias("seq"), md5.alias("qua"))


READS_SQL = f"""SELECT doc_id // 2 AS read_id, (doc_id % 2)::INT AS segment, 'doc_' || doc_id AS tag, {DNA_SQL} AS seq, md5(coalesce(text, '')) AS qua FROM documents"""


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, seq: 25 names, each with the sequence of its document of smallest id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.groupBy(F.concat(F.lit("chr"), (F.col("doc_id") % 25).cast("string")).alias("name")).agg(F.min_by(dna(F.col("text")), "doc_id").alias("seq"))


REFERENCE_SQL = f"""SELECT 'chr' || (doc_id % 25) AS name, min_by({DNA_SQL}, doc_id) AS seq FROM documents GROUP BY 1"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seq, low, length, strand: a feature for each row of lineitem, on 30 names of which 5 are not in the reference."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("chr"), (F.col("l_suppkey") % 30).cast("string")).alias("seq"),
        (F.col("l_partkey") % 40).cast("long").alias("low"), F.col("l_quantity").cast("long").alias("length"),
        F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-").alias("strand"))


FEATURES_SQL = """SELECT l_orderkey || '_' || l_linenumber AS id, 'chr' || (l_suppkey % 30) AS seq, (l_partkey % 40)::BIGINT AS low,
    l_quantity::BIGINT AS length, CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand FROM lineitem"""


def mixed(text: Column) -> Column:
    """A sequence for each whole text: either case, N, dashes and letters that are none."""
    return F.translate(F.coalesce(text, F.lit("")), "abcdefghijklmnopqrstuvwxyz >\n\r\t", "ACGTacgtN-ACGTACGTNacgtACG-NNNN")


MIXED_SQL = "translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz >' || chr(10) || chr(13) || chr(9), 'ACGTacgtN-ACGTACGTNacgtACG-NNNN')"


def text_file(df: DataFrame, name: str, compression: str = "none") -> str:
    """A folder of text files with df's one column, in the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.text(path, compression)
    return path

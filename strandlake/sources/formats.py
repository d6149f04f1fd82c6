"""What the readers and writers share: numbered lines and C's %g."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def c_general(x: float, digits: int = 15) -> str:
    """A number as C's %.<digits>g prints it."""
    return f"{x:.{digits}g}"


def general_column(c: Column, digits: int = 15) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: c_general(x, digits), na_action="ignore")

    return run(c)


def numbered(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """df with contiguous numbers in its order: each partition's rows are counted, then shifted by those before it.

    Two passes over the input, no sort and no gathering: what is summed is one row for each partition.
    """
    own = F.monotonically_increasing_id()
    marked = df.withColumn("__id", own).withColumn("__p", F.shiftright("__id", 33))
    counts = marked.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("__p", before.alias("__before"))
    return marked.join(F.broadcast(shifts), "__p").withColumn(name, F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__p", "__before")


def text_rows(spark: SparkSession, path: str, name: str = "ordinal", line_sep: str | None = None, first: str | None = None) -> DataFrame:
    """value and its number over all files of a path, by file name and place in the file, however files are cut into tasks; with
    `first`, a column of that name marks the first row of each file.

    As numbered(), but what is summed is one row for each stretch of a file, of 24 bytes, so what is broadcast is some
    megabytes where files have a hundred thousand stretches.
    """
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    stretch = [F.xxhash64("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b")]
    marked = reader.text(path).select("value", F.col("_metadata.file_path").alias("__path"), *stretch, F.monotonically_increasing_id().alias("__id"))
    # the path is a key: as a sum's value, a string, all rows of a task would be sorted
    counts = marked.groupBy("__path", "__f", "__b").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__path", "__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("__f", "__b", "__first", (before - F.col("__first")).alias("__shift"))
    heads = [((F.col("__b") == 0) & (F.col("__id") == F.col("__first"))).alias(first)] if first else []
    return marked.join(F.broadcast(shifts), ["__f", "__b"]).select("value", (F.col("__id") + F.col("__shift")).alias(name), *heads)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, value: the lines of a file without \\r."""
    return text_rows(spark, path).select("ordinal", F.regexp_replace("value", "\r", "").alias("value"))

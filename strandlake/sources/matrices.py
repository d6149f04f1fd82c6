"""Reader and writer of tab-separated labelled matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources.formats import general_column, lines


def _name(c):
    inner = F.regexp_replace(c, '^"(.*)"$', "$1")
    return F.when(inner.contains('"'), F.raise_error(F.concat(F.lit("stray quote in "), c)).cast("string")).otherwise(inner)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """row, row_idx, col, col_idx, value. The first line holds column names after one ignored cell; a blank line ends the
    matrix; a row of another width is an error."""
    x = lines(spark, path)
    stop = F.broadcast(x.where("value = ''").agg(F.min("ordinal").alias("stop")))
    x = x.crossJoin(stop).where("stop is null or ordinal < stop")
    head = F.broadcast(x.where("ordinal = 0").select(F.slice(F.split("value", "\t", -1), F.lit(2), F.greatest(F.size(F.split("value", "\t", -1)) - 1, F.lit(0))).alias("head")))
    body = x.where("ordinal > 0").select((F.col("ordinal") - 1).alias("row_idx"), F.split("value", "\t", -1).alias("p")).crossJoin(head)
    ragged = F.raise_error(F.concat(F.lit("ragged row "), F.col("row_idx").cast("string"))).cast("array<string>")
    cells = F.when(F.size("p") == F.size("head") + 1, F.slice("p", F.lit(2), F.size("head"))).otherwise(ragged)
    out = body.select(_name(F.col("p")[0]).alias("row"), "row_idx", "head", F.posexplode(cells).alias("col_idx", "v"))
    return out.select("row", "row_idx", _name(F.get("head", F.col("col_idx"))).alias("col"), "col_idx", F.col("v").cast("double").alias("value"))


def matrix_lines(m: DataFrame, digits: int = 15) -> DataFrame:
    """line, ordered by row name, the header first; nothing of an empty matrix. Columns are in the order of their names."""
    cells = m.withColumn("t", general_column(F.col("value"), digits))
    body = cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "t"))).alias("c")).select(F.lit(1).alias("k"), "row", F.concat(F.col("row"), F.lit("\t"), F.array_join(F.transform("c", lambda x: x["t"]), "\t")).alias("line"))
    head = m.select("col").distinct().agg(F.array_sort(F.collect_list("col")).alias("c")).where("size(c) > 0").select(F.lit(0).alias("k"), F.lit("").alias("row"), F.concat(F.lit("\t"), F.array_join("c", "\t")).alias("line"))
    return head.union(body).orderBy("k", "row").select("line")


def write_matrix(m: DataFrame, path: str, digits: int = 15) -> None:
    matrix_lines(m, digits).write.text(path)

"""Words within an edit distance of each other, joined by segments.

Of a word cut to radius + 1 segments, radius edits leave one segment as it is, and move it by radius places at most. So words
of one table give their segments, words of the other all stretches that may be such a segment, both meet there, and what meets is
verified inside the join. Keys hold the length of the word and the segment's number, so a frequent stretch is many keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Start and length of segment i of a word of `length` letters."""
    start = F.floor(length * i / parts).cast("int")
    return start, F.floor(length * (i + 1) / parts).cast("int") - start


def _segments(words: DataFrame, radius: int) -> DataFrame:
    """word, n (its length), i, segment."""
    x = words.select("word", F.length("word").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(radius))).alias("i"))
    start, size = _segment(F.col("n"), F.col("i"), radius + 1)
    return x.select("word", "n", "i", F.substring("word", start + 1, size).alias("segment"))


def _stretches(words: DataFrame, radius: int) -> DataFrame:
    """word, n (the length of a word that it may be near to), i, segment: each once."""
    x = words.select("word", F.length("word").alias("own"), F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("more"))
    x = x.select("word", "own", (F.col("own") + F.col("more")).alias("n"), F.explode(F.sequence(F.lit(0), F.lit(radius))).alias("i")).where("n >= 0")
    start, size = _segment(F.col("n"), F.col("i"), radius + 1)
    x = x.select("word", "own", "n", "i", size.alias("size"), F.explode(F.sequence(F.greatest(start - radius, F.lit(0)), start + radius)).alias("at")).where("at + size <= own")
    return x.select("word", "n", "i", F.substring("word", F.col("at") + 1, F.col("size")).alias("segment")).distinct()


def neighbour_join(a: DataFrame, b: DataFrame, radius: int = 1) -> DataFrame:
    """a, b, distance: each pair of a word of a and a word of b (both: word) at most `radius` inserted, deleted or replaced
    code points apart, once. Nulls are no words; words that repeat count once."""
    if radius < 0:
        raise ValueError(f"a negative radius: {radius}")
    clean = lambda x: x.select("word").where("word is not null").distinct()
    left, right = _segments(clean(a), radius).withColumnRenamed("word", "a"), _stretches(clean(b), radius).withColumnRenamed("word", "b")
    distance = F.levenshtein("a", "b", radius)
    return left.join(right, ["n", "i", "segment"]).where(distance >= 0).select("a", "b").distinct().select("a", "b", distance.alias("distance"))

"""Transitive closure of labels: equivalence classes of the members of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.plans.tables import components


def tokenize_lines(lines: DataFrame, value: str = "value", line: str = "line") -> DataFrame:
    """line, element: words between blanks and tabs, each once a line; lines without words are left out."""
    words = F.array_distinct(F.split(F.regexp_replace(F.col(value), "^[ \t]+|[ \t]+$", ""), "[ \t]+"))
    return lines.select(F.col(line).alias("line"), F.explode(words).alias("element")).where("element <> ''")


def equivalence_classes(members: DataFrame) -> DataFrame:
    """class (the first line that its members stand in), element, first_line, for members (line, element).

    Lines are joined by the elements they share: each element links its lines to the first of them, so the edges are as
    many as the members, not pairs of them.
    """
    first = members.groupBy("element").agg(F.min("line").alias("first_line"))
    linked = members.join(first, "element").select(F.col("line").cast("long").alias("a"), F.col("first_line").cast("long").alias("b"))
    parts = components(linked)
    return first.join(parts, first["first_line"] == parts["id"], "left").select(F.coalesce("component", F.col("first_line").cast("long")).alias("class"), "element", "first_line")


def class_lines(classes: DataFrame, order: str = "input") -> DataFrame:
    """class, line: a tab-separated line for each class, by first line; members by first line and bytes, or by bytes alone."""
    key = F.struct("first_line", "element") if order == "input" else F.struct(F.col("element").alias("x"), "element")
    return classes.groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["element"]), "\t").alias("line")).orderBy("class")


def cardinal(members: DataFrame) -> DataFrame:
    """n: how many different elements there are."""
    return members.agg(F.count_distinct("element").alias("n"))

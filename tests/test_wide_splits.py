"""Splits of many names cost what they list."""

from pyspark.sql import functions as F

from strandlake.operators import splits


def test_smaller_sides_are_those_of_both_sides(spark):
    n = 6
    every = [[b for b in range(n) if m >> b & 1] for m in range(1, 2**n - 1)]
    x = spark.createDataFrame([(b, [c for c in range(n) if c not in b]) for b in every], "a array<long>, b array<long>")
    side = splits.smaller_side(F.col("a"), n)
    for r in x.select("a", "b", side.alias("s"), splits.smaller_side(F.col("b"), n).alias("t"), splits.canonical_bits(side, n).alias("c")).collect():
        assert r.s == r.t and len(r.s) <= n // 2 and r.c == (r.b if n - 1 in r.a else r.a)
    n = 100000
    wide = spark.range(2000).select(F.array(F.col("id") + 7, F.col("id")).alias("a"), F.lit(1.0).alias("weight"))
    assert splits.merge_listed(wide.select(splits.smaller_side(F.col("a"), n).alias("side"), "weight")).agg(F.max(F.size("side"))).first()[0] == 2


def test_words_of_nodes_are_only_those_with_bits(spark):
    # a chain of 70 leaves; each inner node has a leaf and the next one below it
    nodes = spark.createDataFrame([(0, 2 * i + j, 2 * i - 2 if i else -1, "") if not j else (0, 2 * i + 1, 2 * i, f"n{i:03}") for i in range(70) for j in range(2)], "tree_id long, idx int, parent_idx int, name string")
    leaves = spark.createDataFrame([(0, 2 * i + 1, i // 64, 1 << i % 62) for i in range(70)], "tree_id long, idx int, word int, bits long")
    up = splits.words_up(nodes, leaves)
    assert up.where("idx % 2 = 1").count() == 70
    assert up.where("idx = 0").count() == 2 and up.where("idx = 138").count() == 1
    s = splits.tree_masks(nodes)
    sizes = [r[0] for r in s.select(splits.size(F.col("mask")).alias("n")).collect()]
    assert sorted(sizes) == list(range(2, 69))

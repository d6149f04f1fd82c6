"""Packed masks against whole numbers of any width."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import splits, trees
from strandlake.sources import newick


def number(words):
    return sum((w & (1 << 64) - 1) << 64 * i for i, w in enumerate(words))


def bits_of(m):
    return [i for i in range(m.bit_length()) if m >> i & 1]


@pytest.mark.parametrize("n", [2, 63, 64, 65, 1000])
def test_masks(spark, n):
    rng = random.Random(n)
    sets = [sorted(rng.sample(range(n), rng.randint(1, n - 1))) for _ in range(60)] + [[0], [n - 1], list(range(n)), []]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, bits array<int>")
    m = F.col("m")
    got = df.withColumn("m", splits.pack(F.col("bits"), n)).select("i", "m", splits.canonical(m, n).alias("c"), splits.complement(m, n).alias("o"), splits.size(m).alias("size"), splits.unpack(m).alias("back"), splits.is_empty(m).alias("none"))
    full = (1 << n) - 1
    for r in got.collect():
        x = sum(1 << b for b in sets[r.i])
        assert (number(r.m), number(r.c), number(r.o), r["size"], r.back, r.none) == (x, min(x, full ^ x), full ^ x, len(sets[r.i]), sets[r.i], not sets[r.i])
    with pytest.raises(Exception, match="beyond"):
        df.select(splits.pack(F.array(F.lit(n)), n)).collect()
    if n % 64:
        with pytest.raises(Exception, match="too many"):
            spark.createDataFrame([([-1] * -(-n // 64),)], "m array<long>").select(splits.canonical(m, n)).collect()


@pytest.mark.parametrize("n", [6, 130])
def test_conflicts(spark, n):
    rng = random.Random(n)
    masks = {min(m, (1 << n) - 1 ^ m) for m in (sum(1 << rng.randrange(n) for _ in range(1)) | rng.getrandbits(n) & rng.getrandbits(n) for _ in range(70))} - {0}
    df = spark.createDataFrame([(bits_of(m),) for m in sorted(masks)], "bits array<int>").select(splits.pack(F.col("bits"), n).alias("mask"))
    got = sorted(tuple(sorted((number(r.a), number(r.b)))) for r in splits.conflicts(df).collect())
    full = (1 << n) - 1
    assert got == sorted((a, b) for a in masks for b in masks if a < b and a & b and a & ~b and b & ~a and full & ~(a | b))


def test_tree_masks_and_back(spark):
    """Splits of random trees of more leaves than a word has bits, and the trees that they give again."""
    rng = random.Random(9)

    def grow(names):
        if len(names) == 1:
            return names[0]
        k = rng.randint(1, len(names) - 1)
        return f"({grow(names[:k])},{grow(names[k:])})"

    texts, leaves = [], [[f"n{i:03}" for i in range(k)] for k in (4, 64, 90)]
    for names in leaves:
        rng.shuffle(names)
        texts.append(grow(names) + ";")
    nodes = newick.read_trees(spark.createDataFrame(list(enumerate(texts)), "tree_id long, value string"))
    rows = splits.tree_masks(nodes).collect()
    plain = {(r.tree_id, tuple(r.members)) for r in trees.tree_splits(nodes).collect()}
    assert {(r.tree_id, tuple(sorted(leaves[r.tree_id])[b] for b in bits_of(number(r.mask)))) for r in rows} == plain and len(rows) == len(plain)
    assert splits.conflicts(splits.tree_masks(nodes.where("tree_id = 2"))).count() == 0
    register = splits.tree_masks(nodes).select(F.col("tree_id").cast("string").alias("register_id"), "mask", F.lit(1.0).alias("weight"))
    names = spark.createDataFrame([(str(t), i, x) for t, ns in enumerate(leaves) for i, x in enumerate(sorted(ns))], "register_id string, bit int, name string")
    back = trees.splits_to_trees(register, names, strict=True).collect()
    again = newick.read_trees(spark.createDataFrame([(int(r.register_id), r.newick) for r in back], "tree_id long, value string"))
    assert {(r.tree_id, tuple(r.members)) for r in trees.tree_splits(again).collect()} == plain
    wrong = spark.createDataFrame([("0", [0b0011], 1.0), ("0", [0b0110], 1.0)], "register_id string, mask array<long>, weight double")
    with pytest.raises(Exception, match="overlap"):
        trees.splits_to_trees(wrong, names, strict=True).collect()
    with pytest.raises(Exception, match="several"):
        splits.tree_masks(newick.read_trees(spark.createDataFrame([(0, "((a,b),(a,c));")], "tree_id long, value string"))).collect()

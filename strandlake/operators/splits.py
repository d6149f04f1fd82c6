"""Splits of any number of names as packed masks.

A mask is an array of longs, word w holding the bits of names 64 w to 64 w + 63. All operations are column expressions over the
words, so registers of thousands of names need no other path than small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.statistics import ranged
from strandlake.plans.tables import written


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))


def _lower(i: Column) -> Column:
    """The bits of a word below bit i."""
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), (i % 64).cast("int")))


def _whole(n: int) -> Column:
    """The words of the mask that has all n names."""
    words = [-1] * (n // 64) + ([(1 << n % 64) - 1] if n % 64 else [])
    return F.array(*(F.lit(w).cast("long") for w in words))


def pack(bits: Column, n: int) -> Column:
    """The mask of an array of bits, each from 0 to n - 1; others are an error. A bit that is there twice counts once."""
    words = F.transform(F.sequence(F.lit(0), F.lit((n - 1) // 64)), lambda w: F.aggregate(F.filter(bits, lambda b: F.floor(b / 64) == w), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(_bit(b))))
    bad = F.exists(bits, lambda b: (b < 0) | (b >= n))
    return F.when(bad, F.raise_error(F.lit("a bit beyond the names")).cast("array<long>")).otherwise(words)


def unpack(mask: Column) -> Column:
    """The bits of a mask, ascending."""
    every = F.sequence(F.lit(0), F.size(mask) * 64 - 1)
    return F.filter(every, lambda b: F.get(mask, F.floor(b / 64).cast("int")).bitwiseAND(_bit(b)) != 0)


def meet(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def without(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def complement(mask: Column, n: int) -> Column:
    return F.zip_with(_whole(n), mask, lambda x, y: x.bitwiseXOR(y))


def is_empty(mask: Column) -> Column:
    return ~F.exists(mask, lambda w: w != 0)


def size(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, w: a + F.bit_count(w))


def checked(mask: Column, n: int) -> Column:
    """mask, an error if it has another number of words or bits beyond n names."""
    bad = (F.size(mask) != (n + 63) // 64) | ~is_empty(without(mask, _whole(n)))
    return F.when(bad, F.raise_error(F.lit("too many bits")).cast("array<long>")).otherwise(mask)


def canonical(mask: Column, n: int) -> Column:
    """The smaller of a mask and its complement, as numbers: the one without the last name."""
    last = F.get(mask, (n - 1) // 64).bitwiseAND(_bit(F.lit(n - 1))) != 0
    return F.when(last, complement(checked(mask, n), n)).otherwise(checked(mask, n))


def smaller_side(bits: Column, n: int) -> Column:
    """Of a split's side, given as an array of bits from 0 to n - 1, and the other, the one with fewer names, ascending; of two as large,
    the one without the last name. As long as what is given at most, however many names there are, and the same for both sides."""
    b = F.array_sort(F.array_distinct(bits))
    bad = F.exists(b, lambda x: (x < 0) | (x >= n))
    other = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), b)
    large = (F.size(b) * 2 > n) | ((F.size(b) * 2 == n) & F.array_contains(b, F.lit(n - 1).cast("long")))
    return F.when(bad, F.raise_error(F.lit("a bit beyond the names")).cast("array<long>")).when(large, other).otherwise(b)


def canonical_bits(side: Column, n: int) -> Column:
    """The bits of the canonical side (without the last name) of a split of which a side is listed."""
    last = F.lit(n - 1).cast("long")
    return F.when(F.array_contains(side, last), F.array_except(F.sequence(F.lit(0).cast("long"), last), side)).otherwise(side)


def merge_listed(splits: DataFrame) -> DataFrame:
    """side, weight: the weights of equal splits (side: smaller_side()) added. A row is as long as its smaller side, where a packed
    mask has a bit for every name."""
    return splits.groupBy("side").agg(F.sum("weight").alias("weight"))


def merge(*registers: DataFrame) -> DataFrame:
    """mask, weight: the weights of equal splits added."""
    out = registers[0].select("mask", "weight")
    for r in registers[1:]:
        out = out.unionByName(r.select("mask", "weight"))
    return out.groupBy("mask").agg(F.sum("weight").alias("weight"))


def _no_lower(common: Column, bit: Column) -> Column:
    """Whether a mask has no bit below one that it has."""
    word = F.floor(bit / 64).cast("int")
    return ~F.exists(F.transform(common, lambda w, i: F.when(i < word, w).when(i == word, w.bitwiseAND(_lower(bit))).otherwise(0)), lambda w: w != 0)


def conflicts(splits: DataFrame) -> DataFrame:
    """a, b (masks): each pair of canonical splits (mask) that no tree can hold together, once.

    Canonical sides leave the last name outside, so two of them go together if they are disjoint or one holds the other. What
    is not disjoint shares a name: masks meet at their names, each pair at the first that it shares, and is kept if
    neither holds the other.
    """
    x = splits.select("mask").distinct().select("mask", F.explode(unpack(F.col("mask"))).alias("bit"))
    pair = x.select(F.col("mask").alias("a"), "bit").join(x.select(F.col("mask").alias("b"), "bit"), "bit").where(F.col("a") < F.col("b"))
    a, b = F.col("a"), F.col("b")
    return pair.where(_no_lower(meet(a, b), F.col("bit")) & ~is_empty(without(a, b)) & ~is_empty(without(b, a))).select("a", "b")


def words_up(nodes: DataFrame, words: DataFrame) -> DataFrame:
    """tree_id, idx, word, bits: of each node the words of all below it and its own (words: the same columns) put together, by doubling
    as in fold_up(). A round is a written table."""
    up = nodes.select("tree_id", "idx", F.when(F.col("parent_idx") >= 0, F.col("parent_idx")).alias("up")).where("up is not null")
    now = words
    while not (up := written(up, "ups")).isEmpty():
        come = now.join(up, ["tree_id", "idx"]).select("tree_id", F.col("up").alias("idx"), "word", "bits")
        now = written(now.unionByName(come).groupBy("tree_id", "idx", "word").agg(F.bit_or("bits").alias("bits")), "words")
        up = up.join(up.select("tree_id", F.col("idx").alias("up"), F.col("up").alias("__up")), ["tree_id", "up"]).select("tree_id", "idx", F.col("__up").alias("up"))
    return now


def tree_masks(nodes: DataFrame) -> DataFrame:
    """tree_id, mask, n: the canonical split of each inner node that parts the leaves to two sides of two at least, each split once
    a tree. Names are numbered in order; a leaf without a name or a name that is there twice in a tree is an error.

    Of each node only the words that have a bit are rows while masks are folded from the leaves up: a leaf has one, a node at
    most as many as it has leaves below it."""
    inner = nodes.where("parent_idx >= 0").select("tree_id", F.col("parent_idx").alias("idx")).distinct()
    leaves = nodes.join(inner, ["tree_id", "idx"], "left_anti").select("tree_id", "idx", "name")
    twice = leaves.groupBy("tree_id", "name").agg(F.count(F.lit(1)).alias("__k"))
    fault = F.when(F.coalesce("name", F.lit("")) == "", "a leaf without a name").when(F.col("__k") > 1, "a name of several leaves")
    leaves = leaves.join(twice, ["tree_id", "name"], "left").withColumn("name", F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(F.col("name"))).drop("__k")
    leaves = written(ranged(leaves, F.asc("name"), F.lit(1).cast("long"), "tree_id").select("tree_id", "idx", F.col("__before").alias("bit"), F.col("__all").alias("n")), "leaves")
    x = words_up(nodes, leaves.select("tree_id", "idx", F.floor(F.col("bit") / 64).cast("int").alias("word"), _bit(F.col("bit")).alias("bits")))
    masks = x.join(inner, ["tree_id", "idx"], "left_semi").groupBy("tree_id", "idx").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    masks = masks.join(leaves.select("tree_id", "n").distinct(), "tree_id")
    # trees of one frame may have different numbers of leaves: the mask has the words that its tree needs
    place = F.sequence(F.lit(0), F.ceil(F.col("n") / 64).cast("int") - 1)
    masks = masks.select("tree_id", "n", F.map_concat(F.map_from_arrays(F.array_except(place, F.map_keys("m")), F.transform(F.array_except(place, F.map_keys("m")), lambda _: F.lit(0).cast("long"))), "m").alias("m"))
    masks = masks.select("tree_id", "n", F.transform(F.array_sort(F.map_entries("m")), lambda e: e["value"]).alias("mask"))
    mask = F.col("mask")
    last = F.get(mask, F.floor((F.col("n") - 1) / 64).cast("int")).bitwiseAND(_bit(F.col("n") - 1)) != 0
    whole = F.transform(mask, lambda _, i: F.when((i + 1) * 64 <= F.col("n"), F.lit(-1).cast("long")).otherwise(_lower(F.col("n"))))
    s = masks.select("tree_id", "n", F.when(last, F.zip_with(whole, mask, lambda x, y: x.bitwiseXOR(y))).otherwise(mask).alias("mask"))
    return s.where((size(F.col("mask")) > 1) & (size(F.col("mask")) < F.col("n") - 1)).select("tree_id", "mask", "n").distinct()

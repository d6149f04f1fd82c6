"""Mixing sources to target weights, in DataFrame operations only.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and share all words; a target stops at
`most` times its source's words, and the excess is shared by weight among the rest until none is above. That is a water
level: target = min(cap, level * weight), found from running sums over the sources in order of cap / weight.

Drawing: a document's place in its source's permutation is a keyed hash of its id, its high digits being its block. A
source is passed over whole as often as its target holds its words, and once more in part: whole blocks in permuted
order as far as the target goes, then the next block's sub-blocks, then that one's documents, and at last the largest
documents outside that still fit, until none does. Each step keeps sums per block, never a row list per source, so a
source that holds a third of all rows costs no task more than another.

Output shards: a splitting tree. The root holds each source's exact quota of blocks; a node deals half of its blocks to
each child, the sources' shares of the left child being one multivariate-hypergeometric draw made source by source by
inverting the hypergeometric distribution function at a keyed uniform number. A leaf's quotas are ranges of its source's
permuted sequence of blocks, so shards hold disjoint blocks; within a shard documents are in hashed order.

Defined cases: null and empty texts and texts of blanks have size 0 and are taken as often as their block; rows that
repeat are permuted by id and a hash of the text; sources of no words have target 0; a null source is a source; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import WORD, free_name, identity, written


@dataclass(frozen=True)
class Settings:
    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    #: Blocks of a source, and sub-blocks of a block: a power of 16.
    blocks: int = 256
    #: Output shards: a power of two.
    shards: int = 16
    seed: int = 5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that orders sources by code point with null last, and is never null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source))


def targets(sizes: DataFrame, s: Settings) -> DataFrame:
    """__src, source_size, target from rows (__src, size). One row a source: the windows run over sources, not documents."""
    by = sizes.groupBy("__src").agg(F.sum("size").alias("source_size"))
    ranked = by.withColumn("__i", F.row_number().over(Window.orderBy("__src")) - 1)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in s.weights)), (F.col("__i") % len(s.weights) + 1).cast("int"))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "__src")
    every = Window.partitionBy()
    t = ranked.select("__src", "source_size", w.alias("__w"), (F.col("source_size") * float(s.most)).alias("__cap"))
    t = t.select(
        "*", F.sum("source_size").over(every).alias("__all"),
        F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__full"),
        F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("__rest"))
    level = (F.col("__all") - F.col("__full")) / F.col("__rest")
    # the first source, by cap / weight, that the level does not fill sets the level for all from there on
    t = t.withColumn("__level", F.max(F.when(level * F.col("__w") <= F.col("__cap"), level)).over(every))
    return t.select("__src", "source_size", F.least("__cap", F.coalesce(F.col("__level") * F.col("__w"), "__cap")).alias("target"))


def _digit(level: int, s: Settings) -> Column:
    """A block number from the hex digits of the permuting hash."""
    n = len(f"{s.blocks - 1:x}")
    return F.conv(F.substring("__hash", level * n + 1, n), 16, 10).cast("int")


def _split(rows: DataFrame, room: DataFrame, unit: Column, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Of each source's units in permuted order, those that fit its room whole.

    rows: __src, size, columns of unit. Returns (__src, __unit, __in) for units up to the first that does not fit, and
    the new room: __src, __room, __next (the unit that does not fit, null if all fit).
    """
    sums = rows.select("__src", "size", unit.alias("__unit")).groupBy("__src", "__unit").agg(F.sum("size").alias("__words"))
    w = Window.partitionBy("__src").orderBy("__unit").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.join(room, "__src").withColumn("__sum", F.sum("__words").over(w)).withColumn("__in", F.col("__sum") <= F.col("__room"))
    left = run.groupBy("__src").agg(
        (F.first("__room") - F.coalesce(F.max(F.when(F.col("__in"), F.col("__sum"))), F.lit(0))).alias("__left"),
        F.min(F.when(~F.col("__in"), F.col("__unit"))).alias("__next"))
    return run.select("__src", "__unit", "__in"), left.withColumnRenamed("__left", "__room")


def with_source(rows: DataFrame, small: DataFrame, salts: int = 32) -> DataFrame:
    """rows (__src, __hash, ...) with what `small` holds for their source: each source's row meets its rows in several tasks,
    as one source may hold a third of them."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("__hash"), F.lit(salts)).cast("int"))
    return salted.join(small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["__src", "__salt"]).drop("__salt")


def _fill(units: DataFrame, left: DataFrame, s: Settings) -> list[DataFrame]:
    """Tables (__src, __hash) of the units that are taken when, again and again, each source's largest unit (of the last hash
    among equals) that fits its room is, until none fits.

    units: __src, __hash, size; left: __src, __room. A round goes down a source's sizes as long as all units of a size fit,
    and takes of the next size as many as fit. What it leaves is less than that size, so the room halves in each round at
    least, and what fits later was not met yet. Windows run over sizes and blocks, not over units.
    """
    out = []
    while True:
        fit = with_source(units, left).where("size <= __room")
        down = Window.partitionBy("__src").orderBy(F.col("size").desc())
        sums = fit.groupBy("__src", "size").agg(F.count(F.lit(1)).alias("__n"), F.first("__room").alias("__room"))
        sums = sums.withColumn("__sum", F.sum(F.col("__n") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
        all_in = F.col("__sum") <= F.col("__room")
        step = sums.groupBy("__src").agg(
            (F.first("__room") - F.coalesce(F.max(F.when(all_in, F.col("__sum"))), F.lit(0))).alias("__over"),
            F.coalesce(F.max(F.when(~all_in, F.col("size"))), F.lit(0)).alias("__size"))
        some = F.when(F.col("__size") > 0, F.floor(F.col("__over") / F.col("__size"))).otherwise(0).cast("long")
        step = written(step.withColumn("__some", some), "mix-fill")
        if step.isEmpty():
            return out
        fit = with_source(fit.drop("__room"), step)
        edge = fit.where("size = __size and __some > 0").withColumn("__block", _digit(0, s))
        blocks = edge.groupBy("__src", "__block").agg(F.count(F.lit(1)).alias("__n"))
        before = F.sum("__n").over(Window.partitionBy("__src").orderBy(F.col("__block").desc()).rowsBetween(Window.unboundedPreceding, -1))
        blocks = blocks.select("__src", "__block", F.coalesce(before, F.lit(0)).alias("__before"))
        place = F.row_number().over(Window.partitionBy("__src", "__block").orderBy(F.col("__hash").desc()))
        edge = edge.join(blocks, ["__src", "__block"]).where("__before < __some").withColumn("__place", F.col("__before") + place).where("__place <= __some")
        out.append(written(fit.where("size > __size").select("__src", "__hash").union(edge.select("__src", "__hash")), "mix-filled"))
        # a source of which all units fit is done
        left = step.where("__size > 0").select("__src", (F.col("__over") - F.col("__some") * F.col("__size")).alias("__room"))


def draw(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """__id (of the row), __doc (identity() of the row), doc_id, __src, size, __hash, __block, source_size, target, __times
    (how often the mix takes the document) for every row, written."""
    size = documents.select(
        F.monotonically_increasing_id().alias("__id"), identity().alias("__doc"), "doc_id", source_key(F.col("source")).alias("__src"), word_count(F.col("text")).alias("size"),
        F.md5(F.concat_ws(":", F.lit(s.seed), F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))).cast("binary")).alias("__hash"))
    size = written(size, "mix-sizes")
    goal = written(targets(size, s), "mix-targets")
    # whole passes, and the words of the part of a pass that remains
    room = goal.where("source_size > 0").select("__src", F.floor(F.col("target") / F.col("source_size")).alias("__passes"), "source_size", "target")
    room = room.select("__src", F.least(F.col("__passes"), F.lit(s.most)).cast("long").alias("__passes"), (F.col("target") - F.col("__passes") * F.col("source_size")).alias("__room"))
    blocks, after = _split(size, room.select("__src", "__room"), _digit(0, s), s)
    blocks = written(blocks.where("__in").select("__src", F.col("__unit").alias("__block")), "mix-blocks")
    after = written(after, "mix-room")
    edge = size.withColumn("__block", _digit(0, s)).join(after.select("__src", F.col("__next").alias("__block")), ["__src", "__block"], "left_semi")
    edge = written(edge, "mix-edge")
    sub, after2 = _split(edge, after.select("__src", "__room"), _digit(1, s), s)
    after2 = written(after2, "mix-room")
    last = edge.withColumn("__unit", _digit(1, s)).join(after2.select("__src", F.col("__next").alias("__unit")), ["__src", "__unit"], "left_semi")
    docs, after3 = _split(last, after2.select("__src", "__room"), F.col("__hash"), s)
    picked = edge.withColumn("__unit", _digit(1, s)).join(sub.where("__in"), ["__src", "__unit"]).select("__src", "__hash")
    picked = written(picked.union(docs.where("__in").select("__src", F.col("__unit").alias("__hash"))), "mix-picked")
    left = written(after3.select("__src", "__room").unionByName(after2.where("__next is null").select("__src", "__room")).unionByName(
        after.where("__next is null").select("__src", "__room")).groupBy("__src").agg(F.min("__room").alias("__room")), "mix-left")
    outside = size.where("size > 0").withColumn("__block", _digit(0, s)).join(blocks, ["__src", "__block"], "left_anti").select("__src", "__hash", "size")
    # rows that repeat an id and a text are taken together
    units = outside.join(picked, ["__src", "__hash"], "left_anti").groupBy("__src", "__hash").agg(F.sum("size").alias("size"))
    for filled in _fill(written(units, "mix-outside"), left, s):
        picked = picked.union(filled)
    rows = (
        size.withColumn("__block", _digit(0, s))
        .join(blocks.withColumn("__whole", F.lit(1)), ["__src", "__block"], "left")
        .join(picked.distinct().withColumn("__part", F.lit(1)), ["__src", "__hash"], "left")
    )
    rows = with_source(rows, goal.join(room.select("__src", "__passes"), "__src", "left"))
    rows = rows.select(
        "__id", "__doc", "doc_id", "__src", "size", "__hash", "__block", "source_size", "target",
        F.coalesce("__passes", F.lit(0)).alias("__passes"),
        F.least(F.coalesce("__passes", F.lit(0)) + F.coalesce("__whole", "__part", F.lit(0)), F.lit(s.most)).cast("int").alias("__times"))
    return written(rows, "mix-rows")


# ---- the splitting tree ---------------------------------------------------------------------------------------------


def log_factorial(n: Column) -> Column:
    """ln n! for a whole n >= 0, by Stirling's series at n + 8."""
    x = n + 9.0
    series = (x - 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x)
    product = n + 1.0
    for i in range(2, 9):
        product = product * (n + float(i))
    return series - F.ln(product)


def let(value: Column, use) -> Column:
    """use(value), value standing once in the plan however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hypergeometric(u: Column, good: Column, total: Column, drawn: Column) -> Column:
    """How many of `good` among `total` are in a draw of `drawn` without replacement: the distribution function inverted at u.

    Sums run over 12 standard deviations around the mean, beyond which no double differs from 0 or 1.
    """

    def bounds(v: Column) -> Column:
        mean = F.when(v["t"] > 0, v["d"] * v["g"] / v["t"]).otherwise(0.0)
        spread = 12 * F.sqrt(F.when(v["t"] > 1, F.greatest(v["d"] * v["g"] / v["t"] * (1 - v["g"] / v["t"]) * (v["t"] - v["d"]) / (v["t"] - 1), F.lit(0.0))).otherwise(0.0)) + 12
        least, most = F.greatest(F.lit(0.0), v["d"] + v["g"] - v["t"]), F.least(v["g"], v["d"])
        lo, hi = F.greatest(least, F.floor(mean - spread)), F.least(most, F.ceil(mean + spread))
        return let(F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi")), lambda r: walk(v, r))

    def walk(v: Column, r: Column) -> Column:
        g, t, d, x0 = v["g"], v["t"], v["d"], r["lo"]
        plus = F.array(t - g, g, d, t - d)
        minus = F.array(x0, g - x0, d - x0, t - g - d + x0, t)
        total = lambda xs: F.aggregate(F.transform(xs, log_factorial), F.lit(0.0), lambda a, x: a + x)
        start = F.struct(F.exp(total(plus) - total(minus)).alias("p"), F.lit(0.0).alias("sum"), x0.alias("x"))

        def step(a: Column, k: Column) -> Column:
            ratio = (g - a["x"]) * (d - a["x"]) / ((a["x"] + 1) * (t - g - d + a["x"] + 1))
            return F.when(a["sum"] + a["p"] >= u, a).otherwise(F.struct((a["p"] * ratio).alias("p"), (a["sum"] + a["p"]).alias("sum"), (a["x"] + 1).alias("x")))

        walked = F.aggregate(F.sequence(F.lit(1), F.greatest(r["hi"] - x0, F.lit(1.0)).cast("int")), start, step, lambda a: a["x"])
        return F.when(r["hi"] <= x0, x0).otherwise(F.least(walked, r["hi"])).cast("long")

    return let(F.struct(good.cast("double").alias("g"), total.cast("double").alias("t"), drawn.cast("double").alias("d")), bounds)


def uniform(*of: Column) -> Column:
    return (F.pmod(F.xxhash64(*of), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def split_tree(quotas: DataFrame, s: Settings) -> DataFrame:
    """__src, __shard, __from, __to: the range of its source's sequence of blocks that each shard holds.

    quotas: __src, __quota (blocks, passes counted). Level by level, each node's sources are one array, folded in source
    order: a source's share of the left child is hypergeometric given what the sources before it left over.
    """
    levels = max(0, s.shards.bit_length() - 1)
    node = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("__src", F.col("__quota").cast("long").alias("q"), F.lit(0).cast("long").alias("at")))).alias("qs"))
    node = node.select(F.lit(0).alias("__node"), F.col("qs"))
    for level in range(levels):
        depth = F.lit(1000 * s.seed + level)
        whole = F.aggregate("qs", F.lit(0).cast("long"), lambda a, x: a + x["q"])
        start = let(whole, lambda t: F.struct(t.alias("rest"), F.floor(t / 2).cast("long").alias("room"), F.array().cast("array<bigint>").alias("left")))

        def fold(a: Column, x: Column) -> Column:
            drawn = hypergeometric(uniform(depth, F.col("__node"), x["__src"]), x["q"], a["rest"], a["room"])
            return let(drawn, lambda n: F.struct((a["rest"] - x["q"]).alias("rest"), (a["room"] - n).alias("room"), F.array_append(a["left"], n).alias("left")))

        node = written(node.select("__node", "qs", F.aggregate("qs", start, fold, lambda a: a["left"]).alias("left")), "mix-tree")
        left = F.zip_with("qs", "left", lambda x, n: F.struct(x["__src"].alias("__src"), n.alias("q"), x["at"].alias("at")))
        right = F.zip_with("qs", "left", lambda x, n: F.struct(x["__src"].alias("__src"), (x["q"] - n).alias("q"), (x["at"] + n).alias("at")))
        children = F.array(F.struct((F.col("__node") * 2).alias("__node"), left.alias("qs")), F.struct((F.col("__node") * 2 + 1).alias("__node"), right.alias("qs")))
        node = node.select(F.explode(children).alias("c")).select("c.__node", "c.qs")
    return node.select("__node", F.explode("qs").alias("x")).where("x.q > 0").select(F.col("x.__src").alias("__src"), F.col("__node").alias("__shard"), F.col("x.at").alias("__from"), (F.col("x.at") + F.col("x.q")).alias("__to"))


def mix(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row for each time the mix takes a document of draw(): its columns and __pass, __shard, __order (in the shard)."""
    taken = rows.where("__times > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)).alias("__pass"))
    # a pass's blocks that hold something, in permuted order, pass after pass: the sequence that the shards' ranges cut
    order = Window.partitionBy("__src").orderBy("__pass", F.xxhash64(F.lit(s.seed), "__pass", "__block"), "__block")
    units = taken.select("__src", "__pass", "__block").distinct()
    units = written(units.withColumn("__place", F.row_number().over(order).cast("long") - 1), "mix-units")
    tree = split_tree(units.groupBy("__src").agg(F.count(F.lit(1)).alias("__quota")), s)
    ranges = F.collect_list(F.struct("__shard", "__from", "__to"))
    tree = tree.groupBy("__src").agg(ranges.alias("__ranges"))  # at most one for each shard
    inside = F.filter("__ranges", lambda r: (F.col("__place") >= r["__from"]) & (F.col("__place") < r["__to"]))
    placed = units.join(tree, "__src").select("__src", "__pass", "__block", F.element_at(inside, 1)["__shard"].alias("__shard"))
    out = taken.join(placed, ["__src", "__pass", "__block"])
    return out.withColumn("__order", F.xxhash64(F.lit(s.seed), "__shard", "__pass", "__hash"))


def mixing_query(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of documents."""
    rows = draw(documents.select("doc_id", "text", "source"), s)
    got = mix(rows, s).groupBy("__id").agg(F.sum("size").alias("taken"))
    return rows.join(got, "__id", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents that the mix takes, whole and as often as it takes them, dealt to the output shards.

    Same columns as documents. A shard's rows are together and in hashed order; a shard that is too large for one task is
    dealt to several by ranges of that order.
    """
    doc, shard, order = (free_name(documents, x) for x in ("__doc", "__shard", "__order"))
    copies = mix(draw(documents.select("doc_id", "text", "source"), s), s).select(F.col("__doc").alias(doc), F.col("__shard").alias(shard), F.col("__order").alias(order), "__pass")
    # rows that repeat an id and a text come once for each of their draws
    copies = copies.dropDuplicates([doc, "__pass"]).drop("__pass")
    out = documents.withColumn(doc, identity()).join(copies, doc)
    return out.repartitionByRange(shard, order).sortWithinPartitions(shard, order).select(*(F.col(f"`{c}`") for c in documents.columns))


MIXING_SQL = r"""
WITH RECURSIVE sizes AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS src,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(concat_ws(':', '5', doc_id::VARCHAR, md5(text))) AS hash FROM documents),
ranked AS (SELECT src, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::DOUBLE AS cap,
    ((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::DOUBLE AS w FROM sizes GROUP BY src),
summed AS (SELECT *, sum(source_size::DOUBLE) OVER () AS whole,
    coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM ranked),
goal AS (SELECT src, source_size, least(cap, coalesce(max(CASE WHEN (whole - filled) / rest * w <= cap THEN (whole - filled) / rest END) OVER () * w, cap))
    AS target FROM summed),
room0 AS (SELECT src, target - floor(target / source_size) * source_size AS room FROM goal WHERE source_size > 0),
ran AS (SELECT s.*, sum(size) OVER (PARTITION BY s.src ORDER BY hash) <= room AS picked, room FROM sizes s JOIN room0 USING (src)),
units AS MATERIALIZED (SELECT src, hash, sum(size)::BIGINT AS size, row_number() OVER (PARTITION BY src ORDER BY sum(size) DESC, hash DESC) AS place
    FROM ran WHERE NOT picked AND size > 0 GROUP BY src, hash),
fill AS (SELECT src, max(room) - coalesce(sum(size) FILTER (WHERE picked), 0) AS room, 0::BIGINT AS place, NULL::VARCHAR AS hash FROM ran GROUP BY src
    UNION ALL SELECT src, room - size, place, hash FROM (SELECT f.src, f.room, u.size, u.place, u.hash, row_number() OVER (PARTITION BY f.src ORDER BY u.place) AS nth
        FROM fill f JOIN units u ON u.src = f.src AND u.place > f.place AND u.size <= f.room) WHERE nth = 1),
kept AS (SELECT src, hash FROM ran WHERE picked UNION SELECT src, hash FROM fill WHERE hash IS NOT NULL)
SELECT s.doc_id, s.size, g.source_size, g.target,
    (CASE WHEN g.source_size > 0 THEN s.size * least(floor(g.target / g.source_size) + (k.hash IS NOT NULL)::INT, 3) ELSE 0 END)::BIGINT AS taken
FROM sizes s JOIN goal g USING (src) LEFT JOIN kept k ON k.src = s.src AND k.hash = s.hash
"""

"""References cut to chunks, intervals fetched from them, and joins of intervals by bins.

A chunked reference has rows (name, chunk, piece): `piece` holds the letters from chunk * size on, at most `size` of them. No row
that is shuffled or joined carries more than one chunk; an interval is put together from the chunks that it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequences as sq
from strandlake.plans.tables import written

#: Letters of a chunk.
CHUNK = 1 << 16


def sizes(reference: DataFrame) -> DataFrame:
    """name, size (and table_id where there is one) of a reference (name, seq): no sequence goes further."""
    return reference.select("name", F.length("seq").cast("long").alias("size"), *(["table_id"] if "table_id" in reference.columns else []))


def chunked(reference: DataFrame, size: int = CHUNK) -> DataFrame:
    """name, chunk, piece for a reference (name, seq). Sequences of one byte a letter are cut as bytes, without counting letters."""
    r = reference.select("name", "seq", F.length("seq").alias("n"), F.octet_length("seq").alias("bytes"))
    r = r.select("name", "seq", "n", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("n", F.lit(1)) - 1) / size))).alias("chunk"))
    at = (F.col("chunk") * size + 1).cast("int")
    piece = F.when(F.col("n") == F.col("bytes"), F.substring(F.col("seq").cast("binary"), at, F.lit(size)).cast("string")).otherwise(F.substring("seq", at, F.lit(size)))
    return r.select("name", "chunk", piece.alias("piece"))


def _touched(low: Column, length: Column, size: int) -> Column:
    """The numbers of the chunks or bins that an interval touches; one of them for an empty interval."""
    first = F.floor(low / size)
    return F.sequence(first, F.greatest(first, F.floor((low + length - 1) / size)))


def fetch(intervals: DataFrame, reference: DataFrame, strict: bool = True, size: int = CHUNK) -> DataFrame:
    """intervals (seq: a name, low, length, strand or none, further columns) with `slice`, the letters of the interval. Where
    strand is '-', the interval is one of the sequence's reverse complement, places counted along that.

    An interval on a name that the reference lacks, or that leaves its sequence, is an error; if not strict, it is left out.
    Letters come from the chunks that an interval touches: the rows of a chunk that many intervals share can be dealt to several
    tasks, and each carries one chunk. A null seq is a name that the reference lacks; names of the reference are there once.
    """
    x = intervals.join(sizes(reference).select(F.col("name").alias("seq"), F.col("size").alias("__size")), "seq", "left")
    outside = F.col("__size").isNull() | F.col("low").isNull() | F.col("length").isNull() | (F.col("low") < 0) | (F.col("length") < 0) | (F.col("low") + F.col("length") > F.col("__size"))
    if strict:
        at = F.concat_ws(":", F.coalesce("seq", F.lit("null")), F.col("low").cast("string"), F.col("length").cast("string"))
        fault = F.when(F.col("__size").isNull(), F.concat(F.lit("no sequence "), F.coalesce("seq", F.lit("null")))).when(outside, F.concat(F.lit("interval out of bounds: "), at))
        x = x.withColumn("low", F.when(fault.isNotNull(), F.raise_error(fault).cast("long")).otherwise(F.col("low")))
    else:
        x = x.where(~outside)
    # numbers of rows are kept with the rows: they must be the same where pieces come together
    x = written(x.withColumn("__id", F.monotonically_increasing_id()), "intervals")
    low, length = F.col("low").cast("long"), F.col("length").cast("long")
    if "strand" in intervals.columns:
        low = F.when(F.col("strand") == "-", F.col("__size") - low - length).otherwise(low)
    parts = x.select("__id", F.col("seq").alias("name"), low.alias("low"), length.alias("length")).where("length > 0")
    parts = parts.withColumn("chunk", F.explode(_touched(F.col("low"), F.col("length"), size))).join(chunked(reference, size), ["name", "chunk"])
    start = F.greatest(F.col("low") - F.col("chunk") * size, F.lit(0))
    end = F.least(F.col("low") + F.col("length") - F.col("chunk") * size, F.lit(size))
    parts = parts.select("__id", "chunk", F.substring("piece", (start + 1).cast("int"), (end - start).cast("int")).alias("p"))
    whole = parts.groupBy("__id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "p"))), lambda c: c["p"]), "").alias("slice"))
    out = x.join(whole, "__id", "left").drop("__id", "__size")
    letters = F.coalesce("slice", F.lit(""))
    letters = F.when(F.col("strand") == "-", sq.rc(letters)).otherwise(letters) if "strand" in intervals.columns else letters
    return out.select(*(F.col(f"`{c}`") for c in intervals.columns), letters.alias("slice"))


def _binned(x: DataFrame, side: str, bin_size: int) -> DataFrame:
    low, length = F.col("low").cast("long"), F.col("length").cast("long")
    return x.select("seq", F.struct(*x.columns).alias(side), low.alias(f"{side}_low"), (low + length).alias(f"{side}_end"), F.explode(_touched(low, length, bin_size)).alias("bin")).where(F.col(f"{side}_low") < F.col(f"{side}_end"))


def interval_join(a: DataFrame, b: DataFrame, how: str = "overlaps", bin_size: int = 1 << 12) -> DataFrame:
    """a, b (structs of the rows of both sides: seq, low, length, ...): every pair on one seq that overlaps, or, with how =
    "contains", where b lies in a.

    Both sides are dealt to the bins that they touch and meet there; a pair is taken in the first bin that both touch, so each
    comes once. Bins should be about as wide as intervals are long. Empty intervals and null names meet nothing.
    """
    if how not in ("overlaps", "contains"):
        raise ValueError(f"neither overlaps nor contains: {how}")
    pair = _binned(a, "a", bin_size).join(_binned(b, "b", bin_size), ["seq", "bin"])
    meet = (F.col("a_low") < F.col("b_end")) & (F.col("b_low") < F.col("a_end")) if how == "overlaps" else (F.col("a_low") <= F.col("b_low")) & (F.col("b_end") <= F.col("a_end"))
    return pair.where(meet & (F.col("bin") == F.floor(F.greatest("a_low", "b_low") / bin_size))).select("a", "b")


def coverage(intervals: DataFrame) -> DataFrame:
    """seq, low, length, depth: the stretches of each name that a number of intervals covers, in gaps and islands of their ends.

    Ends are summed first, so a place where many intervals end is one row."""
    low, length = F.col("low").cast("long"), F.col("length").cast("long")
    ends = intervals.where("length > 0").select("seq", F.explode(F.array(F.struct(low.alias("at"), F.lit(1).alias("d")), F.struct((low + length).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    ends = ends.groupBy("seq", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    return _running_depth(ends)


def _running_depth(ends: DataFrame, bin_size: int = 1 << 20) -> DataFrame:
    """Depths from the changes (seq, at, d): sums over earlier bins of places, then inside a bin."""
    from pyspark.sql import Window

    x = ends.withColumn("bin", F.floor(F.col("at") / bin_size))
    sums = x.groupBy("seq", "bin").agg(F.sum("d").alias("s"), F.min("at").alias("first"))
    by = Window.partitionBy("seq").orderBy("bin")
    sums = sums.select("seq", "bin", F.coalesce(F.sum("s").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("first").over(by).alias("next"))
    inside = Window.partitionBy("seq", "bin").orderBy("at")
    x = x.withColumns({"d": F.sum("d").over(inside), "end": F.lead("at").over(inside)}).join(sums, ["seq", "bin"])
    x = x.select("seq", F.col("at").alias("low"), (F.coalesce("end", "next") - F.col("at")).alias("length"), (F.col("d") + F.col("before")).alias("depth"))
    return x.where("depth > 0")

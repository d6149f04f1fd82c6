"""Tandem repeats and consensus of alignments."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import sequences as sq
from strandlake.plans.tables import written
from strandlake.sources.formats import c_general, general_column


#: Periods below this are tried one after another; longer ones are met at anchors.
SHORT = 64


def _letters(s: str) -> np.ndarray:
    return np.frombuffer(s.encode(), np.uint8) if s.isascii() else np.frombuffer(s.encode("utf-32-le"), np.uint32)


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """How many letters two stretches have in common from their start."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:
        other = x[at : min(at + step, n)] != y[at : min(at + step, n)]
        if other.any():
            return at + int(other.argmax())
        at, step = at + step, min(2 * step, 1 << 20)
    return n


def _gram_hashes(a: np.ndarray, h: int, powers: np.ndarray, inverse: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """A hash for each a[i : i + h]; what agrees by hash is compared letter by letter later."""
    return (sums[h:] - sums[:-h]) * inverse[: len(a) - h + 1]


def periodic_stretches(a: np.ndarray, longest: int, least: int = 0) -> list[tuple[int, int, int]]:
    """(lo, hi, period) of all stretches a[lo : hi + 1] that no longer stretch of their period holds, at least two periods
    long, periods of up to `longest`; of the periods of one stretch the smallest. Those shorter than `least` may be missing unless
    they are at an end.

    Short periods: runs of letters equal to those a period on. Longer ones, by doubling classes of periods m to 2m - 1: such a
    stretch has a multiple of m / 2 whose gram of m / 2 letters stands again a period on; what is found so is extended by
    comparing letters. Where a found stretch repeats a smaller period, its multiples are not tried again.
    """
    n, best = len(a), {}
    for p in range(1, min(longest, SHORT - 1, n // 2) + 1):
        same = np.flatnonzero(np.diff(np.concatenate(([0], (a[:-p] == a[p:]).view(np.int8), [0]))))
        lows, ends = same[::2], same[1::2]
        long = (ends - lows >= p) & ((ends - lows + p >= least) | (lows == 0) | (ends + p == n))
        for lo, end in zip(lows[long].tolist(), ends[long].tolist(), strict=True):
            best.setdefault((lo, end + p - 1), p)
    if min(longest, n // 2) < SHORT:
        return [(lo, hi, p) for (lo, hi), p in best.items()]
    powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, 0x9E3779B97F4A7C15, np.uint64)))
    inverse = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)))
    sums = np.append(np.uint64(0), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * powers[:-1]))
    m = SHORT
    while m <= min(longest, n // 2):
        h = m // 2
        grams = _gram_hashes(a, h, powers, inverse, sums)
        # for each anchor, the stretch of a smaller period that reaches furthest beyond it
        known = sorted((lo, hi, p) for (lo, hi), p in best.items() if hi - lo + 1 >= m)
        reach, at, done = (-1, 1), 0, {}
        for i in range(0, n - m - h + 1, h):
            while at < len(known) and known[at][0] <= i:
                reach, at = max(reach, known[at][1:]), at + 1
            far = grams[i + m : min(i + 2 * m, n - h + 1)]
            for p in (np.flatnonzero(far == grams[i]) + m).tolist():
                if p > min(longest, n // 2) or done.get(p, -1) >= i + p or (p % reach[1] == 0 and i + p + h - 1 <= reach[0]):
                    continue
                right = _agree(a[i:], a[i + p :])
                if right < h:
                    continue
                left = _agree(a[: i + p][::-1], a[:i][::-1])
                lo, hi = i - left, i + p + right - 1
                done[p] = hi
                if hi - lo + 1 >= 2 * p:
                    best.setdefault((lo, hi), p)
        m *= 2
    return [(lo, hi, p) for (lo, hi), p in best.items()]


def _not_held(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of (lo, hi, period) that no earlier one reaches beyond."""
    out, reach = [], -1
    for x in sorted(found):
        if x[1] > reach:
            out.append(x)
            reach = x[1]
    return out


def tandem_repeats(s: str, longest: int | None = None, least: int = 0) -> list[tuple[int, int, str]]:
    """(lo, hi, unit), 0-based and inclusive, of the repeats that no earlier one reaches beyond."""
    found = periodic_stretches(_letters(s), longest or len(s), least)
    return [(lo, hi, s[lo : lo + p]) for lo, hi, p in _not_held([x for x in found if x[1] - x[0] + 1 >= least])]


def _windows(n: Column, longest: int | None, window: int) -> Column:
    """start, end, shared (letters of the end that the next window has too), smallest, largest period: which parts of a sequence
    of n letters are looked at for which periods.

    Windows share twice the largest period, so that what starts in a window's own part shows two periods there, and what
    reaches its end is a repeat of the next window too. Periods of up to an eighth of `window` are looked for in windows of about that
    size, longer ones, by doubling, in larger windows.
    """
    kind = "array<struct<start:int,end:int,shared:int,smallest:int,largest:int>>"

    def cut(low: int, high: int) -> Column:
        largest = F.least(F.floor(n / 2), F.lit(min(high, longest or high))).cast("int")
        shared = 2 * largest
        own = F.greatest(F.lit(window), 4 * shared)
        last = F.greatest(F.lit(0), F.ceil((n - shared) / own) - 1).cast("int")
        end = lambda i: F.when(i == last, n).otherwise((i + 1) * own + shared).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * own).cast("int").alias("start"), end(i).alias("end"), F.when(i == last, 0).otherwise(shared).alias("shared"), F.lit(low).alias("smallest"), largest.alias("largest")))
        return F.when(largest >= low, parts.cast(kind)).otherwise(F.array().cast(kind))

    out, low, high = [], 1, max(1, window // 8)
    while low <= min(longest or 1 << 30, 1 << 30):
        out.append(cut(low, high))
        low, high = high + 1, 2 * high
    return F.concat(*out)


_REPEAT = "tag string, lo long, hi long, length long, unit_length long, periods string, unit string"


def find_repeats(df: DataFrame, longest: int | None = None, least: int = 0, window: int = 1 << 18) -> DataFrame:
    """tag, lo, hi (1-based, inclusive), length, unit_length, periods, unit for sequences (tag, seq).

    A sequence of up to `window` letters is one row's work. Of a longer one windows are dealt to tasks: each gives the repeats that
    start in its own part, and, of those that reach its end, what it shows. What windows show of one repeat is joined
    where it overlaps by a period; the repeats that earlier ones reach beyond are then found by bins of their starts. The
    result does not depend on `window`. A null sequence has no repeats; sequences that share a tag are told apart.
    """

    def whole(batches):
        for pdf in batches:
            rows = [
                (tag, lo + 1, hi + 1, hi - lo + 1, len(u), c_general((hi - lo + 1) / len(u), 6), u)
                for tag, seq in zip(pdf["tag"], pdf["seq"], strict=True) for lo, hi, u in tandem_repeats(seq or "", longest, least)
            ]
            yield pd.DataFrame(rows, columns=["tag", "lo", "hi", "length", "unit_length", "periods", "unit"])

    def part(batches):
        for pdf in batches:
            rows = []
            for x in pdf.itertuples(index=False):
                context = int(x.start > 0)  # the letter before the window
                own = x.end - x.start - x.shared
                for lo, hi, p in periodic_stretches(_letters(x.piece), int(x.largest), least):
                    lo, hi = lo - context, hi - context
                    opened, closed = lo >= 0, hi < x.end - x.start - 1 or not x.shared
                    if p >= x.smallest and lo < own and not (opened and closed and hi - lo + 1 < least):
                        rows.append((x.id, x.tag, x.start + lo, x.start + hi, p, opened, closed, x.piece[lo + context : lo + context + p] if opened else None))
            yield pd.DataFrame(rows, columns=["id", "tag", "lo", "hi", "period", "opened", "closed", "unit"])

    rows = df.select("tag", "seq", F.length("seq").alias("n"))
    # the work on a sequence outweighs its shuffle by far, and files may be few
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = rows.where(F.coalesce("n", F.lit(0)) <= window).select("tag", "seq").repartition(tasks).mapInPandas(whole, _REPEAT)
    long = rows.where(F.col("n") > window).withColumn("id", F.monotonically_increasing_id())
    long = long.select("id", "tag", "seq", F.explode(_windows(F.col("n"), longest, window)).alias("w"))
    before = F.when(F.col("w.start") > 0, 1).otherwise(0)
    long = long.select("id", "tag", "w.*", F.substring("seq", F.col("w.start") + 1 - before, F.col("w.end") - F.col("w.start") + before).alias("piece"))
    seen = long.repartition("id", "start", "smallest").mapInPandas(part, "id long, tag string, lo long, hi long, period int, opened boolean, closed boolean, unit string")
    seen = written(seen, "repeats")
    # what reaches over windows' ends: of each period a few a window; a piece without a start is of a repeat that was seen whole before
    by = Window.partitionBy("id", "period").orderBy("lo", "hi")
    loose = seen.where("not opened or not closed").withColumn("__first", F.coalesce(F.col("opened") | (F.col("lo") > F.lag("hi").over(by) - F.col("period") + 1), F.lit(True)))
    loose = loose.withColumn("__k", F.sum(F.col("__first").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = loose.groupBy("id", "tag", "period", "__k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("unit").alias("unit")).where("unit is not null")
    found = seen.where("opened and closed").select("id", "tag", "period", "lo", "hi", "unit").unionByName(joined.drop("__k")).where(F.col("hi") - F.col("lo") + 1 >= least)
    # the furthest end before each repeat: over earlier bins, then inside its own
    found = found.withColumn("bin", F.floor(F.col("lo") / window))
    reach = found.groupBy("id", "bin").agg(F.max("hi").alias("reach"))
    reach = reach.select("id", "bin", F.max("reach").over(Window.partitionBy("id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inside = F.max("hi").over(Window.partitionBy("id", "bin").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("inside", inside).join(reach, ["id", "bin"]).where(F.col("hi") > F.greatest(F.coalesce("inside", F.lit(-1)), F.coalesce("before", F.lit(-1))))
    length = F.col("hi") - F.col("lo") + 1
    return short.unionByName(found.select(
        "tag", (F.col("lo") + 1).alias("lo"), (F.col("hi") + 1).alias("hi"), length.alias("length"), F.col("period").cast("long").alias("unit_length"), general_column(length / F.col("period"), 6).alias("periods"), "unit"))


# ---- consensus ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ConsensusSettings:
    tip_gap_multiplier: float = 2.5
    max_tip_threshold: float = 30
    min_branch_threshold: float = 40
    window: int = 7
    min_coverage: int = 5

    def __post_init__(self):
        if self.tip_gap_multiplier < 0 or self.window < 1 or self.min_coverage < 0 or not 0 <= self.max_tip_threshold <= 100 or not 0 <= self.min_branch_threshold <= 100:
            raise ValueError(f"settings out of range: {self}")


def _cut_head(runs: list[str], total: int, s: ConsensusSettings) -> list[str]:
    letters, limit = 0, int(total * s.max_tip_threshold / 100)
    for i, r in enumerate(runs):
        if r[0] == "-":
            continue
        letters += len(r)
        if letters > limit or i + 1 >= len(runs):
            return runs
        if len(runs[i + 1]) >= s.tip_gap_multiplier * letters:
            return ["-" * len(x) for x in runs[: i + 1]] + runs[i + 1 :]
    return runs


def remove_tips(row: str, s: ConsensusSettings = ConsensusSettings()) -> str:
    """Short blocks of letters at either end that long gaps set apart become gaps; the length stays."""
    total = len(row) - row.count("-")
    text = row
    for _ in range(2):
        text = "".join(_cut_head(re.findall(r"-+|[^-]+", text), total, s))[::-1]
    return text


def side_dashes(row: str, filler: str = " ") -> tuple[str, int, int]:
    """The row with its outer dashes replaced, and the places of its first and last letter (-1 if none)."""
    inner = row.strip("-")
    if not inner:
        return filler * len(row), -1, -1
    first = len(row) - len(row.lstrip("-"))
    return filler * first + inner + filler * (len(row) - first - len(inner)), first, first + len(inner) - 1


def consensus(alignments: DataFrame, s: ConsensusSettings = ConsensusSettings()) -> DataFrame:
    """group, consensus for alignments (group, row, seq) of equal-length rows; rows of other lengths, or a window longer than
    the rows, are an error. A column's most frequent character is found with the spaces beyond the rows' ends counted.

    Characters and windows are exploded and counted by place, so an alignment of any depth is summed in partial counts;
    only the winners, one for each place and one for each window, come together.
    """

    @F.pandas_udf("string")
    def clean(x: pd.Series) -> pd.Series:
        return x.map(lambda r: side_dashes(remove_tips(r, s))[0])

    rows = alignments.select("group", clean(sq.dnaize(F.col("seq"), keep_dashes=True)).alias("s"))
    letters = rows.select("group", F.posexplode(F.split("s", "")).alias("i", "c")).where("c <> ''").groupBy("group", "i", "c").agg(F.count(F.lit(1)).alias("n"))
    # of characters as frequent as each other the first counts
    cover = letters.groupBy("group", "i").agg(F.coalesce(F.sum(F.when(F.col("c") != " ", F.col("n"))), F.lit(0)).alias("cover"), F.max(F.struct("n", F.translate("c", " -ACGNT", "7654321").alias("o"), "c")).alias("m"))
    places = cover.select("group", "i", "cover", F.col("m.c").alias("mode"), F.col("m.n").alias("mode_n"))
    words = rows.select("group", F.posexplode(sq.windows(F.col("s"), s.window)).alias("at", "w")).where(~F.col("w").contains(" "))
    words = words.groupBy("group", "at", "w").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("group", "at").orderBy(F.desc("n"), "w"))
    best = words.withColumn("__r", first).where("__r = 1").select("group", "at", "w", "n")
    votes = best.select("group", "at", "n", F.posexplode(F.split("w", "")).alias("d", "c")).where("c <> ''").select("group", (F.col("at") + F.col("d")).alias("i"), "at", "n", "c")
    gaps = places.where((F.col("mode") == "-") & (100 * F.col("mode_n") >= s.min_branch_threshold * F.col("cover"))).select("group", "i", F.lit(-1).alias("at"), F.col("mode_n").alias("n"), F.lit("-").alias("c"))
    votes = votes.join(places.select("group", "i", "cover"), ["group", "i"]).where(100 * F.col("n") >= s.min_branch_threshold * F.col("cover")).drop("cover")
    win = votes.unionByName(gaps).groupBy("group", "i").agg(F.max(F.struct("n", (-F.col("at")).alias("o"), "c")).alias("v"))
    shown = places.join(win, ["group", "i"], "left").select("group", "i", F.coalesce(F.when(F.col("v.n") >= s.min_coverage, F.upper("v.c")).otherwise(F.lower("v.c")), F.lit("n")).alias("c"))
    widths = rows.groupBy("group").agg(F.max(F.length("s")).alias("width"), F.min(F.length("s")).alias("least"))
    fault = F.when(F.col("least") != F.col("width"), "rows of different lengths").when(F.col("width") < s.window, "a window longer than the rows")
    widths = widths.withColumn("width", F.when(fault.isNotNull(), F.raise_error(fault).cast("int")).otherwise(F.col("width")))
    letters_of = shown.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("m"))
    return widths.join(letters_of, "group", "left").select("group", F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("n"))), "").alias("consensus"))

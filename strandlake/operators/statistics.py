"""Descriptive statistics and frequency multisets of a numeric column; all in plan expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.plans.tables import written


def online(df: DataFrame, x: str, *by: str) -> DataFrame:
    """count, mean, variance, sd, cv and their sample forms; 0 where too few values are there."""
    c = F.col(x).cast("double")
    zero = lambda e: F.coalesce(e, F.lit(0.0))
    s = df.groupBy(*by).agg(F.count(c).alias("n"), zero(F.avg(c)).alias("mean"), zero(F.var_pop(c)).alias("variance"), zero(F.when(F.count(c) > 1, F.var_samp(c))).alias("sample_variance"))
    sd, ssd = F.sqrt("variance"), F.sqrt("sample_variance")
    none = (F.col("n") < 1) | (F.col("mean") == 0)
    return s.select(
        *by, "n", "mean", "variance", sd.alias("sd"), F.when(none, 0.0).otherwise(sd / F.when(none, 1.0).otherwise(F.col("mean"))).alias("cv"),
        "sample_variance", ssd.alias("sample_sd"),
        F.when(none | (F.col("n") < 2), 0.0).otherwise((1 + 1 / (4 * F.greatest("n", F.lit(1)))) * ssd / F.when(none, 1.0).otherwise(F.col("mean"))).alias("sample_cv"))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept of the least-squares line; an error if all x are equal."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    s = df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"))
    return s.select(F.when(F.col("slope").isNull(), F.raise_error(F.lit("singular fit")).cast("double")).otherwise(F.col("slope")).alias("slope"), "intercept")


def predict(df: DataFrame, model: DataFrame, x: str, y: str) -> DataFrame:
    """df with prediction and residual; the model is one row, so it is broadcast."""
    out = df.crossJoin(F.broadcast(model.limit(1)))
    p = F.col("intercept") + F.col("slope") * F.col(x).cast("double")
    return out.select(*df.columns, p.alias("prediction"), (F.col(y).cast("double") - p).alias("residual"))


def frequencies(df: DataFrame, x: str) -> DataFrame:
    """value, freq: all operators below work on this multiset, so each distinct value costs one row."""
    return df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("value")).agg(F.count(F.lit(1)).alias("freq"))


def summary(freq: DataFrame) -> DataFrame:
    """first, last, total, mean, sum_abs, mean_abs, sum_log_abs (-inf with a zero), and variances as they are meant."""
    v, n = F.col("value").cast("double"), F.col("freq")
    logs = F.when(v == 0, F.lit(float("-inf"))).otherwise(F.ln(F.abs(F.when(v == 0, 1.0).otherwise(v))))
    count = F.sum(n)
    mean = F.sum(v * n) / count
    return freq.agg(
        F.min("value").alias("first"), F.max("value").alias("last"), F.coalesce(count, F.lit(0)).alias("n"), F.coalesce(F.sum(v * n), F.lit(0.0)).alias("total"), F.coalesce(mean, F.lit(0.0)).alias("mean"),
        F.coalesce(F.sum(F.abs(v) * n), F.lit(0.0)).alias("sum_abs"), F.coalesce(F.sum(F.abs(v) * n) / count, F.lit(0.0)).alias("mean_abs"), F.coalesce(F.sum(logs * n), F.lit(0.0)).alias("sum_log_abs"),
        F.coalesce(F.sum(v * v * n) / count - mean * mean, F.lit(0.0)).alias("variance"))


def spreads(freq: DataFrame) -> DataFrame:
    """variance, sd and their sample forms of the values and of their absolutes, and mean_log_abs; 0 where too few values are
    there. Sums of squares are taken around the mean, in a second pass."""
    v, n = F.col("value").cast("double"), F.col("freq")
    means = F.broadcast(freq.agg(F.coalesce(F.sum(n), F.lit(0)).alias("__n"), (F.sum(v * n) / F.sum(n)).alias("__m"), (F.sum(F.abs(v) * n) / F.sum(n)).alias("__a"), (F.sum(F.when(v != 0, F.ln(F.abs(v))).otherwise(F.lit(float("-inf"))) * n) / F.sum(n)).alias("__l")))
    x = freq.crossJoin(means)
    around = lambda c, m: F.sum(F.pow(c - F.col(m), F.lit(2.0)) * n)
    s = x.agg(F.coalesce(F.first("__n"), F.lit(0)).alias("n"), F.first("__l").alias("l"), around(v, "__m").alias("s"), around(F.abs(v), "__a").alias("t"))
    over = lambda c, less: F.when(F.col("n") > less, F.col(c) / (F.when(F.col("n") > less, F.col("n")).otherwise(less + 1) - less)).otherwise(0.0)
    parts = {"variance": over("s", 0), "sample_variance": over("s", 1), "variance_abs": over("t", 0), "sample_variance_abs": over("t", 1)}
    sds = {k.replace("variance", "sd"): F.sqrt(c) for k, c in parts.items()}
    return s.select(*(c.alias(k) for k, c in (parts | sds).items()), F.coalesce("l", F.lit(0.0)).alias("mean_log_abs"))


def frequency(freq: DataFrame, values: DataFrame) -> DataFrame:
    """value, freq for the values asked for: 0 for those that are not there."""
    return values.select("value").distinct().join(freq, "value", "left").select("value", F.coalesce("freq", F.lit(0)).cast("long").alias("freq"))


def expand(freq: DataFrame, part: int = 1 << 16) -> DataFrame:
    """value: each as often as its frequency says; a frequent one is first cut into parts, which are spread."""
    cut = freq.select("value", "freq", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("freq") - 1) / part))).alias("__k")).where("freq > 0")
    n = F.least(F.col("freq") - F.col("__k") * part, F.lit(part)).cast("int")
    return cut.repartition("value", "__k").select(F.explode(F.array_repeat("value", n)).alias("value"))


def to_array(freq: DataFrame) -> DataFrame:
    """values: one array of all values in order, for multisets that fit one."""
    return freq.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("value", "freq"))), lambda x: F.array_repeat(x["value"], x["freq"].cast("int")))).alias("values"))


def most_frequent(freq: DataFrame) -> DataFrame:
    """value, freq of the most frequent value; the smallest of several."""
    return freq.agg(F.min_by(F.struct("value", "freq"), F.struct((-F.col("freq")).alias("f"), "value")).alias("m")).select("m.value", "m.freq")


def ranged(rows: DataFrame, order: Column, weight: Column, *by: str) -> DataFrame:
    """rows with __before, the weight of the rows before each in `order` among those that share `by`, and __all, that of all.

    Rows are dealt to ranges of (by, order). Ranges are sampled anew whenever they are dealt, so they are written once, with
    their numbers; sums by range and places inside a range are read from that table. A group of any size is many ranges.
    """
    spread = written(rows.withColumn("__w", weight).repartitionByRange(*by, order).withColumn("__p", F.spark_partition_id()), "ranges")
    key = F.struct(*by, "__p")  # fields of structs are equal if both are null
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    group = Window.partitionBy(*by)
    sums = spread.groupBy(*by, "__p").agg(F.sum("__w").alias("__s"))
    sums = sums.select(key.alias("__g"), earlier("__s", group.orderBy("__p")).alias("__earlier"), F.sum("__s").over(group).alias("__all"))
    # without groups there is a row for each range, which is what a driver plans anyway
    run = spread.withColumn("__g", key).withColumn("__inside", earlier("__w", Window.partitionBy(*by, "__p").orderBy(order)))
    return run.join(sums if by else F.broadcast(sums), "__g").withColumn("__before", F.col("__earlier") + F.col("__inside")).drop("__g", "__p", "__w", "__inside", "__earlier")


def median(df: DataFrame, x: str, *by: str, whole: bool = False) -> DataFrame:
    """The middle value or the mean of both middles (a whole division for whole numbers); 0 of none.

    From running counts over the frequencies, which are dealt by ranges: no task holds all values, or all of a group."""
    v = F.col(x).cast("double").alias("value")
    # groups without a value have 0 too
    run = ranged(df.groupBy(*by, v).agg(F.count(x).alias("freq")), F.asc("value"), F.col("freq"), *by)
    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    at = lambda k: F.max(F.when((F.col("__before") <= k) & (k < F.col("__before") + F.col("freq")), F.col("value")))
    m = F.coalesce((at(low) + at(high)) / 2, F.lit(0.0))
    return run.groupBy(*by).agg((F.floor(m) if whole else m).alias("median"))


def mad(df: DataFrame, x: str) -> DataFrame:
    """The multiset of distances from the median."""
    m = F.broadcast(median(df, x))
    return frequencies(df.crossJoin(m).select(F.abs(F.col(x).cast("double") - F.col("median")).alias("d")), "d")


def _regroup(freq: DataFrame) -> DataFrame:
    return freq.groupBy("value").agg(F.sum("freq").alias("freq"))


def pow_abs(freq: DataFrame, p: float) -> DataFrame:
    return freq if p == 1 else _regroup(freq.select(F.pow(F.abs(F.col("value").cast("double")), F.lit(float(p))).alias("value"), "freq"))


def normalize_abs(freq: DataFrame) -> DataFrame:
    """Values over the sum of their absolutes; unchanged if that is 0."""
    total = F.broadcast(freq.agg(F.sum(F.abs(F.col("value").cast("double")) * F.col("freq")).alias("t")))
    v = F.col("value").cast("double")
    return _regroup(freq.crossJoin(total).select(F.when(F.col("t") == 0, v).otherwise(v / F.when(F.col("t") == 0, 1.0).otherwise(F.col("t"))).alias("value"), "freq"))


def threshold(freq: DataFrame, t: float, descending: bool = False) -> DataFrame:
    """In order, elements stay while the absolutes before them sum to less than t times the whole; the rest become 0.

    Equal elements are one row, so how many of them stay is computed, not enumerated.
    """
    if not 0 <= t <= 1:
        raise ValueError(f"a threshold outside 0 to 1: {t}")
    if t == 1:
        return freq
    v = F.col("value").cast("double")
    order = F.desc("value") if descending else F.asc("value")
    run = ranged(freq.withColumn("__a", F.abs(v)), order, F.abs(v) * F.col("freq")).withColumnRenamed("__before", "__sum")
    room = F.lit(float(t)) * F.col("__all") - F.col("__sum")
    stay = F.when(room <= 0, F.lit(0)).when(F.col("__a") == 0, F.col("freq")).otherwise(F.least(F.col("freq"), F.ceil(room / F.when(F.col("__a") == 0, 1.0).otherwise(F.col("__a")))))
    # what stays must not be negative
    stay = F.when((v < 0) & (stay > 0), F.raise_error(F.lit("a negative element")).cast("long")).otherwise(stay)
    kept = run.select(v.alias("value"), "freq", stay.cast("long").alias("__k"))
    both = kept.select(F.explode(F.array(F.struct("value", F.col("__k").alias("freq")), F.struct(F.lit(0.0).alias("value"), (F.col("freq") - F.col("__k")).alias("freq")))).alias("x"))
    return _regroup(both.select("x.value", "x.freq").where("freq > 0"))

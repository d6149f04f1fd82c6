"""Filter interaction audit: what each of several filters takes away, in every order of applying them.

Words are rows: the words of all texts are exploded, aggregated by document and word, then by document to totals and
distinct words. The other flags are outer-joined, and each part of the documents is aggregated to conditional counts, one for
each set of filters that a document fails. Every figure of every order follows from these counts.

Texts are dealt out once by a row number, so that both aggregations find a document's words in one task without another
exchange; no document's rows are dealt by a key that others share.

Defined cases: a null text is empty; rows that repeat a doc_id are documents of their own; a null doc_id is neither smaller
than another nor labelled; a document is good or toxic if any row of labels says so; a null part is the empty string; an
empty table gives an empty result; columns beside those named are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import BLANKS, identity, written

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def word_totals(documents: DataFrame) -> DataFrame:
    """a, b (identity() of the row), n_words, n_distinct for the documents (doc_id, text) that have words, each identity once."""
    rows = documents.select(F.monotonically_increasing_id().alias("__id"), identity().alias("x"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("__id", "x.a", "x.b", "text").repartition("__id")
    words = rows.select("__id", "a", "b", F.explode(F.split("text", f"[{BLANKS}]+")).alias("word")).where("word <> ''")
    each = words.groupBy("__id", "a", "b", "word").agg(F.count(F.lit(1)).alias("n"))
    totals = each.groupBy("__id", "a", "b").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))
    # rows that repeat an id and a text have the same totals
    return totals.groupBy("a", "b").agg(F.max("n_words").alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def other_flags(documents: DataFrame, part: str) -> DataFrame:
    """a, b, doc_id, part and the flags that need no words: capitals, marks, copy. A row for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        identity().alias("x"), "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.length(text).alias("size"),
        (100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text)).alias("capitals"), text.rlike("[#$%&*|]").alias("marks"),
        F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(0xE), text).alias("t2"))
    rows = written(rows.select("x.a", "x.b", "doc_id", "part", "size", "capitals", "marks", "t1", "t2"), "audit-flags")
    same = ["size", "t1", "t2"]
    # written: a join with sums that stand in its own stage is one whose large groups Spark cannot split
    first = written(rows.groupBy(*same).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(*same, "first"), "audit-firsts")
    return rows.join(first, same, "left").select("a", "b", "doc_id", "part", "capitals", "marks", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy"))


def failed_filters(documents: DataFrame, part: str, min_words: int = 200, distinct_percent: int = 50) -> DataFrame:
    """doc_id, part, failed (bit i: the document fails filter i of FILTERS) for every row of documents."""
    all_rows = other_flags(documents, part).join(word_totals(documents), ["a", "b"], "left")
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    flags = (n < min_words, 100 * distinct < distinct_percent * n, F.col("capitals"), F.col("marks"), F.col("copy"))
    bits = F.lit(0)
    for i, f in enumerate(flags):
        bits = bits + F.when(f, 1 << i).otherwise(0)
    return all_rows.select("doc_id", "part", bits.alias("failed"))


def set_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, all, good, toxic: for each part, arrays with a count for each set of failed filters."""
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failed.join(marks, "doc_id", "left")
    kinds = {"all": F.lit(True), "good": F.col("good") == 1, "toxic": F.col("toxic") == 1}
    counts = [F.count_if((F.col("failed") == m) & c).alias(f"{kind}_{m}") for kind, c in kinds.items() for m in range(SETS)]
    wide = rows.groupBy("part").agg(*counts)
    return wide.select("part", *(F.array(*(F.col(f"{kind}_{m}") for m in range(SETS))).alias(kind) for kind in kinds))


def orders_report(counts: DataFrame) -> DataFrame:
    """The rows of audit_query() from those of set_counts()."""
    steps = counts.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), letter) - 1)
    before = F.aggregate(F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), ""), F.lit(0), lambda m, c: F.when(c == "", m).otherwise(m.bitwiseOR(bit(c))))
    steps = steps.select("*", bit(F.substring("filter_order", F.col("step"), F.lit(1))).alias("own"), before.alias("before"))

    def total(kind: str, holds) -> Column:
        """The counts of the sets m for which holds(m)."""
        parts = F.transform(kind, lambda n, m: F.when(holds(m), n).otherwise(0))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)

    own, before = F.col("own"), F.col("before")
    here = lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) == 0)
    # a filter of k that a document fails is the first of them in one of k orders
    share = F.transform("all", lambda n, m: F.when(m.bitwiseAND(own) != 0, n * len(ORDERS) / F.bit_count(m)).otherwise(0))
    return steps.select(
        "part", "filter_order", "step",
        total("all", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"), total("all", here).alias("removed"),
        total("all", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"), total("all", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, x: a + F.round(x).cast("long")).alias("shapley"))


def audit_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each
    language, order and step."""
    failed = failed_filters(documents.select("doc_id", "text", "lang"), "lang")
    return orders_report(set_counts(failed, labels.select("doc_id", "quality", "toxic")))


AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.part, coalesce(g.good, false) AS good, coalesce(g.toxic, false) AS toxic,
    [x.letter FOR x IN [{'letter': 'A', 'bad': len(ws) < 200}, {'letter': 'B', 'bad': 100 * len(list_distinct(ws)) < 50 * len(ws)},
        {'letter': 'C', 'bad': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text)},
        {'letter': 'D', 'bad': regexp_matches(text, '[#$%&*|]')}, {'letter': 'E', 'bad': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)}] IF x.bad] AS bad
    FROM d LEFT JOIN g ON g.doc_id = d.doc_id),
m AS (SELECT part, bad, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, bad),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS xs FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT xs, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT m.part, array_to_string(s.xs, '') AS filter_order, s.step::INT AS step, s.xs[s.step] AS own,
    coalesce(sum(n) FILTER (WHERE NOT list_has_any(bad, xs[1:step])), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE list_contains(bad, xs[step]) AND NOT list_has_any(bad, xs[1:step - 1])), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE list_contains(bad, xs[step]) AND list_has_any(bad, xs[1:step - 1])), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE bad = [xs[step]]), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE list_contains(bad, xs[step]) AND NOT list_has_any(bad, xs[1:step - 1])), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE list_contains(bad, xs[step]) AND NOT list_has_any(bad, xs[1:step - 1])), 0)::BIGINT AS toxic_lost
    FROM m, s GROUP BY m.part, s.xs, s.step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""

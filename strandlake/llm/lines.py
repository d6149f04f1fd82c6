"""Line dedup on levelled sorted runs of line hashes.

A line's key is the line without blanks at its ends and with A-Z lower-cased; it is held as 128 bits of hash. A run is a
written table (h1, h2, n_docs), hash-dealt and sorted by the hash, that counts the documents of one or more batches in
which each key occurs. New batches enter at level 0; as soon as a level holds `fanout` runs they are merged into one
run of the next level, so a hash is rewritten a logarithmic number of times. A batch is deduplicated by merge-anti-joins
of its own hashes with the runs. dedup_batch() drops what a run holds at all. drop_frequent(), whose rule looks at all
documents, feeds the same runs: each batch merge-anti-joins those hashes of the runs that are settled, which means that a run
already counts them in `min_docs` documents, and adds the counts of its others.

Defined cases: a null or empty text is one empty line; a line of blanks has the empty key; the lines of one document
that share a key count once; rows that repeat count as documents of their own; documents of any length are split
whole; an empty table gives an empty result; columns beside the text are kept as they are: a name that
the operator adds gets underscores where the table has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import BLANKS, ascii_lower, free_name, identity, remove, written


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often the functions within use refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hashed_lines(text: Column) -> Column:
    """An array (h1, h2, at) in order: 128 bits of hash and the place of each line whose key has code points."""
    keys = F.transform(split_lines(text), line_key)
    hashes = F.transform(keys, lambda k, i: F.struct(F.when(F.length(k) >= 1, F.xxhash64(k)).alias("h1"), F.xxhash64(F.lit(77), k).alias("h2"), i.alias("at")))
    return F.sort_array(F.filter(hashes, lambda x: x["h1"].isNotNull()))


class LineRuns:
    """The levels of sorted runs."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.levels = spark, fanout, []

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self._merge(old))
            for x in old:
                remove(x)
            self._place(merged, level + 1)

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        """The counts of equal hashes added; runs are sorted, so what an exchange deals out is sorted in stretches."""
        all_rows = runs[0]
        for x in runs[1:]:
            all_rows = all_rows.union(x)
        return all_rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs")) if len(runs) > 1 else all_rows

    @staticmethod
    def _write(run: DataFrame) -> DataFrame:
        return written(run.sortWithinPartitions("h1", "h2"), "line-run")

    def add(self, lines: DataFrame, settled: int | None = None) -> None:
        """lines: h1, h2, one row for each document and key. Keys that a run counts in `settled` documents are not counted on."""
        run = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
        self._place(self._write(run if settled is None else self.unseen(run, settled)), 0)

    def counts(self) -> DataFrame | None:
        """h1, h2, n_docs over everything added; for settled keys what was counted, which is at least `settled`."""
        runs = [x for level in self.levels for x in level]
        return self._merge(runs) if runs else None

    def frequent(self, min_docs: int) -> DataFrame | None:
        found = self.counts()
        return None if found is None else found.where(F.col("n_docs") >= min_docs)

    def unseen(self, lines: DataFrame, n_docs: int = 1) -> DataFrame:
        """lines without those whose hash a run counts in n_docs documents or more: a merge-anti-join with each run."""
        for level in self.levels:
            for run in level:
                held = run.where(F.col("n_docs") >= n_docs) if n_docs > 1 else run
                lines = lines.join(held.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return lines

    def close(self) -> None:
        for level in self.levels:
            for x in level:
                remove(x)
        self.levels = []


def keyed_lines(documents: DataFrame, batches: int) -> DataFrame:
    """__row (identity() of the row), __at, h1, h2, __first, __batch: a row for each line with a key, written. __first marks
    one line of each key of a row, found by neighbours in the order of hashes: lines need no exchange to be told apart."""
    same = lambda x, y: x["h1"].eqNullSafe(y["h1"]) & x["h2"].eqNullSafe(y["h2"])
    marked = once(hashed_lines(F.col("text")), lambda all_lines: F.transform(all_lines, lambda x, i: F.struct(x.alias("line"), (~same(x, F.get(all_lines, i - 1))).alias("first"))))
    # the row's own hash is taken before lines are exploded, not once a line
    lines = documents.select(identity().alias("__row"), marked.alias("__lines")).select("__row", F.explode("__lines").alias("l")).select(
        "__row", F.col("l.line.at").alias("__at"), "l.line.h1", "l.line.h2", F.col("l.first").alias("__first"), F.pmod("__row.a", F.lit(batches)).cast("int").alias("__batch"))
    return written(lines, "lines", "__batch")


def without(lines: Column, gone: Column) -> Column:
    """The elements of lines whose 0-based places are not in gone: the stretches between neighbouring places, in order."""
    ends = F.concat(F.array(F.lit(-1)), F.sort_array(gone), F.array(F.size(lines)))
    stretch = lambda all_lines, e, i: F.slice(all_lines, F.get(e, i) + 2, F.get(e, i + 1) - F.get(e, i) - 1)
    return once(lines, lambda x: once(ends, lambda e: F.flatten(F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda i: stretch(x, e, i)))))


def drop_frequent(documents: DataFrame, min_docs: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """documents with every line gone whose key is found in min_docs documents or more.

    Returns all rows and columns, `text` holding the lines that stay, joined by \\n (never null), and `__n_lines`,
    `__n_dropped` (long). Batches are parts of the rows by a hash of id and text; the runs take them one after another, each
    without what the runs before have settled.
    Lines, not texts, are counted and joined: a hash and a place each. A key that a third of the documents hold is
    counted by partial sums, and the join with it is one that Spark can split. Rows that repeat an id and a text share
    their places, which are the same.
    """
    lines = keyed_lines(documents, batches)
    runs = LineRuns(documents.sparkSession, fanout)
    for b in range(batches):
        runs.add(lines.where((F.col("__batch") == b) & F.col("__first")).select("h1", "h2"), min_docs)
    # what the levels hold now is merged once more; the frequent keys are written, so the runs can go
    keys = written(runs.frequent(min_docs).select("h1", "h2"), "line-keys")
    runs.close()
    hits = lines.join(keys, ["h1", "h2"]).groupBy("__row").agg(F.collect_set("__at").alias("__gone"))
    text = F.coalesce(F.col("text"), F.lit(""))
    row, gone = free_name(documents, "__row"), free_name(documents, "__gone")
    out = documents.withColumn(row, identity()).join(hits.select(F.col("__row").alias(row), F.col("__gone").alias(gone)), row, "left")
    return out.select(
        *(F.when(F.col(gone).isNull(), text).otherwise(F.array_join(without(split_lines(F.col("text")), F.col(gone)), "\n")).alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias(free_name(documents, "__n_lines")),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(free_name(documents, "__n_dropped")),
    )


def dedup_batch(batch: DataFrame, runs: LineRuns) -> DataFrame:
    """One more batch of documents: lines whose key an earlier batch holds go; the batch's own keys enter the runs.

    Same columns as drop_frequent(). Lines that only this batch holds stay, however often it repeats them.
    """
    lines = keyed_lines(batch, 1)
    own = lines.where("__first").select("h1", "h2")
    # keys of this batch alone, by merge-anti-joins with the runs; the runs change below, so what stays is written first
    fresh = written(runs.unseen(own.distinct()), "line-fresh")
    gone = written(lines.join(fresh, ["h1", "h2"], "left_anti").groupBy("__row").agg(F.collect_set("__at").alias("__gone")), "line-hits")
    remove(fresh)
    runs.add(own)
    text = F.coalesce(F.col("text"), F.lit(""))
    row, at = free_name(batch, "__row"), free_name(batch, "__gone")
    out = batch.withColumn(row, identity()).join(gone.select(F.col("__row").alias(row), F.col("__gone").alias(at)), row, "left")
    kept = F.array_join(without(split_lines(F.col("text")), F.col(at)), "\n")
    return out.select(
        *(F.when(F.col(at).isNull(), text).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in batch.columns),
        F.size(split_lines(text)).cast("long").alias(free_name(batch, "__n_lines")),
        F.coalesce(F.size(at), F.lit(0)).cast("long").alias(free_name(batch, "__n_dropped")),
    )


def lines_query(documents: DataFrame, min_docs: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of documents."""
    out = drop_frequent(documents.select("doc_id", "text"), min_docs)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


LINES_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""

"""Work that has to grow with the input: the plans and the cost of steps that once grew faster."""

import os
import time
from collections import Counter

from pyspark.sql import functions as F

from strandlake.functions import sequences as sq
from strandlake.operators import annotation, catalogue, kmers, paths
from strandlake.plans import tables
from strandlake.sources import annotations, formats


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_windows_of_a_long_text_take_one_pass(spark):
    assert [list(r.w) for r in spark.createDataFrame([("aé😀\nz",), ("ab",), ("",)], "s string").select(sq.windows(F.col("s"), 3).alias("w")).collect()] == [["aé😀", "é😀\n", "😀\nz"], [], []]
    s = spark.range(1).select(F.repeat(F.concat(F.col("id").cast("string"), F.lit("ACGTTGCAA")), 50000).alias("seq"))
    begin = time.time()
    w = kmers.spectrum(s, kmers.Content.parse("DNA(ss,ci,ignore)"), kmers.Hasher(5))
    assert w.agg(F.sum("weight")).first()[0] == 450000 - 4
    assert time.time() - begin < 15


def test_equal_runs_of_tokens_are_cut_once(spark):
    tokens = ["the", "th", "he", "e", " "]
    texts = ["the he", "xthxhe the", "th" * 30000, "", None, "q", "the  th"]
    found = kmers.text_spectrum(spark.createDataFrame([(t,) for t in texts], "text string"), tokens, 2)
    assert "keys=[run#" in plan(found)
    want: Counter = Counter()
    for t in filter(None, texts):
        at, ts = 0, []
        while at < len(t):
            best = max((x for x in tokens if t.startswith(x, at)), key=len, default="")
            ts.append(tokens.index(best) if best else None)
            at += len(best) or 1
        want.update(f"{a}-{b}" for a, b in zip(ts, ts[1:]) if a is not None and b is not None)
    assert {r.kmer: r.weight for r in found.collect()} == want


def test_numbers_of_lines_need_no_sort_of_lines(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("".join(f"{k}.{i}\n" for i in range(k + 1)))
    x = formats.lines(spark, f"file://{tmp_path}")
    assert "SortAggregate" not in plan(x)
    assert [tuple(r) for r in x.orderBy("ordinal").collect()] == [(0, "0.0"), (1, "1.0"), (2, "1.1"), (3, "2.0"), (4, "2.1"), (5, "2.2")]


def test_pairs_of_blocks_are_dealt_to_tasks(spark, monkeypatch):
    """Rows of pairs are small, so by their bytes Spark made one task of all of them; tasks follow the result's size."""
    monkeypatch.setattr(paths, "PER_TASK", 200, raising=False)
    rows = [(0, i, 0 if i else -1, f"n{i}", float(i)) for i in range(61)]
    nodes = spark.createDataFrame(rows, "tree_id long, idx int, parent_idx int, name string, length double")
    all_pairs, matrix = paths.distances(nodes, block=8), paths.cophenetic(nodes, block=8)
    for df, n in ((all_pairs, 61 * 60 // 2), (matrix, 3600)):
        assert df.groupBy(F.spark_partition_id()).count().count() > 4
        assert df.count() == n
    assert all_pairs.where("distance <> if(a = 0, 0, a) + b").count() == 0
    assert matrix.where("value <> if(row = col, 0, int(substr(row, 2)) + int(substr(col, 2)))").count() == 0


def test_parents_are_made_by_hash(spark):
    """Rows were sorted to find the first one's strand, once for transcripts and once for genes."""
    schema = "n long, seq string, type string, low long, length long, strand string, gene_id string, transcript_id string"
    rows = [
        (5, "c", "exon", 30, 5, "+", "g", "t"), (4, "c", "exon", 10, 9, "-", "g", "t"), (4, "c", "exon", 12, 2, "+", "g", "t"), (1, "c", "CDS", 7, 1, "-", "g", None), (3, "c", "exon", 50, 4, None, "g", "u"),
        (2, "c", "transcript", 1, 2, "+", "h", "v"), (8, "c", "transcript", 1, 3, ".", "g", "u"), (7, "c", "transcript", 1, 9, "-", "g", "u"), (9, "d", "gene", 2, 4, "?", "i", None)]
    found = annotation.synthesize_parents(spark.createDataFrame(rows, schema))
    # what is left to sort are given genes and transcripts
    assert "min_by" not in plan(found)
    got = sorted((r.n, r.type, r.low, r.length, r.strand, r.gene_id, r.transcript_id, r.synthesized) for r in found.collect() if r.type in ("gene", "transcript"))
    assert got == [
        (1, "gene", 7 + 3, 44, None, "g", None, True), (2, "gene", 0, 1, None, "h", None, True), (4, "transcript", 10, 25, "+", "g", "t", True),
        (8, "transcript", 1, 3, ".", "g", "u", False), (9, "gene", 2, 4, "?", "i", None, False)]
    assert found.count() == len(got) + 4


def test_rows_of_a_gtf_file_are_not_shuffled(spark):
    """All features with their attributes were joined to first rows, twice, and sorted; the file stayed."""
    folder = tables.shared_folder(spark).removeprefix("file://")
    files = lambda: {x for x in os.listdir(folder) if x.startswith("gtf-") and not x.startswith("gtf-rows")}
    before = files()
    found = catalogue.queries()["gtf_scan"](spark, "/root/testdata/sf0.001")
    assert files() == before
    assert "Exchange" not in plan(found)


def test_lines_of_a_gtf_file_are_sorted_not_features(spark):
    found = catalogue.queries()["gtf_written"](spark, "/root/testdata/sf0.001")
    assert plan(found).count("Exchange") == 1 and "Sort [__order" in plan(found)
    lines = [r.line.split("\t") for r in found.collect()]
    assert [x[2] for x in lines[:3]] == ["gene", "transcript", "exon"]
    number = [int(x[8].split('gene_id "g')[1].split('"')[0]) for x in lines]
    assert number == sorted(number)


def test_features_of_a_gtf_file_in_order(spark, tmp_path):
    row = lambda kind, low, g, t: f'c\td\t{kind}\t{low}\t{low}\t.\t+\t.\tgene_id "{g}";' + (f' transcript_id "{t}";' if t else "") + "\n"
    (tmp_path / "a.gtf").write_text("".join(row(*x) for x in [("exon", 5, "g", "t"), ("exon", 6, "g", "u"), ("exon", 7, "h", "v"), ("transcript", 1, "g", "u"), ("exon", 8, "g", "t"), ("gene", 1, "h", None), ("gene", 9, "i", None)]))
    f = annotations.read_gtf(spark, f"file://{tmp_path}/a.gtf")
    got = [(r.type, r.id, r.n, r.ord) for r in f.collect()]
    assert got == [
        ("gene", "g", 0, [0]), ("transcript", "t", 0, [0, 0]), ("exon", None, 0, [0, 0, 0]), ("exon", None, 4, [0, 0, 4]), ("transcript", "u", 3, [0, 1]), ("exon", None, 1, [0, 1, 1]),
        ("gene", "h", 5, [2]), ("transcript", "v", 2, [2, 2]), ("exon", None, 2, [2, 2, 2]), ("gene", "i", 6, [6])]
    free = annotations.read_gtf(spark, f"file://{tmp_path}/a.gtf", ordered=False)
    assert "ord" not in free.columns and sorted(map(str, free.collect())) == sorted(map(str, f.drop("ord").collect()))

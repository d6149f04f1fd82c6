import pytest
from pyspark.sql import functions as F

from strandlake.functions import genetic_code as code
from strandlake.functions import sequences as sq


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_reverse_complement(spark):
    assert one(spark, sq.rc(F.lit("GAtTaCA"))) == "TGtAaTC"
    assert one(spark, sq.rc(sq.rc(F.lit("ACGTNacgtn-")))) == "ACGTNacgtn-"


def test_linters(spark):
    assert one(spark, sq.dnaize(F.lit("acg-tXé"))) == "ACGNTNN"
    assert one(spark, sq.dnaize(F.lit("acg-tX"), True, True)) == "acg-tN"
    assert one(spark, sq.proteinize(F.lit("mkOU*b-"))) == "MKOU*XX"


def test_windows_of_short_sequences(spark):
    assert one(spark, sq.windows(F.lit("AC"), 3)) == []
    assert one(spark, sq.windows(F.lit("ACG"), 3)) == ["ACG"]
    assert one(spark, sq.windows(F.lit(""), 1)) == []


def test_pointer_round_trip(spark):
    p = one(spark, sq.pointer(F.lit("chr1:reverse:5:10")))
    assert (p.name, p.strand, p.low, p.length) == ("chr1", "-", 4, 10)
    with pytest.raises(Exception, match="not a pointer"):
        one(spark, sq.pointer(F.lit("chr1")))


def test_slice_out_of_bounds(spark):
    with pytest.raises(Exception, match="out of bounds"):
        one(spark, sq.slice_sequence(F.lit("ACGT"), F.lit(2), F.lit(3)))


def test_tables():
    assert len(code.TABLES) == 26
    assert code.residues(1)["TGA"] == "*" and code.residues(2)["TGA"] == "W" and code.residues(1)["GCN"] == "A"
    assert code.residues(27)["TAA"] == "*" and code.stops(27) == ["NNN", "TGA"]


def test_translate(spark):
    assert one(spark, sq.translate(F.lit("ATGGCCTAAGGG"))) == "MA"
    assert one(spark, sq.translate(F.lit("ATGGCCTAAGGG"), stop_on_first=False)) == "MA*G"
    assert one(spark, sq.translate(F.lit("CTGGCN"), replace_alternative=True)) == "MA"
    assert one(spark, sq.translate(F.lit("AT"), phase=5)) == ""


def test_open_frames(spark):
    got = one(spark, sq.open_frames(F.lit("ATGATGTAAATGCCC")))
    assert [(r.start, r["product"]) for r in got] == [(0, "MM*")]


def test_percent(spark):
    assert one(spark, sq.decode_percent(F.lit("a%20b%zz%3B+"))) == "a b%zz;+"
    assert one(spark, sq.decode_percent(sq.encode_percent(F.lit("a;b=c,d%")))) == "a;b=c,d%"

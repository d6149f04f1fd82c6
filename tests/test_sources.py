import pytest
from pyspark.sql import functions as F

from strandlake.functions import sequences as sq
from strandlake.operators import annotation
from strandlake.operators.kmers import Content, Hasher
from strandlake.sources import annotations, formats, matrices, reads
from strandlake.streaming import stateless


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text.encode())
    return f"file://{p}"


def rows(df):
    return [tuple(r) for r in df.orderBy("read_id", "segment").collect()]


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fa", "\r\n>one x\r\nac\r\ng-\r\n\r\n>two\n>three\nNNN")
    assert rows(reads.fasta(spark, p)) == [(0, 0, "one x", "ACGN", ""), (1, 0, "two", "", ""), (2, 0, "three", "NNN", "")]
    with pytest.raises(Exception, match="empty sequence"):
        reads.fasta(spark, p, allow_empty=False).collect()
    with pytest.raises(Exception, match="no header"):
        reads.fasta(spark, put(tmp_path, "b.fa", "ACG\n>x\nA")).collect()
    assert reads.fasta(spark, put(tmp_path, "c.fa", "")).count() == 0


def test_fastq(spark, tmp_path):
    one = "".join(f"@r{i}\nACG{'T' * i}\n+\nIII{'I' * i}\n" for i in range(4))
    a, b = put(tmp_path, "1.fq", one), put(tmp_path, "2.fq", one.replace("@r", "@m"))
    assert rows(reads.fastq(spark, a))[3] == (3, 0, "r3", "ACGTTT", "IIIIII")
    assert [r[2] for r in rows(reads.paired_fastq(spark, a, b))][:3] == ["r0", "m0", "r1"]
    assert [r[:3] for r in rows(reads.interleaved_fastq(spark, a))][-1] == (1, 1, "r3")
    with pytest.raises(Exception, match="different lengths"):
        reads.paired_fastq(spark, a, put(tmp_path, "3.fq", one[: len(one) // 2].rsplit("@", 1)[0])).collect()
    with pytest.raises(Exception, match="malformed"):
        reads.fastq(spark, put(tmp_path, "4.fq", one[:-10])).collect()


def test_tabular_round_trip(spark, tmp_path):
    p = put(tmp_path, "t.tsv", "a\tACG\nb\tAC\tII\nc\tA\tI\td\tC\tJ\n")
    df = reads.tabular(spark, p)
    out = f"file://{tmp_path}/out"
    reads.write_tabular(df.coalesce(1), out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["a\tACG", "b\tAC\tII", "c\tA\tI\td\tC\tJ"]
    reads.write_records(df, f"file://{tmp_path}/rec")
    assert {r.kind for r in spark.read.text(f"file://{tmp_path}/rec").select("kind").distinct().collect()} == {"fasta", "SE", "PE_1", "PE_2"}
    with pytest.raises(Exception, match="number of fields"):
        reads.tabular(spark, put(tmp_path, "u.tsv", "a\tb\tc\td\n")).collect()


def test_junctions_and_reference(spark, tmp_path):
    p = put(tmp_path, "j.tsv", "chr1\t+\t10\t20\nchr1\t-\t5\t9\t7\nx\tF\t3\tx\tforward\t8\t2\n")
    got = [tuple(r)[1:] for r in reads.junctions(spark, p).orderBy("line").collect()]
    assert got == [("chr1", "+", 9, 19, 0), ("chr1", "-", 4, 8, 7), ("x", "+", 2, 7, 2)]
    fa, t = put(tmp_path, "r.fa", ">c1\nAC\n>c2\nGG\n>c1\nTT\n"), put(tmp_path, "t.tab", "c1\t2\n")
    assert {(r.name, r.seq, r.table_id) for r in reads.reference(spark, fa).collect()} == {("c1", "TT", 1), ("c2", "GG", 1)}
    with pytest.raises(Exception, match="no translation table"):
        reads.reference(spark, fa, t).collect()


def test_dictionary(spark, tmp_path):
    d = reads.dictionary(spark, put(tmp_path, "d.txt", "A\n\nB\nC\n"), lower=True)
    assert sorted(map(tuple, d.collect())) == [(0, "c"), (1, "b"), (2, "a")]


def test_matrix(spark, tmp_path):
    p = put(tmp_path, "m.tsv", '"x"\t"c1"\tc2\nr2\t1\t2.5\nr1\t3\t1e-7\n\nignored\t1\t1\n')
    m = matrices.read_matrix(spark, p)
    assert [r.line for r in matrices.matrix_lines(m.select("row", "col", "value"), 6).collect()] == ["\tc1\tc2", "r1\t3\t1e-07", "r2\t1\t2.5"]
    with pytest.raises(Exception, match="ragged"):
        matrices.read_matrix(spark, put(tmp_path, "n.tsv", "\ta\nr\t1\t2\n")).collect()


GFF = """##gff-version 3
##sequence-region chr1 1 1000
chr1\tdemo\tgene\t100\t900\t.\t+\t.\tID=g1;Name=a%20b
chr1\tdemo\tmRNA\t100\t900\t.\t+\t.\tID=m1;Parent=g1
chr1\tdemo\texon\t100\t300\t.\t+\t.\tParent=m1
# a comment
chr1\tdemo\tCDS\t150\t300\t.\t+\t0\tParent=m1;;Note=x,y
"""


def test_gff3(spark, tmp_path):
    f, meta = annotations.read_gff3(spark, put(tmp_path, "a.gff3", GFF))
    assert [(r.key, r.value) for r in meta.orderBy("pos").collect()] == [("gff-version", "3"), ("sequence-region", "chr1 1 1000")]
    got = f.select(annotation.path_string().alias("p"), "low", "length", "phase", "attributes").collect()
    assert [r.p for r in got] == ["annotation->gene", "annotation->gene->mRNA", "annotation->gene->mRNA->exon", "annotation->gene->mRNA->CDS"]
    assert (got[0].low, got[0].length, got[0].attributes["Name"], got[3].attributes["Note"]) == (99, 801, ["a b"], ["x", "y"])
    again = "##gff-version 3\n" + "\n".join(r.line for r in annotations.gff3_lines(f, encode=True).collect()) + "\n"
    g, _ = annotations.read_gff3(spark, put(tmp_path, "b.gff3", again))
    assert [tuple(r) for r in g.select("seq", "low", "length", "id", "parent").collect()] == [tuple(r) for r in f.select("seq", "low", "length", "id", "parent").collect()]
    with pytest.raises(ValueError, match="hierarchy"):
        annotations.read_gff3(spark, put(tmp_path, "c.gff3", GFF), dialect="gencode")
    with pytest.raises(ValueError, match="without its parent"):
        annotations.read_gff3(spark, put(tmp_path, "d.gff3", GFF.replace("ID=m1;Parent=g1", "ID=m1;Parent=zz")))


def test_gtf(spark, tmp_path):
    exon = "\n".join(f'chr1\td\texon\t{a}\t{b}\t.\t-\t.\tgene_id "g1"; transcript_id "t1";' for a, b in ((100, 200), (400, 500)))
    f = annotations.read_gtf(spark, put(tmp_path, "a.gtf", exon + "\n"))
    got = {(r.type, r.low, r.length, r.synthesized) for r in f.collect()}
    assert got == {("gene", 99, 401, True), ("transcript", 99, 401, True), ("exon", 99, 101, False), ("exon", 399, 101, False)}
    assert [r.line.split("\t")[2] for r in annotations.gtf_lines(f).collect()] == ["gene", "transcript", "exon", "exon"]
    whole = """chr1\thav\tgene\t1\t90\t.\t+\t.\tgene_id "g"; gene_name "N; \\"x\\""; level 2;
chr1\thav\tCDS\t5\t9\t3.5\t+\t2\tgene_id "g"; transcript_id "t"; tag "a"; tag "b";
"""
    p = put(tmp_path, "b.gtf", whole)
    got = annotations.read_gtf(spark, p).collect()
    assert [(r.type, r.source, r.phase, r.score, r.id, r.path) for r in got] == [
        ("gene", "hav", None, None, "g", ["gene"]), ("transcript", None, None, None, "t", ["gene", "transcript"]), ("CDS", "hav", 2, "3.5", None, ["gene", "transcript", "CDS"])]
    assert got[0].attributes == {"gene_id": ["g"], "gene_name": ['N; "x"'], "level": ["2"]} and got[2].attributes["tag"] == ["a", "b"]
    again = "\n".join(r.line for r in annotations.gtf_lines(annotations.read_gtf(spark, p)).collect()) + "\n"
    back = annotations.read_gtf(spark, put(tmp_path, "c.gtf", again)).collect()
    assert [(r.type, r.low, r.length, r.attributes, r.phase) for r in back] == [(r.type, r.low, r.length, r.attributes, r.phase) for r in got]
    with pytest.raises(ValueError, match="hierarchy"):
        annotations.read_gtf(spark, put(tmp_path, "d.gtf", whole.replace("CDS", "odd")))
    with pytest.raises(Exception, match="without gene_id"):
        annotations.read_gtf(spark, put(tmp_path, "e.gtf", whole.replace('gene_id "g"; transcript_id', 'transcript_id'))).collect()


def test_percent(spark):
    df = spark.createDataFrame([("caf%C3%A9%20x%2",), ("100%",), ("%zz%41",), ("",)], "s string")
    assert [r.s for r in df.select(sq.decode_percent(F.col("s")).alias("s")).collect()] == ["café x%2", "100%", "%zzA", ""]


def test_saved_annotation(spark, tmp_path):
    f, meta = annotations.read_gff3(spark, put(tmp_path, "a.gff3", GFF))
    annotations.save_annotation(f"file://{tmp_path}/saved", f, meta)
    g, m = annotations.load_annotation(spark, f"file://{tmp_path}/saved", "metadata")
    assert sorted(map(str, g.collect())) == sorted(map(str, f.collect())) and m.count() == 2
    assert [r.line for r in annotations.gff3_header(annotation.add_metadata(m, "date", "today")).collect()] == ["##date today", "##gff-version 3", "##sequence-region chr1 1 1000"]
    assert annotations.gff3_header(m.limit(0)).first().line == "##gff-version 3"


def test_files_are_numbered_by_name(spark, tmp_path):
    for i in range(5):
        put(tmp_path, f"{i}.txt", "".join(f"{i} {j}\n" for j in range(50 - 9 * i)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    got = [r.value for r in formats.lines(spark, f"file://{tmp_path}").orderBy("ordinal").collect()]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"{i} {j}" for i in range(5) for j in range(50 - 9 * i)]


def test_genbank(spark, tmp_path):
    text = """LOCUS       demo01 30 bp DNA
DEFINITION  A demo
            record
FEATURES             Location/Qualifiers
     source          1..30
     gene            1..15
                     /locus_tag="D1"
     CDS             join(1..5,
                     complement(7..15))
                     /gene="abcA"
                     /translation="MA
                     RC"
     misc_feature    3^4
ORIGIN
        1 acgtacgtac gtacgtacgt acgtacgtac
//
"""
    f, r = annotations.read_genbank(spark, put(tmp_path, "a.gb", text))
    got = [(x.path[-1], x.id, x.low, x.length, x.strand) for x in f.orderBy("ord", "part").collect()]
    assert got == [("source", "demo01", 0, 30, None), ("gene", "D1", 0, 15, None), ("CDS", "abcA", 0, 5, "-"), ("CDS", "abcA", 6, 9, "-"), ("misc_feature", None, 3, 0, None)]
    assert annotations.parse_location("complement(join(complement(1..2),5))") == ([(0, 2), (4, 1)], "-")
    assert r.first().seq == "ACGTACGTACGTACGTACGTACGTACGTAC"
    record = annotations.genbank_text(f, r, (("DEFINITION", "A demo"),)).first().record
    assert record.startswith("LOCUS       demo01          30 bp    DNA\nDEFINITION  A demo\nFEATURES") and record.endswith("//")
    again, r2 = annotations.read_genbank(spark, put(tmp_path, "b.gb", record + "\n"))
    # a place between bases is written as an empty range, and read as such
    assert [(x.path[-1], x.low, x.length) for x in again.orderBy("ord", "part").collect()] == [(k, a, b) for k, _, a, b, _ in got]
    assert r2.first().seq == r.first().seq
    meta = annotations.read_genbank_metadata(spark, put(tmp_path, "a.gb", text)).collect()
    assert [(m.key, m.value) for m in meta] == [("DEFINITION", "A demo record")]
    with pytest.raises(Exception, match="not in the hierarchy"):
        annotations.read_genbank(spark, put(tmp_path, "c.gb", text.replace("misc_feature", "odd         ")))[0].collect()


def test_stream(spark, tmp_path):
    put(tmp_path, "in.tsv", "a\tACGT\nb\tAACC\n")
    s = stateless.stream_tabular(spark, f"file://{tmp_path}")
    q = stateless.stream_spectrum(s, Content.parse("ds-DNA"), Hasher(2)).writeStream.outputMode("complete").format("memory").queryName("spectrum").start()
    q.processAllAvailable()
    q.stop()
    assert {r.kmer: r.weight for r in spark.table("spectrum").collect()} == {"AC": 3.0, "CG": 1.0, "AA": 1.0, "CC": 1.0}

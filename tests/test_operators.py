import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from strandlake.functions import sequences as sq
from strandlake.operators import annotation, catalogue, graph, intervals, kmers, matrix, neighbours, records, repeats, statistics, trees
from strandlake.plans import programs
from strandlake.sources import newick


def test_classes_of_the_documented_lines(spark):
    lines = spark.createDataFrame(enumerate(["A duh", "  b  C", "c f e", " duh zz x", "b c", "", " \t"]), "line long, value string")
    got = graph.class_lines(graph.equivalence_classes(graph.tokenize_lines(lines))).collect()
    assert [r.line.split("\t") for r in got] == [["A", "duh", "x", "zz"], ["C", "b", "c", "e", "f"]]
    lines = spark.createDataFrame([(0, "z y"), (1, "a z")], "line long, value string")
    c = graph.equivalence_classes(graph.tokenize_lines(lines))
    assert graph.class_lines(c).first().line == "y\tz\ta"
    assert graph.class_lines(c, "lexicographic").first().line == "a\ty\tz"


def test_content_specifications():
    c = kmers.Content.parse("DNA(ds,cs,skip)")
    assert (c.strands, c.case_sensitive, c.unknown, c.alphabet) == (2, True, "ignore", "ACGTacgt")
    assert kmers.Content.parse(str(c)) == c
    assert kmers.Content.parse("text(ci,split,/a(b),c)").path == "/a(b),c"
    with pytest.raises(ValueError):
        kmers.Content.parse("rna")
    assert kmers.Hasher.parse("gapped(3,2)") == kmers.Hasher(3, 2)


def test_hash_round_trip():
    rng = random.Random(1)
    for alphabet in kmers.ALPHABETS.values():
        for k in (1, 3, 20):
            w = "".join(rng.choice(alphabet) for _ in range(k))
            assert kmers.decode_hex(kmers.encode_hex(w, alphabet), alphabet, k) == w
    assert kmers.decode_hex("1b_00", "ACGT", 4, 2) == "ACGT--AAAA"
    for bad in ("1", "1b_1b", "zz"):
        with pytest.raises(ValueError):
            kmers.decode_hex(bad, "ACGT", 4)


def test_spectrum_sums(spark):
    df = spark.createDataFrame([("ACGTNACG", 1.0), ("acg", 2.0), ("A", 1.0), ("NNN", 1.0), ("", 1.0)], "seq string, w double")
    s = {r.kmer: r.weight for r in kmers.spectrum(df, kmers.Content.parse("ss-DNA"), kmers.Hasher(3), weight="w").collect()}
    assert s == {"ACG": 4.0, "CGT": 1.0}


def test_ball():
    near = kmers.ball("ACGT", 1, "T", "G")
    assert {"ACGT", "TCGT", "CGTG", "TCGT", "AACG"} <= near and all(len(w) == 4 for w in near)
    assert len(kmers.ball("ACGT", 0)) == 1


def test_text_encoder():
    assert encode_text("abc", {"ab": 0, "abc": 1, "c": 2}) == [[1]]
    assert encode_text("ab?c", {"ab": 0, "c": 2}) == [[0], [2]]
    assert encode_text("ab?c", {"ab": 0, "c": 2}, "ignore") == [[0, 2]]


def test_regex_dialect():
    assert records.java_regex(r"\(a\|b\)(c|d)") == r"(a|b)\(c\|d\)"


def test_compact_expand_actions(spark):
    df = spark.createDataFrame([(0, 0, "a", "ACG", "III"), (0, 1, "b", "GG", "II"), (1, 0, "c", "T", "")], "read_id long, segment int, tag string, seq string, qua string")
    lines = {r.read_id: r.line for r in programs.run_reads(df, [("compact",)]).collect()}
    assert lines == {0: "a\tACG\tIII\tb\tGG\tII", 1: "c\tT"}
    got = programs.run_reads(df, [("match", "b"), ("revcom",), ("dropq",), ("expand",)]).orderBy("segment").collect()
    assert [r.record for r in got] == [">a\nCGT", ">b\nCC"]


def test_frequencies(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 0.0, 4.0, 0.5, 0.0, 3.5, 4.0)], "x double")
    f = statistics.frequencies(df, "x")
    table = lambda d: {r.value: r.freq for r in d.collect()}
    assert table(f) == {0.0: 2, 0.5: 1, 1.0: 1, 3.5: 1, 4.0: 2}
    more = df.union(spark.createDataFrame([(0.5,)], "x double"))
    assert statistics.median(more, "x").first().median == 0.75
    f = statistics.frequencies(more, "x")
    assert statistics.summary(f).first().sum_abs == 13.5
    assert table(statistics.threshold(f, 0.5)) == {0.0: 3, 0.5: 2, 1.0: 1, 3.5: 1, 4.0: 1}
    assert table(statistics.pow_abs(f, 2))[16.0] == 2


def test_matrix_errors(spark):
    m = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0)], "row string, col string, value double")
    other = spark.createDataFrame([("c", "y", 1.0)], "row string, col string, value double")
    with pytest.raises(Exception, match="in both"):
        matrix.merge_rows(m, m).collect()
    with pytest.raises(Exception, match="column names"):
        matrix.merge_rows(m, other).collect()
    assert matrix.merge_rows(m, m.limit(0)).count() == 2
    assert sorted(map(tuple, matrix.transpose(matrix.transpose(m)).collect())) == sorted(map(tuple, m.collect()))


def brute_repeats(s, longest, least):
    found = {}
    n = len(s)
    for k in range(1, min(longest, (n + 1) // 2) + 1):
        left = {}
        for i in range(n - k + 1):
            left.setdefault(s[i : i + k], set()).add(i)
        chains = {}
        for w, places in left.items():
            while places:
                lo = hi = min(places)
                while hi in places:
                    places.discard(hi)
                    hi += k
                if hi - k > lo:
                    chains[lo] = (w, hi - 1)
        run = None
        for lo in [*sorted(chains), 10**9]:
            if run and lo == run[3] + 1:
                run = (run[0], max(run[1], chains[lo][1]), run[2], lo)
                continue
            if run and run[1] - run[0] + 1 >= least:
                found.setdefault((run[0], run[1]), set()).add(run[2])
            run = (lo, chains[lo][1], chains[lo][0], lo) if lo in chains else None
    out, top = [], -1
    for (lo, hi), u in sorted(found.items()):
        if hi > top:
            out.append((lo, hi, min(u)))
            top = hi
    return out


def test_tandem_repeats(monkeypatch):
    rng = random.Random(2)
    letters = lambda n, of="AC": "".join(rng.choice(of) for _ in range(n))
    for _ in range(400):
        s = letters(rng.randint(0, 24), "ACG"[: rng.randint(1, 3)])
        for longest in (None, 6):
            assert repeats.tandem_repeats(s, longest, 3) == brute_repeats(s, longest or len(s), 3), s
    monkeypatch.setattr(repeats, "SHORT", 4)  # nearly all periods are met at anchors
    for _ in range(400):
        unit = letters(rng.randint(1, 14))
        s = letters(rng.randint(0, 10)) + unit * rng.randint(1, 4) + letters(rng.randint(0, 10)) + unit * rng.randint(0, 3)
        assert repeats.tandem_repeats(s) == brute_repeats(s, len(s), 0), s


def test_tandem_repeats_over_windows(spark):
    """Sequences cut to windows give what they give whole: long and short periods, repeats over many windows, one letter alone."""
    rng = random.Random(5)
    rows = [("none", None), ("empty", ""), ("one", "A" * 700), ("few", "ACGTT" * 100), ("é", "éñ" * 100)]
    for i in range(16):
        blocks = ["".join(rng.choice("AC") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30, 77]))) * rng.choice([1, 1, 2, 3, 6, 20]) for _ in range(rng.randint(1, 6))]
        rows.append((f"t{i % 12}", "".join(blocks)))
    df = spark.createDataFrame(rows, "tag string, seq string").repartition(3)
    for longest, least, window in ((None, 0, 16), (None, 9, 100), (20, 0, 64)):
        whole = sorted(map(tuple, repeats.find_repeats(df, longest, least).collect()))
        assert whole and sorted(map(tuple, repeats.find_repeats(df, longest, least, window).collect())) == whole
    # a long sequence in which a unit of many windows is repeated
    unit = "".join(rng.choices("ACGT", k=100_000))
    long = spark.createDataFrame([("long", "".join(rng.choices("ACGT", k=300_000)) + unit * 4 + "".join(rng.choices("ACGT", k=300_000)))], "tag string, seq string")
    found = [(r.lo, r.hi, r.unit_length) for r in repeats.find_repeats(long, least=60, window=1 << 16).collect()]
    assert len(found) == 1 and found[0][2] == 100_000 and 0 <= 300_001 - found[0][0] < 20 and 0 <= found[0][1] - 700_000 < 20


def test_consensus(spark):
    rows = ["ACGTACGTAC"] * 5 + ["ACGTTCGTAC", "ACGT-CGTAC"]
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(rows)], "group long, row long, seq string")
    assert repeats.consensus(df).first().consensus == "ACGTACGTAC"
    assert repeats.side_dashes("--AC-") == ("  AC ", 2, 3)
    tipped = repeats.remove_tips("A-----CGTACGTACCGT")
    assert tipped == "------CGTACGTACCGT"
    assert len(repeats.remove_tips("A-CGTACGTAC")) == 11


def test_newick_and_distances(spark):
    text = "((A[&color=red]:1,'B b':2)ab:0.5,C:3,(D:1)#R1:1);"
    nodes = newick.parse(text)[0]
    assert newick.parse(newick.write_flat(nodes))[0] == nodes
    df = newick.read_trees(spark.createDataFrame([(7, "((A:1,B:2):0.5,C:3);")], "tree_id long, value string"))
    got = {(r.a, r.b): r.distance for r in trees.distances(df).collect()}
    assert got[(2, 3)] == 3 and got[(2, 4)] == 4.5 and got[(0, 4)] == 3
    with pytest.raises(ValueError):
        newick.parse("(A:-1,B:1);")
    assert newick.parse("(A:-1,B:1);", negative="zero")[0][1]["length"] == 0


def test_large_tree(spark):
    rng = random.Random(9)
    parts = [str(i) for i in range(1, 101)]
    while len(parts) > 1:
        a, b = (parts.pop(rng.randrange(len(parts))) for _ in range(2))
        parts.append(f"({a}:{rng.random():.10g},{b}:{rng.random():.10g})")
    nodes = newick.parse(parts[0] + ";")[0]
    assert len(nodes) == 199 and sum(n["name"] != "" for n in nodes) == 100


def test_splits():
    names, splits = newick.parse_splits("a 'b c' d e: 0d3#2.5 (0,3) 0x6#1e-05;")
    assert names == ["a", "b c", "d", "e"] and splits == [(3, 2.5), (6, 1.0), (6, 1e-05)]
    assert newick.parse_splits(newick.write_splits(names, splits)) == (names, splits)
    kept, lost = trees.select_splits(5, [(0b00011, 5.0), (0b00110, 3.0), (0b11000, 4.0)])
    assert [m for m, _ in kept] == [0b00011, 0b11000] and [m for m, _ in lost] == [0b00110]
    tree, bad = trees.assemble(list("ABCDE"), kept)
    assert newick.write(tree) == "((A,B):5,C,(D,E):4);" and not bad


def test_accepted_splits_are_compatible():
    rng = random.Random(5)
    for _ in range(50):
        n = rng.randint(4, 9)
        splits = {(m := rng.randrange(1, 1 << n), min(m, (1 << n) - 1 - m))[1]: float(rng.randint(1, 5)) for _ in range(12)}
        kept, lost = trees.select_splits(n, list(splits.items()))
        assert len(kept) + len(lost) == len(splits)
        for (a, _), (b, _) in combinations(kept, 2):
            full = (1 << n) - 1
            assert not all(x & y for x in (a, full ^ a) for y in (b, full ^ b))


def test_hierarchy():
    text = annotation.HIERARCHIES["gff3", "gencode"]
    paths = annotation.parse_hierarchy(text)
    assert ("gene", "transcript", "CDS", "stop_codon_redefined_as_selenocysteine") in paths
    assert annotation.parse_hierarchy(annotation.show_hierarchy(paths)) == paths


def test_translations_are_checked(spark):
    f = spark.createDataFrame(
        [(1, "c", "+", 0, 0, 6, 0, "MA", None), (2, "c", "-", None, 0, 6, 0, "MA", None), (3, "c", "+", 0, 90, 6, 0, "MA", None)],
        "ord long, seq string, strand string, phase int, low long, length long, part int, translation string, table int",
    )
    r = spark.createDataFrame([("c", "ATGGCCTAA")], "name string, seq string")
    assert {x.ord for x in annotation.wrong_translations(f, r).collect()} == {2, 3}


def test_report_checks_translations(spark):
    cds, exon = ["gene", "CDS"], ["gene", "exon"]
    f = spark.createDataFrame(
        [
            (1, "right", cds, "c", "+", 0, 0, 6, 0, "MA*", None), (2, "wrong", cds, "c", "+", 0, 0, 3, 0, "MG", None), (2, "wrong", cds, "c", "+", 0, 3, 3, 1, "MG", None),
            (3, "exon", exon, "c", "+", 0, 0, 6, 0, "MG", None), (4, "none", cds, "c", "+", None, 0, 6, 0, None, None), (5, "lost", cds, "d", "+", 0, 0, 6, 0, "MA", None),
        ],
        "ord long, id string, path array<string>, seq string, strand string, phase int, low long, length long, part int, translation string, table int",
    )
    r = spark.createDataFrame([("c", "ATGGCCTAA")], "name string, seq string")
    assert sorted(map(tuple, annotation.report(f, r).collect())) == [
        ("sequences", "annotation->gene->CDS", "lost", "no sequence d"),
        ("translation", "annotation->gene->CDS", "wrong", "CDS on c [phase=0, intervals=2]: claimed translation does not match computed"),
    ]
    assert {x.check for x in catalogue.queries()["anno_report_translations"](spark, "/root/testdata/sf0.001").collect()} >= {"bounds", "translation"}


def test_external_command(spark):
    df = spark.createDataFrame([(str(i),) for i in range(25)], "value string").coalesce(1)
    assert [r.value for r in programs.run_command(df, ["cat"], 10).collect()] == [str(i) for i in range(25)]
    with pytest.raises(Exception, match="exited with"):
        programs.run_command(df, ["false"]).collect()


def test_register(spark):
    s = spark.createDataFrame([(3, 1.0), (3, 2.0), (5, 1.0)], "mask long, weight double")
    r = programs.Register().add(s).add(s).drop_below(4)
    assert [tuple(x) for x in r.splits.collect()] == [(3, 6.0)] and r.dropped.select(F.sum("weight")).first()[0] == 2


def slow_consensus(rows, window=7, branch=40, least=5):
    """The rules, column by column and window by window."""
    rows = [repeats.side_dashes(repeats.remove_tips("".join(c if c in "ACGT-" else "N" for c in r.upper())))[0] for r in rows]
    n = len(rows[0])
    cover = [sum(r[i] != " " for r in rows) for i in range(n)]
    best, out = [0] * n, ["n"] * n
    for i in range(n):
        column = [r[i] for r in rows]
        c = min(set(column), key=lambda x: (-column.count(x), x))
        if c == "-" and 100 * column.count(c) >= branch * cover[i]:
            best[i], out[i] = column.count(c), "-"
    for at in range(n - window + 1):
        words = [r[at : at + window] for r in rows if " " not in r[at : at + window]]
        if words:
            w = min(set(words), key=lambda x: (-words.count(x), x))
            k = words.count(w)
            for i, c in enumerate(w, at):
                if k > best[i] and 100 * k >= branch * cover[i]:
                    best[i], out[i] = k, c.upper() if k >= least else c.lower()
    return "".join(out)


def test_consensus_against_the_rules(spark):
    rng = random.Random(8)
    groups = []
    for _ in range(25):
        base = "".join(rng.choice("ACGT") for _ in range(30))
        rows = []
        for _ in range(rng.randint(1, 9)):
            a, b = rng.randint(0, 22), rng.randint(0, 10)
            r = "".join("-" if rng.random() < 0.15 else rng.choice("acgtN") if rng.random() < 0.1 else c for c in base)
            rows.append("-" * a + r[a : len(r) - b] + "-" * b if a + b < 30 else r)
        groups.append(rows)
    df = spark.createDataFrame([(g, i, s) for g, rows in enumerate(groups) for i, s in enumerate(rows)], "group long, row long, seq string")
    assert {r.group: r.consensus for r in repeats.consensus(df).collect()} == {g: slow_consensus(rows) for g, rows in enumerate(groups)}
    for bad in ([(0, 0, "ACGTACGT"), (0, 1, "ACG")], [(0, 0, "ACG")]):
        with pytest.raises(Exception, match="different lengths|longer than"):
            repeats.consensus(spark.createDataFrame(bad, "group long, row long, seq string")).collect()
    with pytest.raises(ValueError):
        repeats.ConsensusSettings(min_branch_threshold=101)


def test_names_of_products_must_match(spark):
    m = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0)], "row string, col string, value double")
    n = spark.createDataFrame([("x", "p", 3.0), ("z", "p", 1.0)], "row string, col string, value double")
    with pytest.raises(Exception, match="different names"):
        matrix.times_matrix(m, n).collect()
    assert matrix.times_matrix(m, n.replace("z", "y")).first().value == 5
    v = spark.createDataFrame([("x", 2.0)], "col string, value double")
    with pytest.raises(Exception, match="entries"):
        matrix.times_vector(m, v).collect()
    assert matrix.times_vector(m, v, sparse=True).first().value == 2
    with pytest.raises(Exception, match="entries"):
        matrix.times_vector(m, v.replace("x", "q"), sparse=True).collect()


def test_hierarchy_notation():
    paths = annotation.parse_hierarchy("(gene ((mRNA (exon, CDS)))), pseudogene, (region)")
    assert paths == [("gene",), ("gene", "mRNA"), ("gene", "mRNA", "exon"), ("gene", "mRNA", "CDS"), ("pseudogene",), ("region",)]
    assert annotation.show_hierarchy(paths) == "(gene ((mRNA (exon, CDS)))), pseudogene, region"
    assert annotation.children_of(paths, ("gene", "mRNA")) == ["exon", "CDS"] and annotation.find_type(paths, "CDS") == [("gene", "mRNA", "CDS")]
    for bad in ("", "(gene", "(gene mRNA)", "gene mRNA", "gene,", "(gene ())", "gene)"):
        with pytest.raises(ValueError):
            annotation.parse_hierarchy(bad)


def test_deep_features_and_rings(spark):
    rows = [(i, "gene", f"f{i}", f"f{i - 1}" if i else None) for i in range(40)]
    df = spark.createDataFrame(rows, "n long, type string, id string, parent string")
    assert annotation.place(df).where("size(path) = 40").count() == 1
    ring = spark.createDataFrame([(0, "gene", "a", "b"), (1, "gene", "b", "a")], "n long, type string, id string, parent string")
    with pytest.raises(ValueError, match="without its parent"):
        annotation.place(ring)


def test_report_can_fail(spark):
    f = spark.createDataFrame([(1, "x", ["gene"], "d", 0, 6)], "ord long, id string, path array<string>, seq string, low long, length long")
    r = spark.createDataFrame([("c", "ATGGCCTAA")], "name string, seq string")
    with pytest.raises(ValueError, match="no sequence d"):
        annotation.validate(f, r, fail=True)
    assert annotation.validate(f, r).count() == 1


def test_multisets(spark):
    df = spark.createDataFrame([(x,) for x in (3.0, -1.0, 3.0, 2.0, 7.0)], "x double")
    f = statistics.frequencies(df, "x")
    assert sorted(r.value for r in statistics.expand(f, 1).collect()) == [-1.0, 2.0, 3.0, 3.0, 7.0] == statistics.to_array(f).first()["values"]
    assert [statistics.median(df.where(w), "x").first().median for w in ("x > 0", "true", "x > 9")] == [3.0, 3.0, 0.0]
    assert statistics.median(df.where("x <> 3"), "x", whole=True).first().median == 2
    by = df.selectExpr("x", "x > 2 as big").union(spark.createDataFrame([(None, None)], "x double, big boolean"))
    assert {r.big: r.median for r in statistics.median(by, "x", "big").collect()}[True] == 3.0
    one = statistics.spreads(f.where("value = 7")).first()
    assert one.variance == 0 and one.sample_variance == 0 and one.sample_sd_abs == 0
    with pytest.raises(ValueError):
        statistics.threshold(f, 1.5)
    with pytest.raises(Exception, match="negative"):
        statistics.threshold(f, 0.5).collect()


def test_collections_fail_loudly(spark):
    from strandlake.functions import collections as co

    x = spark.createDataFrame([([1, 2], [3], {"a": 1})], "a array<int>, b array<int>, m map<string,int>")
    a, b = F.col("a"), F.col("b")
    for bad in (co.map2(a, b, lambda p, q: p + q), co.add_at(a, F.lit(2), F.lit(1)), co.replace_part(b, F.lit(0), a), co.top(F.slice(a, 1, 0)), co.pop(F.slice(a, 1, 0))):
        with pytest.raises(Exception, match="arrays|place|outside|empty"):
            x.select(bad).collect()
    assert x.select(co.map2i(a, a, lambda i, p, q: i + p * q).alias("r")).first().r == [1, 5]
    assert x.select(co.find_next(F.col("m"), F.lit("a")).alias("r")).first().r is None
    assert x.select(co.multimap_split(F.create_map(F.lit(1), a, F.lit(5), b), F.lit(5)).alias("r")).first().r.asDict() == {"below": {1: [1, 2]}, "at": [3], "above": {}}


def encode_text(text: str, tokens: dict[str, int], unknown: str = "split") -> list[list[int]]:
    """Ids of the longest dictionary tokens, left to right, in segments."""
    longest, out, i = max(map(len, tokens), default=0), [[]], 0
    while i < len(text):
        for n in range(min(longest, len(text) - i), 0, -1):
            if (t := tokens.get(text[i : i + n])) is not None:
                out[-1].append(t)
                i += n
                break
        else:
            if unknown == "error":
                raise ValueError(f"unknown character at {i} of {text!r}")
            if unknown == "split" and out[-1]:
                out.append([])
            i += 1
    return [x for x in out if x]


def test_text_spectrum_against_the_encoder(spark):
    tokens = ["the", "he", "and", "an", " ", "t"]
    texts = ["The hand and the tan", None, "xx the?then", ""]
    want = {}
    for t in texts:
        for seg in encode_text((t or "").lower(), {w: i for i, w in enumerate(tokens)}):
            for i in range(len(seg) - 1):
                k = f"{seg[i]}-{seg[i + 1]}"
                want[k] = want.get(k, 0) + 1
    got = kmers.text_spectrum(spark.createDataFrame([(t,) for t in texts], "text string"), tokens, 2)
    assert {r.kmer: r.weight for r in got.collect()} == want
    rng = random.Random(8)
    letters = "ab.\\^é\x01\n𝒳"
    make = lambda n: "".join(rng.choice(letters[:-2] if n < 6 else letters) for _ in range(n))
    tokens = list({make(rng.randint(1, 5)) for _ in range(40)})
    df = spark.createDataFrame([(make(rng.randint(6, 300)),) for _ in range(30)], "text string")
    for unknown, k in (("split", 3), ("ignore", 1)):
        want = {}
        for (text,) in df.collect():
            for seg in encode_text(text, {w: i for i, w in enumerate(tokens)}, unknown):
                for i in range(len(seg) - k + 1):
                    key = "-".join(map(str, seg[i : i + k]))
                    want[key] = want.get(key, 0) + 1
        assert {r.kmer: r.weight for r in kmers.text_spectrum(df, tokens, k, unknown=unknown, case_sensitive=True).collect()} == want
    with pytest.raises(Exception, match="unknown"):
        kmers.text_spectrum(df, ["a"], 1, unknown="error").collect()
    assert kmers.text_spectrum(df, [], 1).count() == 0


def test_components_of_a_star_and_a_chain(spark):
    from strandlake.plans import tables

    edges = [(5, 1000 + i) for i in range(300)] + [(i, i + 1) for i in range(2000, 2040)] + [(7, 7)]
    got = {r.id: r.component for r in tables.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {5: 5, **{1000 + i: 5 for i in range(300)}, **{i: 2000 for i in range(2000, 2041)}}


def test_ranges_do_not_depend_on_reused_exchanges(spark):
    """Ranges are sampled whenever rows are dealt to them; running sums must not mix two samplings."""
    n = 4_000_001
    df = spark.range(n).select(F.col("id").alias("x"))
    freq = df.select(F.col("x").alias("value"), F.lit(1).cast("long").alias("freq"))
    groups = spark.range(400_001).select(F.col("id").alias("x"), (F.col("id") % 3).alias("g"))
    before = spark.conf.get("spark.sql.exchange.reuse")
    try:
        for reuse in ("true", "false"):
            spark.conf.set("spark.sql.exchange.reuse", reuse)
            assert statistics.median(df, "x").first()[0] == 2_000_000
            assert statistics.threshold(freq, 0.5).where("value > 0").agg(F.sum("freq")).first()[0] == 2_828_427
            assert {r.g: r.median for r in statistics.median(groups, "x", "g").collect()} == {0: 199_999.5, 1: 200_000.5, 2: 200_000.0}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
    assert statistics.mad(groups, "x").agg(F.max("value"), F.sum("freq")).first() == (200_000.0, 400_001)


def test_median_of_groups_with_nulls(spark):
    df = spark.createDataFrame([(None, 4), (None, 8), ("a", 1), ("a", None), ("b", None)], "g string, x int")
    assert {r.g: r.median for r in statistics.median(df, "x", "g").collect()} == {None: 6.0, "a": 1.0, "b": 0.0}
    assert statistics.median(df.limit(0), "x").collect()[0][0] == 0.0


def test_intervals_from_chunks(spark):
    rng = random.Random(6)
    seqs = {"a": "".join(rng.choices("ACGT", k=1000)), "b": "ACGTN", "empty": "", "é": "éñACGT" * 30}
    reference = spark.createDataFrame(list(seqs.items()), "name string, seq string")
    assert {len(r.piece) for r in intervals.chunked(reference, 64).collect()} <= set(range(65))
    rows = [(i, n, lo := rng.randint(0, len(seqs[n])), rng.randint(0, len(seqs[n]) - lo), rng.choice("+-"), "x") for i, n in enumerate(rng.choices(list(seqs), k=300))]
    rows += [(900, "a", 0, 1000, "+", "x"), (901, "a", 1000, 0, "-", "x"), rows[0]]
    df = spark.createDataFrame(rows, "i int, seq string, low long, length long, strand string, size string").repartition(3)
    turned = {"A": "T", "C": "G", "G": "C", "T": "A"}

    def plain(r):
        s = seqs[r[1]] if r[4] == "+" else "".join(turned.get(c, c) for c in reversed(seqs[r[1]]))
        return s[r[2] : r[2] + r[3]]

    for size in (7, 64, intervals.CHUNK):
        got = intervals.fetch(df, reference, size=size)
        assert got.columns == [*df.columns, "slice"]
        assert sorted(map(tuple, got.collect())) == sorted((*r, plain(r)) for r in rows)
    for bad in [(1, "none", 0, 1, "+", "x"), (1, "a", 999, 2, "+", "x"), (1, "a", -1, 2, "+", "x"), (1, None, 0, 1, "+", "x")]:
        wrong = spark.createDataFrame([bad, rows[0]], df.schema)
        with pytest.raises(Exception, match="no sequence|out of bounds"):
            intervals.fetch(wrong, reference).collect()
        assert intervals.fetch(wrong, reference, strict=False).count() == 1
    assert intervals.fetch(df.limit(0), reference).count() == 0


def test_interval_joins(spark):
    rng = random.Random(7)
    make = lambda n: [(f"s{rng.randint(0, 2)}", rng.randint(0, 400), rng.choice([0, 1, 5, 40, 300]), i) for i in range(n)]
    a, b = make(120), [*make(80), (None, 3, 5, 99)]
    schema = "seq string, low long, length long, bin int"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    real = [(x, y) for x in a for y in b if x[0] == y[0] and x[2] and y[2]]
    over = sorted((x, y) for x, y in real if x[1] < y[1] + y[2] and y[1] < x[1] + x[2])
    within = sorted((x, y) for x, y in real if x[1] <= y[1] and y[1] + y[2] <= x[1] + x[2])
    for size in (8, 64, 4096):
        assert sorted((tuple(r.a), tuple(r.b)) for r in intervals.interval_join(left, right, "overlaps", size).collect()) == over
        assert sorted((tuple(r.a), tuple(r.b)) for r in intervals.interval_join(left, right, "contains", size).collect()) == within
    depth = {}
    for s, lo, n, _ in a:
        for i in range(lo, lo + n):
            depth[s, i] = depth.get((s, i), 0) + 1
    got = {(r.seq, i): r.depth for r in intervals.coverage(left).collect() for i in range(r.low, r.low + r.length)}
    assert got == depth


def test_translations_of_long_references(spark):
    """A feature over several chunks, in pieces, on both strands."""
    rng = random.Random(3)
    seq = "".join(rng.choices("ACG", k=400))  # no T, so no stop codons
    reference = spark.createDataFrame([("c", seq, 11)], "name string, seq string, table_id int")
    two = seq[10:100] + seq[200:290]
    turned = two[::-1].translate(str.maketrans("ACGT", "TGCA"))
    made = lambda s, table: spark.createDataFrame([(s,)], "s string").select(sq.translate(F.col("s"), table, 0, True)).first()[0]
    rows = [(1, "c", "+", 0, 10, 90, 0, made(two, 11), None), (1, "c", "+", 0, 200, 90, 1, made(two, 11), None), (2, "c", "-", 0, 10, 90, 0, made(turned, 2), 2), (2, "c", "-", 0, 200, 90, 1, made(turned, 2), 2)]
    rows += [(3, "c", "+", 0, 10, 90, 0, "MA", None), (4, "c", "+", 0, 350, 90, 0, "MA", None), (5, "d", "+", 0, 0, 3, 0, "MA", None)]
    f = spark.createDataFrame(rows, "ord int, seq string, strand string, phase int, low long, length long, part int, translation string, table int")
    for chunk in (16, 1 << 16):
        got = {r.ord: r.made for r in annotation.wrong_translations(f, reference, chunk=chunk).collect()}
        assert set(got) == {3, 4} and got[4] is None


@pytest.mark.parametrize("size", [4, 256])
def test_matrix_product_by_tiles(spark, size):
    rng = random.Random(size)
    cell = lambda: rng.choice([rng.randint(-9, 9) / 2, 0.0, None])
    a = {(f"r{i}", f"k{k}"): cell() for i in range(23) for k in range(40) if rng.random() < 0.3 or i == 0}
    b = {(f"k{k}", f"c{j}"): cell() for k in range(40) for j in range(9) if rng.random() < 0.3 or j == 0}
    a["r3", "k7"] = float("inf")
    make = lambda m: spark.createDataFrame([(*k, v) for k, v in m.items()], "row string, col string, value double")
    want = {}
    for (r, k), x in a.items():
        for j in range(9):
            y = b.get((k, f"c{j}"))
            if x is not None and y is not None:
                want[r, f"c{j}"] = want.get((r, f"c{j}"), 0.0) + x * y
    got = {(r.row, r.col): r.value for r in matrix.times_matrix(make(a), make(b), size).collect()}
    assert set(got) == set(want)
    assert {c: str(v + 0.0) for c, v in got.items()} == {c: str(v + 0.0) for c, v in want.items()}
    with pytest.raises(Exception, match="different names"):
        matrix.times_matrix(make(a), make({**b, ("other", "c0"): 1.0}), size).collect()


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_neighbour_join(spark, radius):
    rng = random.Random(radius)
    make = lambda n: ["".join(rng.choice("abñ") for _ in range(rng.randrange(0, 8))) for _ in range(n)]
    a, b = make(90), [*make(90), None]

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, old = [i], row
            for j, e in enumerate(y, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != e)))
        return row[-1]

    frame = lambda ws: spark.createDataFrame([(w, 1) for w in ws], "word string, n int")
    got = [tuple(r) for r in neighbours.neighbour_join(frame(a), frame(b), radius).collect()]
    want = {(x, y, distance(x, y)) for x in a for y in b if y is not None and distance(x, y) <= radius}
    assert len(got) == len(want) and set(got) == want

"""License scans, spelling variants and the filter audit against plain scans, on tables with odd rows and on none."""

import itertools
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from strandlake.llm import audit, licenses, spelling
from strandlake.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id long, a long, template int, word string, part string, n long"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    words = [f"{x}{y}{z}" for x in ("stre", "pla", "cró", "bà") for y in ("nd", "ting", "lake") for z in ("er", "ed", "s", "ing", "Ñu")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    mit = licenses.TEMPLATES[10][1]
    texts = [None, "", " \t\n", "##", "ab cd ef gh", "AAAA " * 250, say(300), say(300), "x" * 300_000, say(40_000), mit, "mit license cc by, MIT  License"]
    texts += [say(rng.randrange(1, 260)) + rng.choice(["", " & more", "\nLicensed under CC BY-NC 4.0.", " Released under the MIT License."]) for _ in range(60)]
    texts += [texts[6], texts[6], texts[20]]
    langs = ["en", "fr", None, ""]
    rows = [(None if i == 8 else i, t, langs[i % 4], None, 0, 1, 2, 3, "w", "p", 4) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[6], rows[6], rows[1]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "", r.lang or "") for r in docs.select("doc_id", "text", "lang").collect()]


@pytest.fixture(scope="module")
def labels(spark):
    odd = [(6, 1, 0), (6, 0, 1), (7, 0, 0), (None, 1, 1), (12, None, None)]
    return spark.createDataFrame([*odd, *((i, i % 2, int(i % 5 == 0)) for i in range(20, 70))], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_spelling_variants", "op13_filter_audit"])
def test_query_and_sql(spark, duck, name):
    got = queries()[name](spark, SF)
    want = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


# ---- licenses -------------------------------------------------------------------------------------------------------


def license_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))


def plain_scan(text, s=licenses.Settings()):
    ws = license_words(text)
    places = [(i, x) for p, x in licenses.PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    best, held = 0.0, set()
    at = {}
    for i in range(len(ws) - s.k + 1):
        at.setdefault(tuple(ws[i : i + s.k]), []).append(i)
    for label, t in licenses.TEMPLATES:
        tw = license_words(t)
        diagonals = sorted({p - j for j in range(len(tw) - s.k + 1) for p in at.get(tuple(tw[j : j + s.k]), ())})
        spans, start, before = {}, None, None
        for d in diagonals:
            start = d if before is None or d - before > s.drift else start
            before = d
            spans.setdefault((start, (d - start) // s.width), []).append(d)
        for ds in spans.values():
            share = sum(any(0 <= i + d < len(ws) and ws[i + d] == w for d in ds) for i, w in enumerate(tw)) / len(tw)
            best = max(best, share)
            if share >= s.similarity:
                held.add(label)
    base = {x for _, x in places}
    first, last = (min(places)[0], max(places)[0]) if places else (None, None)
    return (len(ws), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | held)), 1.0 if places else best)


def test_license_scan(docs, rows):
    got = sorted(map(tuple, licenses.licenses_query(docs).collect()), key=repr)
    assert got == sorted(((i, *plain_scan(t)) for i, t, _ in rows), key=repr)
    assert {"cc-by,cc-by-nc", "mit", "cc-by,mit"} <= {r[6] for r in got}
    assert licenses.licenses_query(docs.limit(0)).count() == 0


def test_license_spans_of_edited_copies(spark):
    rng = random.Random(5)
    filler = [f"w{i}" for i in range(500)]
    rows, want = [], []
    for i, (label, text) in enumerate(licenses.TEMPLATES):
        ws = license_words(text)
        if len(ws) < 20:
            continue
        cut = ws[: len(ws) // 3] + ["extra"] + ws[len(ws) // 3 : 2 * len(ws) // 3] + ws[2 * len(ws) // 3 + 1 :]
        before, after = rng.sample(filler, 30), rng.sample(filler, 30)
        rows.append((i, " ".join([*before, *cut, *after])))
        want.append((label, i, 30, 30 + len(cut), (len(ws) - 1) / len(ws)))
        rows.append((100 + i, " ".join([*before, *ws[: len(ws) // 2], *after])))  # half a license is none
        rows.append((200 + i, " ".join(rng.choice(filler) for _ in range(200))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for small in (200_000, 0):
        spans = licenses.license_spans(docs, s=licenses.Settings(small=small)).where("share >= 0.8")
        # the boilerplate holds a shorter notice as well
        got = sorted(tuple(r) for r in spans.select("label", "template", "start", "end", "share").collect() if (r.label, r.template) in {w[:2] for w in want})
        assert got == sorted(want)
    with pytest.raises(ValueError):
        licenses.license_spans(docs, (("short", "two words"),))


# ---- spelling -------------------------------------------------------------------------------------------------------


def near(a, b):
    """One inserted, deleted or replaced code point apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_variants(counts, factor=2):
    by_key = {}
    for w in counts:
        for i in range(len(w)):
            by_key.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        by_key.setdefault(w, set()).add(w)
    links = {w: set() for w in counts}
    for group in by_key.values():
        for a, b in itertools.combinations(group, 2):
            if near(a, b):
                links[a].add(b)
                links[b].add(a)
    form = {w: min(links[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: f if f and counts[f] >= factor * counts[w] else None for w, f in form.items()}
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(links[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def test_near_words(spark):
    rng = random.Random(2)
    ws = {"".join(rng.choice("abñ×ÿ") for _ in range(rng.randrange(1, 8))) for _ in range(700)} | {"", "a", "aa", "é"}
    vocabulary = spark.createDataFrame([(w, len(w)) for w in ws if w], "word string, n long").repartition(3)
    got = sorted(tuple(sorted((r.a, r.b))) for r in spelling.near_words(vocabulary).collect())
    assert got == sorted(tuple(sorted(p)) for p in itertools.combinations([w for w in ws if w], 2) if near(*p))


def test_group_variants(spark):
    rng = random.Random(8)
    counts = {}
    for _ in range(60):
        w = "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(5, 11)))
        n = 4096
        while n > 1:  # chains of misspellings of misspellings
            counts[w] = n
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :] if len(w) > 4 else w + "q", w[:i] + rng.choice("abcz") + w[i:], w[:i] + rng.choice("abcz") + w[i + 1 :]])
            n //= rng.choice([1, 2, 3])
    got = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr) == plain_variants(counts)


def test_spelling_query(docs, rows):
    counts = Counter()
    for i, t, _ in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t):
            r = lowered(r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 97 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            counts[r] += len(r) >= 5
    want = plain_variants({w: n for w, n in counts.items() if n >= 3})
    got = sorted(map(tuple, spelling.spelling_query(docs).collect()), key=repr)
    assert got == want and any(w[1] for w in want)
    assert spelling.spelling_query(docs.limit(0)).count() == 0


# ---- audit ----------------------------------------------------------------------------------------------------------


def test_filter_audit(docs, rows, labels):
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels.collect() if r.toxic == 1 and r.doc_id is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    fails = []
    for i, t, part in rows:
        ws = re.findall("[^\x20\x09-\x0d]+", t)
        bad = [len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and first[t] < i]
        fails.append((part, i, {x for x, b in zip("ABCDE", bad, strict=True) if b}))
    assert set().union(*(f for _, _, f in fails)) == set("ABCDE")
    want, shapley = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for p, _, _ in fails}:
            for step, x in enumerate(order, 1):
                gone = [(i, f) for p, i, f in fails if p == part and x in f and not f & set(order[: step - 1])]
                want[part, order, step] = (
                    sum(p == part and not f & set(order[:step]) for p, _, f in fails), len(gone), sum(p == part and x in f and bool(f & set(order[: step - 1])) for p, _, f in fails),
                    sum(p == part and f == {x} for p, _, f in fails), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                shapley[part, x] += len(gone)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit.audit_query(docs, labels).collect()}
    assert got == {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in want.items()}
    assert any(v[4] for v in got.values()) and any(v[5] for v in got.values())
    assert audit.audit_query(docs.limit(0), labels).count() == 0
    assert audit.audit_query(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0

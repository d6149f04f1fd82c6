"""Spelling variants by letter-parity masks.

Each word has a mask that holds, for each letter, whether it occurs an odd number of times. One inserted or deleted letter
flips one bit of the mask, one replaced letter two at most, so of three bands of the mask one at least is equal in two words
that are one edit apart. Such an edit also leaves either the first or the last half of the shorter word as it is, so equal
bands are joined within equal halves: what a band gathers, which alphabets and languages decide, stays a group of words that
look alike, however many words there are. What the join finds is cut by the mask's flipped bits and verified by the edit
distance inside the join: only links become rows, each once.

Defined cases: a null text holds no words and a null doc_id is written as nothing; rows that repeat count again; ties between
forms go to the smaller word in code-point order; an empty table gives an empty result; columns beside doc_id and text
are not read. Words of any length are taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import ascii_lower, remove, written

#: Bits of a mask, and the bands they are dealt to in turn, so that neighbouring letters are in different bands.
BITS, BANDS = 60, 3
BAND_MASKS = tuple(sum(1 << b for b in range(i, BITS, BANDS)) for i in range(BANDS))


@dataclass(frozen=True)
class Settings:
    min_length: int = 5  # code points of a word
    min_count: int = 3  # its occurrences
    factor: int = 2  # a form occurs so many times as often as its variant, at least


def runs(text: Column) -> Column:
    """The maximal runs of letters, A-Z lower-cased; an empty string may stand at either end."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[^a-zÀ-ÿ]+")


def parity_mask(word: Column) -> Column:
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % BITS)
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: F.when(c == "", m).otherwise(m.bitwiseXOR(bit(c))))


def _keyed(vocabulary: DataFrame) -> DataFrame:
    """A row for each word, role (0: the shorter word of a pair or one of two of equal length, 1: the longer one), half and
    band: kind (band, half and length of the shorter word), anchor (the half's letters), band, and the word's own columns."""
    half = F.floor(F.col("length") / 2).cast("int")
    out = vocabulary.select("word", "n", F.length("word").alias("own"), parity_mask(F.col("word")).alias("mask"))
    out = out.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("role")).withColumn("length", F.col("own") - F.col("role")).where("length > 0")
    first, last = F.substring("word", F.lit(1), half), F.substring("word", F.col("own") - F.col("length") + half + 1, F.col("length") - half)
    out = out.select("*", F.posexplode(F.array(first, last)).alias("half", "anchor"), first.alias("head"))
    bands = F.array(*(F.col("mask").bitwiseAND(F.lit(m)) for m in BAND_MASKS))
    out = out.select("*", F.posexplode(bands).alias("i", "band"))
    return out.select(((F.col("length") * 2 + F.col("half")) * BANDS + F.col("i")).alias("kind"), "anchor", "band", "word", "n", "mask", "role", "half", "i", "head")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: every pair of words of vocabulary (word, n; words once each) that one inserted, deleted or replaced
    code point apart, each pair once.

    A pair that several bands or both halves bring together is taken at the first of them.
    """
    keyed = _keyed(vocabulary.select("word", "n"))
    x = keyed.where("role = 0").select("kind", "anchor", "band", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("mask").alias("a_mask"), F.col("head").alias("a_head"))
    y = keyed.select("kind", "anchor", "band", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("mask").alias("b_mask"), F.col("head").alias("b_head"), "role", "half", "i")
    flipped = F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    first_band = F.lit(True)
    for j, m in enumerate(BAND_MASKS[:-1]):
        first_band = first_band & ((F.col("i") <= j) | (flipped.bitwiseAND(F.lit(m)) != 0))
    pairs = x.join(y, ["kind", "anchor", "band"]).where(
        (F.bit_count(flipped) <= 2 - F.col("role")) & ((F.col("role") == 1) | (F.col("a") < F.col("b")))
        & first_band & ((F.col("half") == 0) | (F.col("a_head") != F.col("b_head"))) & (F.levenshtein("a", "b", 1) == 1))
    return pairs.select("a", "a_n", "b", "b_n")


def follow(forms: DataFrame) -> DataFrame:
    """word, root for every word of forms (word, form) that has a form: the last one reached from form to form, by doubling.

    Chains that end are asked for; a table of 2 ** k steps is joined with itself in round k.
    """
    now = written(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while not now.join(now.select(F.col("word").alias("root")), "root", "left_semi").isEmpty():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = written(now.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "spelling-roots")
        remove(now)
        now = after
    return now


def group_variants(vocabulary: DataFrame, s: Settings = Settings()) -> DataFrame:
    """word, n, n_near, form, form_n, root for every row of vocabulary (word, n), words once each.

    A word's form is its most frequent near word, if that occurs `factor` times as often at least; its root is where forms
    lead. Forms occur ever more often, so they lead nowhere back.
    """
    pairs = near_words(vocabulary)
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = pairs.select(F.explode(ways).alias("w")).groupBy("w.word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("w.near_n")).alias("minus"), "w.near")).alias("best"))
    large = -F.col("best.minus") >= s.factor * F.col("n")
    forms = vocabulary.join(best, "word", "left").select(
        "word", F.col("n").cast("long").alias("n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.minus")).cast("long").alias("form_n"))
    forms = written(forms, "spelling-forms")
    return forms.join(follow(forms), "word", "left").withColumn("root", F.coalesce("root", "word"))


def count_words(words: DataFrame, s: Settings = Settings()) -> DataFrame:
    """word, n of the words that are long and frequent enough, written; words: a column word, a row for each occurrence."""
    return written(words.where(F.length("word") >= s.min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= s.min_count), "spelling-words")


def typed_words(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """word: the runs of every text as the query's contract wants them, in one of 97 of which a letter is missing."""
    one = documents.select("doc_id", F.explode(runs(F.col("text"))).alias("run")).where(F.length("run") >= s.min_length)
    one = one.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return one.select(F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("run")).alias("word"))


def spelling_query(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of documents that is long and frequent enough."""
    return group_variants(count_words(typed_words(documents.select("doc_id", "text"), s), s), s).select("word", "form", "root", "n", "n_near", "form_n")


#: Checksums are taken byte by byte; near words meet at what is left when one letter is taken out at a place.
SPELLING_SQL = r"""
WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
run AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS r FROM documents),
counted AS (SELECT id, r, count(*) AS k FROM run WHERE length(r) >= 5 GROUP BY id, r),
bytes AS (SELECT r, k, list_reduce(list_transform(string_split(id || ':' || r, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END), lambda a, b: list_concat(a, b)) AS bs FROM counted),
summed AS (SELECT r, k, xor(list_reduce(bs, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, steps),
typed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, k FROM summed),
vocab AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
less AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
near AS MATERIALIZED (SELECT a.word, b.word AS near FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT l.word, v.word FROM less l JOIN vocab v ON v.word = l.rest UNION SELECT v.word, l.word FROM less l JOIN vocab v ON v.word = l.rest),
ranked AS (SELECT near.word, near.near, v.n, row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, near.near) AS place, count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN vocab v ON v.word = near.near),
forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 2 * v.n THEN r.near END AS form, CASE WHEN r.n >= 2 * v.n THEN r.n END AS form_n
    FROM vocab v LEFT JOIN ranked r ON r.word = v.word AND r.place = 1),
walk AS (SELECT word, form AS last, 1 AS depth FROM forms WHERE form IS NOT NULL
    UNION ALL SELECT w.word, f.form, w.depth + 1 FROM walk w JOIN forms f ON f.word = w.last WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(last, depth) AS root FROM walk GROUP BY word)
SELECT f.word, f.form, coalesce(r.root, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN roots r ON r.word = f.word
"""

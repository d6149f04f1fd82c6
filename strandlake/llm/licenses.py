"""License scans by diagonal voting.

Every k-gram of words of every text, as a hash with its place, is joined with the k-grams of license templates. A match is a
vote for a diagonal, the place in the text less the place in the template: a copy of a template is one diagonal, and a word
put in or left out moves it to a neighbouring one. Votes are aggregated by diagonal, neighbouring diagonals are merged to
spans, and each span is verified: the share of the template's words that stand at their places on the span's diagonals, the
very words, not hashes.

Only matches are shuffled, and they are counted for each text and diagonal before that. Templates are a parameter; their k-grams
are a bounded table (MAX_TEMPLATE_WORDS), which Spark may broadcast. Spans are written and counted: up to `small`
texts with spans they are broadcast to the texts, beyond that both are joined by the texts' hashes.

Defined cases: a null text is empty and has no words; rows that repeat are scanned each; texts of any length are taken whole;
a template of fewer than k words is an error; an empty table gives an empty result; columns beside doc_id and
text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import ascii_lower, identity, written

OUTSIDE = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Phrases of the contract and their labels: fixed values.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Templates, label and text: the published wordings of licenses and of the notices that name them; fixed values.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
        by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies.""",
    ),
    ("mit", "Released under the MIT License"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software.""",
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
)

#: Words of all templates together: the bound of the table of their k-grams.
MAX_TEMPLATE_WORDS = 1_000_000


@dataclass(frozen=True)
class Settings:
    k: int = 5  # words of a gram
    drift: int = 4  # diagonals that many apart at most are neighbours
    width: int = 64  # diagonals that a span takes in at most
    similarity: float = 0.8  # of a template's words that a span must hold
    small: int = 200_000  # texts with spans that may be broadcast


def joined_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with a blank between them."""
    return F.btrim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), OUTSIDE, " "))


def words_of(joined: Column) -> Column:
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def grams(words: Column, k: int) -> Column:
    """A hash for each k neighbouring words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.element_at(F.transform(F.array(hashes), lambda h: F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(h[i + j] for j in range(k)))))), 1)


def template_table(spark: SparkSession, templates=TEMPLATES, s: Settings = Settings()) -> DataFrame:
    """template (number), label, words."""
    table = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, label string, text string")
    table = table.select("template", "label", words_of(joined_words(F.col("text"))).alias("words"))
    sizes = table.agg(F.min(F.size("words")), F.sum(F.size("words"))).first()
    if templates and (sizes[0] < s.k or sizes[1] > MAX_TEMPLATE_WORDS):
        raise ValueError(f"templates need {s.k} words each and {MAX_TEMPLATE_WORDS} words together at most")
    return table


def votes(documents: DataFrame, table: DataFrame, s: Settings) -> DataFrame:
    """a, b (identity() of the row), template, diagonal, n, first (place in the text): matches of k-grams by diagonal."""
    known = table.select("template", F.posexplode(grams(F.col("words"), s.k)).alias("there", "gram"))
    rows = documents.select(identity().alias("x"), F.posexplode(grams(words_of(joined_words(F.col("text"))), s.k)).alias("place", "gram"))
    met = rows.join(F.broadcast(known), "gram").select("x.a", "x.b", "template", (F.col("place") - F.col("there")).alias("diagonal"), "place")
    return met.groupBy("a", "b", "template", "diagonal").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))


def merged(found: DataFrame, s: Settings) -> DataFrame:
    """a, b, template, span, diagonals (ascending), n: neighbouring diagonals of votes() as one span.

    A row starts a span if its diagonal is over `drift` from the one before; a span that grows beyond `width`
    diagonals goes on as another one. Within a text and template there is a row for each diagonal, so no window is larger than a text.
    """
    by = Window.partitionBy("a", "b", "template").orderBy("diagonal")
    x = found.withColumn("starts", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > s.drift, F.lit(True)))
    x = x.withColumn("island", F.max(F.when(F.col("starts"), F.col("diagonal"))).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    x = x.withColumn("span", F.col("island") + s.width * F.floor((F.col("diagonal") - F.col("island")) / s.width))
    return x.groupBy("a", "b", "template", "span").agg(F.array_sort(F.collect_set("diagonal")).alias("diagonals"), F.sum("n").alias("n"))


def verified(documents: DataFrame, spans: DataFrame, table: DataFrame, s: Settings) -> DataFrame:
    """a, b, label, template, start, end (words, end exclusive), share for each span: how much of the template it holds."""
    many = spans.select("a", "b").distinct()
    texts = documents.select(identity().alias("x"), "text").select("x.a", "x.b", "text")
    spans = spans.groupBy("a", "b").agg(F.collect_list(F.struct("template", "diagonals")).alias("spans"))
    spans = F.broadcast(spans) if many.count() <= s.small else spans
    rows = texts.join(spans, ["a", "b"]).select("a", "b", words_of(joined_words(F.col("text"))).alias("there"), "spans")
    rows = rows.select("a", "b", "there", F.explode("spans").alias("s")).select("a", "b", "there", "s.template", "s.diagonals")
    rows = rows.join(F.broadcast(table), "template")
    # the places of the text where a word of the template stands, by the template's words
    at = F.transform("words", lambda w, i: F.array_min(F.filter(F.transform("diagonals", lambda d: d + i), lambda p: (p >= 0) & (p < F.size("there")) & (F.get(F.col("there"), p) == w))))
    rows = rows.select("a", "b", "label", "template", F.size("words").alias("size"), F.array_compact(at).alias("at"))
    return rows.select("a", "b", "label", "template", F.array_min("at").alias("start"), (F.array_max("at") + 1).alias("end"), (F.size("at") / F.col("size")).alias("share")).distinct()


def license_spans(documents: DataFrame, templates=TEMPLATES, s: Settings = Settings()) -> DataFrame:
    """a, b (identity() of the row of documents: doc_id, text), label, template, start, end (words), share: every span that
    votes bring up, written; rows that repeat an id and a text have theirs once. A span holds its template if share >= similarity."""
    table = template_table(documents.sparkSession, templates, s)
    spans = written(merged(votes(documents, table, s), s), "license-spans")
    return written(verified(documents, spans, table, s), "license-found")


def phrase_places(documents: DataFrame) -> DataFrame:
    """doc_id, a, b, n_words, places (array of place and label) for every row of documents: where the words of PHRASES stand."""
    rows = documents.select("doc_id", identity().alias("x"), joined_words(F.col("text")).alias("joined"))
    padded = F.concat(F.lit(" "), F.col("joined"), F.lit(" "))
    none = F.array().cast("array<struct<place:int,label:string>>")

    def places(phrase: str, label: str) -> Column:
        """Words before the phrase's k-th occurrence: blanks in the pieces before it. Phrases do not overlap themselves."""
        pieces = F.split(padded, f" {phrase}(?= )", -1)
        blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
        step = len(phrase.split())
        sums = lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda a, x: a + blanks(x))
        return F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.struct((sums(i) + (i - 1) * step).cast("int").alias("place"), F.lit(label).alias("label")))

    found = F.concat(*(F.when(F.contains(padded, F.lit(f" {p} ")), places(p, x)).otherwise(none) for p, x in PHRASES))
    size = F.when(F.col("joined") == "", 0).otherwise(F.length("joined") - F.length(F.replace(F.col("joined"), F.lit(" "), F.lit(""))) + 1)
    return rows.select("doc_id", "x.a", "x.b", size.cast("long").alias("n_words"), found.alias("places"))


def licenses_query(documents: DataFrame, templates=TEMPLATES, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of documents.

    score is 1 where a phrase stands, else the largest share of a template that a span holds, 0 without one.
    """
    documents = documents.select("doc_id", "text")
    spans = license_spans(documents, templates, s)
    held = spans.groupBy("a", "b").agg(F.max("share").alias("share"), F.collect_set(F.when(F.col("share") >= s.similarity, F.col("label"))).alias("held"))
    rows = phrase_places(documents).join(held, ["a", "b"], "left")
    base = F.array_distinct("places.label")
    where = F.col("places.place")
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(where).cast("long").alias("first_word"), F.array_max(where).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("held", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def _quoted(text: str) -> str:
    return "'" + " ".join(text.split()).replace("'", "''") + "'"


LICENSES_SQL = (
    "WITH phrases(phrase, label) AS (VALUES " + ", ".join(f"({_quoted(p)}, {_quoted(x)})" for p, x in PHRASES) + "),\n"
    "given(template, label, text) AS (VALUES " + ", ".join(f"({i}, {_quoted(x)}, {_quoted(t)})" for i, (x, t) in enumerate(TEMPLATES)) + "),\n"
    + r"""t AS (SELECT template, label, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM given),
tg AS (SELECT template, i - 1 AS there, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS i FROM t)),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS MATERIALIZED (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
g AS MATERIALIZED (SELECT rid, i, word, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3, lead(word, 4) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
base AS (SELECT g.rid, g.i, p.label FROM g JOIN phrases p ON p.phrase = g.word || ' ' || g.w1 OR p.phrase = concat_ws(' ', g.word, g.w1, g.w2, g.w3)),
b AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM base GROUP BY rid),
v AS (SELECT DISTINCT g.rid, tg.template, g.i - tg.there AS diag FROM g JOIN tg ON tg.gram = g.word || ' ' || g.w1 || ' ' || g.w2 || ' ' || g.w3 || ' ' || g.w4),
s1 AS (SELECT *, coalesce(diag - lag(diag) OVER (PARTITION BY rid, template ORDER BY diag) > 4, true) AS starts FROM v),
s2 AS (SELECT *, max(CASE WHEN starts THEN diag END) OVER (PARTITION BY rid, template ORDER BY diag) AS island FROM s1),
spans AS (SELECT rid, template, list(diag) AS diags FROM s2 GROUP BY rid, template, island, (diag - island) // 64),
x AS (SELECT spans.rid, t.label, t.template, spans.diags, len(t.ws) AS size, unnest(t.ws) AS word, unnest(range(len(t.ws))) AS i FROM spans JOIN t USING (template)),
y AS (SELECT rid, label, template, diags, size, i, word, i + unnest(diags) AS at FROM x),
z AS (SELECT y.rid, y.label, count(DISTINCT y.i) / y.size::DOUBLE AS share FROM y JOIN w ON w.rid = y.rid AND w.i = y.at AND w.word = y.word GROUP BY y.rid, y.label, y.template, y.diags, y.size),
h AS (SELECT rid, max(share) AS share, list(DISTINCT label) FILTER (WHERE share >= 0.8) AS labels FROM z GROUP BY rid)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
    coalesce(array_to_string(b.labels, ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(h.labels, [])))), ','), '') AS labels,
    CASE WHEN b.n_base > 0 THEN 1.0 ELSE coalesce(h.share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN h USING (rid)
"""
)

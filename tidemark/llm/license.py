"""License scans by diagonal voting, in DataFrame functions only.

Word k-grams of a text, pairs for phrases and triples for longer templates, are joined with the templates' (a
fixed, small table) on the rolling hash of their first two words, and all their words are compared. A match
votes for its diagonal (text position minus template position); neighbouring diagonals are merged into bands
of `NEAR` + 1, which overlap, so that inserted or missing words do not split a span. A band is a place if the
k-grams that voted in it cover enough of the template's words, each position once: a text's repetitions count
once, and a band keeps them in order. A place of a phrase is one diagonal with all its pairs, so its words
stand consecutively: those are the base places.

Defined cases: null and empty texts have no words, no places, empty label strings and score 0; equal
rows get equal results, each kept; an empty table gives no rows; a very long text is cut into rows, one a
word, and counted by band; ties cannot arise, as labels are sets; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose consecutive words are a base place, with their labels. Fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Longer templates, each with the label it votes for: opening sentences of well-known public licence texts.
TEMPLATES = [
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-text", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-text", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("mit-notice", "licensed under the mit license"),
]
#: Diagonals this near belong to one band; a band must cover this share of a long template's words.
NEAR, COVER = 4, 0.9


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words, as an array."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _NOT_WORD), lambda w: w != "")


def _templates(spark: SparkSession) -> DataFrame:
    """One row a k-gram: its first two words and their hash, the third (null for phrases), its position, and the words a place needs."""
    rows = []
    for tid, (label, text, k) in enumerate([*((label, phrase, 2) for phrase, label in PHRASES.items()), *((label, text, 3) for label, text in TEMPLATES)]):
        w = text.split()
        need = len(w) if k == 2 else math.ceil(COVER * len(w))
        rows += [(tid, k == 2, label, len(w), need, at, f"{w[at]} {w[at + 1]}", w[at], w[at + 1], w[at + 2] if k == 3 else None) for at in range(len(w) - k + 1)]
    df = spark.createDataFrame(rows, "tid int, phrase boolean, label string, length int, need int, tpos int, two string, a string, b string, third string")
    return df.select("tid", "phrase", "label", "length", "need", "tpos", "two", "third", F.xxhash64("a", "b").alias("h"))


def places(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and, per place, the template's label, the band's lowest diagonal and the share of the template it covers."""
    spread = docs.select(*keys, words(F.col(text)).alias("w")).where(F.size("w") > 1)
    at = lambda i: F.get(F.col("w"), i)
    gram = F.transform("w", lambda x, i: F.struct(F.xxhash64(x, at(i + 1)).alias("h"), F.concat(x, F.lit(" "), at(i + 1)).alias("said"), at(i + 2).alias("next")))
    spread = spread.select(*keys, F.posexplode(gram).alias("pos", "g")).select(*keys, "pos", "g.h", "g.said", "g.next")
    t = F.broadcast(_templates(docs.sparkSession))  # a fixed table of a few hundred rows
    hits = spread.join(t, (spread["h"] == t["h"]) & (F.col("said") == F.col("two")) & (F.col("phrase") | (F.col("next") == F.col("third"))))
    diagonal = F.col("pos") - F.col("tpos")
    bands = F.when(F.col("phrase"), F.array(diagonal)).otherwise(F.sequence(diagonal - NEAR, diagonal))
    voted = hits.select(*keys, "tid", "phrase", "label", "length", "need", "tpos", F.explode(bands).alias("band"))
    counted = voted.groupBy(*keys, "tid", "phrase", "label", "length", "need", "band").agg(F.collect_set("tpos").alias("votes"))
    k = F.when(F.col("phrase"), 2).otherwise(3)
    told = F.size(F.array_distinct(F.flatten(F.transform("votes", lambda x: F.sequence(x, x + k - 1)))))
    counted = counted.withColumn("told", told)  # the template's words that voted
    return counted.where(F.col("told") >= F.col("need")).select(*keys, "phrase", "label", "band", (F.col("told") / F.col("length")).alias("cover"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels and score per row."""
    base = docs.select(F.col(key), F.col(text).alias("_t"))
    keyed = base.select(F.col(key), F.coalesce(F.col(key), F.lit(-1)).alias("_k"), F.xxhash64(F.coalesce("_t", F.lit(""))).alias("_s"), "_t")
    start = F.when(F.col("phrase"), F.col("band"))  # on one diagonal the template's first word stands there
    per = places(keyed, ["_k", "_s"], "_t").groupBy("_k", "_s").agg(
        F.count(start).alias("n_base"), F.min(start).cast("long").alias("first_word"), F.max(start).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("cover").alias("score"),
    )
    sized = keyed.select(key, "_k", "_s", F.size(words(F.col("_t"))).cast("long").alias("n_words"))
    out = sized.join(per, ["_k", "_s"], "left")
    zero, blank = F.lit(0).cast("long"), F.lit("")
    return out.select(key, "n_words", F.coalesce("n_base", zero).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", blank).alias("base_labels"), F.coalesce("labels", blank).alias("labels"),
                      F.coalesce("score", F.lit(0.0)).alias("score"))


def sql() -> str:
    """The same scan as DuckDB SQL over `documents`: texts and templates meet word by word, without hashes."""
    long = ", ".join(f"({k}, '{label}', string_split('{text}', ' '))" for k, (label, text) in enumerate(TEMPLATES))
    short = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in PHRASES.items())
    return rf"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
 t(doc_id, pos, word) AS (SELECT doc_id, unnest(range(len(w))), unnest(w) FROM d),
 phrases(label, p) AS (VALUES {short}),
 begins AS (SELECT t.doc_id, t.pos, label, p FROM t JOIN phrases ON t.word = p[1]),
 base AS (SELECT b.doc_id, label, b.pos FROM begins b JOIN d USING (doc_id) WHERE w[b.pos + 1 : b.pos + len(p)] = p),
 long(tid, label, p) AS (VALUES {long}),
 triples AS (SELECT tid, k AS tpos, p[k + 1] AS a, p[k + 2] AS b, p[k + 3] AS c FROM (SELECT *, unnest(range(len(p) - 2)) AS k FROM long)),
 said AS (SELECT doc_id, k AS pos, w[k + 1] AS a, w[k + 2] AS b, w[k + 3] AS c FROM (SELECT *, unnest(range(len(w) - 2)) AS k FROM d)),
 met AS (SELECT DISTINCT doc_id, tid, pos, tpos FROM said JOIN triples USING (a, b, c)),
 held AS (SELECT x.doc_id, x.tid, x.low, count(DISTINCT y.tpos + o.o) AS told
   FROM (SELECT DISTINCT doc_id, tid, pos - tpos AS low FROM met) x JOIN met y ON x.doc_id = y.doc_id AND x.tid = y.tid AND y.pos - y.tpos BETWEEN x.low AND x.low + {NEAR}, (VALUES (0), (1), (2)) o(o) GROUP BY 1, 2, 3),
 kept AS (SELECT doc_id, label, told::double / len(p) AS cover FROM held JOIN long USING (tid) WHERE told >= ceil({COVER}::double * len(p))),
 every AS (SELECT doc_id, label, pos, 1.0::double AS cover FROM base UNION ALL SELECT doc_id, label, NULL, cover FROM kept),
 per AS (SELECT doc_id, count(pos) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (pos IS NOT NULL) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM every GROUP BY 1)
 SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::double) AS score
 FROM d LEFT JOIN per ON per.doc_id = d.doc_id"""

"""Licence scans with DataFrame functions only: fixed phrases, and a containment join against templates.

Templates are looked for in overlapping runs of words, so it does not matter how a header is wrapped or
commented out.  The blocks of a template of w words are the runs of 2L words that begin at every L-th word,
L being the power of two that is w or just above: any L + 1 words in a row lie in one block.

The join is exact.  Template tokens are ordered by how often the corpus holds them, rarest first.
A block holds a template if it has o of its n distinct tokens: ceil(c * n) at a threshold of c, and all n
where they are fewer than ten, as short notices differ in a word.  Such a block must
hold one of the template's first n - o + 1 tokens (prefix filter), have at least o tokens that any template
knows (length filter), and have enough tokens left on both sides after the first common one (positional
filter).  What passes is counted on the full sets.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import keyed, table

# The phrases of the contract with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# The openings of licence notices as they are published, with their labels.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("proprietary", "All rights reserved. Unauthorized copying or distribution is prohibited"),
]
THRESHOLD = 0.8
#: Distinct tokens below which a template must be there whole.
SHORT = 10
#: Template tokens whose index is broadcast; the index of more is dealt out by token instead.
MAX_BROADCAST_TOKENS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Words before A-Z are lowered; lowering changes no word's extent.
#: The most frequent range stands first: a negated class takes fifteen times as long.
_CLASS = r"[a-z\x80-\x{10FFFF}A-Z0-9]"
_WORD = f"{_CLASS}+"


def _phrase(words: str) -> str:
    """The first character of each place where the words stand consecutively; (?i) folds A-Z only.

    The words are looked at but not consumed, so places may overlap.
    """
    return f"(?i)(?<!{_CLASS})(?=" + f"[{_SEP}]+".join(words.split()) + f"(?!{_CLASS})){_CLASS}"


def _word_count(text: Column | str) -> Column:
    return F.regexp_count(text, F.lit(_WORD)).cast("long")


def _places(text: str, words: str) -> Column:
    """How many places hold the phrase; the pattern only runs on texts that hold all its words as strings."""
    low = F.lower(text)  # folds at least A-Z
    held = reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in sorted(words.split(), key=len, reverse=True)])
    return F.when(held, F.regexp_count(text, F.lit(_phrase(words)))).otherwise(0).cast("long")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def needed(n: int, threshold: float) -> int:
    """Of a template's n distinct tokens, how many a block must hold."""
    return n if n < SHORT else math.ceil(round(threshold * n, 9))


def _template_sets(templates: list[tuple[str, str]]) -> list[tuple[str, int, list[str]]]:
    """(label, L, distinct tokens) of every template with words."""
    words = [(label, re.findall(r"[0-9a-z\x80-\U0010FFFF]+", text.translate(str.maketrans(_UPPER, _LOWER)))) for label, text in templates]
    return [(label, 1 << (len(w) - 1).bit_length(), sorted(set(w))) for label, w in words if w]


def _template_hits(spark: SparkSession, texts: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(_key, label, containment) of every block that holds enough of a template."""
    sets = _template_sets(templates)
    if not sets:
        return texts.select("_key", F.lit("").alias("label"), F.lit(0.0).alias("containment")).filter("false")
    tokens = sorted({t for _, _, own in sets for t in own})
    small = F.broadcast if len(tokens) <= MAX_BROADCAST_TOKENS else lambda frame: frame
    known = spark.createDataFrame([(t,) for t in tokens], "token string")
    seen = texts.select(F.explode(_words(F.col("text"))).alias("token")).join(small(known), "token").groupBy("token").count()
    counts = {r.token: r["count"] for r in seen.collect()}
    rank = {t: i for i, t in enumerate(sorted(tokens, key=lambda t: (counts.get(t, 0), t)))}
    by_token = spark.createDataFrame(list(rank.items()), "token string, r int")
    index, wanted = [], []
    for i, (label, length, own) in enumerate(sets):
        ranks, o = sorted(rank[t] for t in own), needed(len(own), threshold)
        wanted.append((i, label, ranks))
        index += [(length, ranks[p], i, p, len(ranks), o) for p in range(len(ranks) - o + 1)]
    prefix = spark.createDataFrame(index, "length int, r int, template int, i int, n int, o int")
    full = spark.createDataFrame(wanted, "template int, label string, ranks array<int>")
    firsts = {row[1] for row in index}
    rare = sorted(t for t, r in rank.items() if r in firsts)
    if len(rare) <= 500:
        # only texts with a token of some prefix go on; the alternation is cheaper than splitting every text
        texts = texts.filter(F.col("text").rlike(f"(?i)(?<!{_CLASS})(?:{'|'.join(map(re.escape, rare))})(?!{_CLASS})"))
    lengths = F.array(*[F.lit(n) for n in sorted({n for _, n, _ in sets})])
    at = texts.select("_key", F.posexplode(_words(F.col("text"))).alias("word", "token")).join(small(by_token), "token").select("_key", "word", "r", F.explode(lengths).alias("length"))
    own_block = F.floor(F.col("word") / F.col("length")).cast("int")
    held = at.select("_key", "length", "r", F.explode(F.array(own_block, own_block - 1)).alias("block")).filter("block >= 0")
    held = held.groupBy("_key", "length", "block").agg(F.array_sort(F.collect_set("r")).alias("own"))
    probes = held.select("_key", "length", "block", "own", F.posexplode("own").alias("j", "r")).join(small(prefix), ["length", "r"])
    probes = probes.filter(F.size("own") >= F.col("o"))
    first = probes.groupBy("_key", "block", "template").agg(F.min("i").alias("i"), F.min("j").alias("j"), F.first("own").alias("own"), F.first("n").alias("n"), F.first("o").alias("o"))
    first = first.filter(1 + F.least(F.col("n") - F.col("i") - 1, F.size("own") - F.col("j") - 1) >= F.col("o"))
    both = first.join(small(full), "template").withColumn("both", F.size(F.array_intersect("own", "ranks"))).filter("both >= o")
    return both.select("_key", "label", (F.col("both") / F.col("n")).alias("containment"))


def license_scan(
    spark: SparkSession, docs: DataFrame, *, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None,
    threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Fixed phrases and contained templates in every whole text.

    Words are runs of letters, digits and non-ASCII characters, A-Z lowered.  Returns id, n_words, n_base (places
    where a phrase's words stand consecutively), first_word and last_word (their smallest and largest start, or null), base_labels, labels
    (with those of templates that some block of words holds ``threshold`` of, or all of a short one) and score (the greatest such
    share, else 0).  A null text is empty; null or repeated ids give a row each; an empty table gives none; other columns are ignored.
    Long texts are read whole; with no templates, labels are the base ones and scores 0.
    """
    phrases, templates = phrases or PHRASES, TEMPLATES if templates is None else templates
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = keyed(spark, chosen, "id", "text")
    own_id = F.col("id" if "id" in base.columns else "_key")
    counted = base.select(
        "_key", own_id.alias("id"), "text", _word_count("text").alias("n_words"),
        *[_places("text", p).alias(f"n{i}") for i, p in enumerate(phrases)],
    )
    any_phrase = "|".join(f"(?:{_phrase(p)})" for p in phrases)
    n_base = reduce(add, [F.col(f"n{i}") for i in range(len(phrases))])
    before_first = F.substring("text", F.lit(1), F.regexp_instr("text", F.lit(any_phrase)) - 1)
    before_last = F.regexp_extract("text", f"(?s)^(.*)(?:{any_phrase})", 1)
    found = F.array_compact(F.array(*[F.when(F.col(f"n{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())]))
    counted = counted.select(
        "_key", "id", "n_words", n_base.alias("n_base"), F.when(n_base > 0, _word_count(before_first)).alias("first_word"),
        F.when(n_base > 0, _word_count(before_last)).alias("last_word"), F.array_sort(F.array_distinct(found)).alias("base"),
    )
    hits = _template_hits(spark, base.select("_key", "text"), templates, threshold)
    hits = hits.groupBy("_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("score"))
    out = counted.join(hits, "_key", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        "id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark, table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _op4_sql() -> str:
    tokens = ", ".join(f"({i}, '{label}', {length}, '{t}', {len(own)}, {needed(len(own), THRESHOLD)})" for i, (label, length, own) in enumerate(_template_sets(TEMPLATES)) for t in own)
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{word}') AS w FROM documents
), phrases(p, label) AS (VALUES {phrases}),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
trip AS (
  SELECT doc_id, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), places AS (
  SELECT doc_id, i, label FROM trip JOIN phrases ON p = word || ' ' || w2 OR p = word || ' ' || w2 || ' ' || w3
), base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY doc_id
), tokens(template, label, length, token, n, o) AS (VALUES {tokens}),
blocks AS (
  SELECT doc_id, template, label, n, o, word, unnest([i // length, i // length - 1]) AS block FROM words JOIN tokens ON word = token
), hits AS (
  SELECT doc_id, label, count(DISTINCT word) / n AS c FROM blocks WHERE block >= 0 GROUP BY doc_id, block, template, label, n, o HAVING count(DISTINCT word) >= o
), found AS (
  SELECT doc_id, list_distinct(list(label)) AS more, max(c) AS score FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more, [])))), ','), '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""


OP4_SQL = _op4_sql()

"""License notices in texts, by an exact set-similarity join with templates.

A text is cut into blocks: for a template of w words (raised to a power of
two) the 2w words from each multiple of w, so that any w words in a row are
inside one block. A block meets a template when it holds at least PERCENT per
cent of the template's distinct tokens. The join finds every such pair:

* tokens are ordered by how often the whole corpus has them, rarest first;
* prefix filter: with a tokens needed of |T|, one of the |T| - a + 1 rarest of
  the template must be in the block. Only words of these prefixes anchor blocks;
* length filter: a block with fewer than a tokens of any template can't meet it;
* positional filter: tokens before the first shared one don't count, so that
  1 + the fewer of those that follow it, in template and block, must reach a;
* what is left is verified on the whole token sets.

Phrases, words that stand consecutively, are looked up at the same anchors.
The templates are literals of the plan (MOST_TOKENS at most), a row's blocks
are joined inside the row by array functions: nothing is shuffled but the
counts of template tokens, and no group of equal texts can be hot.

Defined results
* null text counts as empty: no words, no labels, score 0;
* repeated rows and ids are rows of their own; an empty table gives no rows;
* only A-Z are lower-cased; labels are distinct, sorted, joined by commas, ''
  where there are none; the place of ties in frequency is by the token;
* the score is the greatest share of a template found, 1 with any phrase;
* other columns, whatever their names, are ignored by `scan`; `with_blocks` adds
  `words`, `phrases` and `blocks` beside a struct of the caller's row.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

#: Phrases and the labels they give.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Sentences that public licenses are known by.
TEMPLATES = (
    ("agpl-3.0", "GNU Affero General Public License, version 3"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Share of a template's tokens a block must hold; tokens that all templates together may have, as each task has them.
PERCENT, MOST_TOKENS = 90, 50_000
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _tokens(text: str) -> list[str]:
    return [w for w in re.split(SEPARATOR, "".join(c.lower() if c in string.ascii_uppercase else c for c in text)) if w]


def words(column: str = "text") -> Column:
    """Words of a text in order."""
    lowered = F.translate(text_or_empty(column), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATOR), "")


@dataclass(frozen=True)
class Template:
    label: str
    tokens: tuple[str, ...]  # distinct, rarest first
    width: int  # a block has twice as many words
    need: int

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.tokens[: len(self.tokens) - self.need + 1]


def frequencies(docs: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How often the corpus has each of the tokens: one row a token comes to the driver."""
    rows = docs.select(F.explode(words()).alias("token")).where(F.col("token").isin(sorted(tokens))).groupBy("token").count()
    return dict(rows.collect())


def prepared(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> tuple[list[Template], list[str]]:
    """Templates with their tokens in the corpus's order of frequency, and all tokens in that order."""
    split = [(label, _tokens(text)) for label, text in templates]
    vocabulary = {t for _, ts in split for t in ts}
    if len(vocabulary) > MOST_TOKENS:
        raise ValueError(f"templates with more than {MOST_TOKENS} tokens")
    often = frequencies(docs, vocabulary)
    order = lambda t: (often.get(t, 0), t)
    sets = [(label, tuple(sorted(set(ts), key=order)), len(ts)) for label, ts in split if ts]
    return [Template(label, ts, 1 << (n - 1).bit_length(), max(1, -(-percent * len(ts) // 100))) for label, ts, n in sets], sorted(vocabulary, key=order)


def _literal(tokens) -> Column:
    return F.split(F.lit(" ".join(tokens)), " ")


def _phrase(own: Column, anchors: Column, label: str, phrase: list[str]) -> Column:
    """Anchors at which the phrase's words begin: array of (label, first_word)."""
    places = F.filter(anchors, lambda i: reduce(lambda a, b: a & b, (F.get(own, i + k) == w for k, w in enumerate(phrase))))
    return F.transform(places, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("first_word")))


def _met(own: Column, anchors: Column, t: Template, vocabulary: Column) -> Column:
    """Blocks that meet a template: array of (label, first_word, n_words, share)."""
    size, need = len(t.tokens), t.need
    at = F.filter(anchors, lambda i: F.get(own, i).isin(list(t.prefix)))
    numbers = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.floor(i / t.width), F.floor(i / t.width) - 1))))
    cut = lambda k: F.slice(own, (k * t.width + 1).cast("int"), 2 * t.width)
    # a block's tokens in the global order; others than the vocabulary's can't be shared
    blocks = F.transform(F.filter(numbers, lambda k: k >= 0), lambda k: F.struct((k * t.width).cast("long").alias("first"), F.size(cut(k)).alias("n"), F.array_intersect(vocabulary, cut(k)).alias("held")))
    long_enough = F.filter(blocks, lambda b: F.size(b["held"]) >= need)

    def in_place(b: Column) -> Column:
        first = F.get(F.array_intersect(_literal(t.prefix), b["held"]), F.lit(0))
        after = F.least(size - F.array_position(_literal(t.tokens), first), F.size(b["held"]) - F.array_position(b["held"], first))
        return after + 1 >= need

    shared = F.transform(F.filter(long_enough, in_place), lambda b: F.struct(F.lit(t.label).alias("label"), b["first"].alias("first_word"), b["n"].alias("n_words"), F.size(F.array_intersect(_literal(t.tokens), b["held"])).alias("shared")))
    return F.transform(F.filter(shared, lambda s: s["shared"] >= need), lambda s: F.struct(s["label"], s["first_word"], s["n_words"], (s["shared"] / size).alias("share")))


def with_blocks(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, percent: int = PERCENT) -> DataFrame:
    """row (the caller's columns), words, phrases (array of label and first_word), blocks (array of label, first_word,
    n_words, share), both in the order of templates and phrases."""
    known, vocabulary = prepared(docs, templates, percent)
    places = [(label, _tokens(text)) for text, label in phrases]
    starts = sorted({w for t in known for w in t.prefix} | {p[0] for _, p in places})
    anchors = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(starts), i)))
    rows = docs.select(F.struct("*").alias("row"), words().alias("words")).select("row", "words", anchors.alias("anchors"))
    own, at = F.col("words"), F.col("anchors")
    said = [_phrase(own, at, label, p) for label, p in places]
    met = [_met(own, at, t, _literal(vocabulary)) for t in known]
    return rows.select("row", "words", F.concat(*said).alias("phrases"), F.concat(*met).alias("blocks"))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base (places of phrases), first_word, last_word, base_labels, labels
    (of phrases and blocks), score."""
    found = with_blocks(docs.select("doc_id", "text"), templates, phrases, percent)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base, by_block, places = F.col("phrases.label"), F.col("blocks.label"), F.col("phrases.first_word")
    score = F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max("blocks.share"), F.lit(0.0)))
    return found.select(
        "row.doc_id", F.size("words").cast("long").alias("n_words"), F.size("phrases").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, by_block)).alias("labels"), score.alias("score"),
    )


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _quoted(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def sql(templates=TEMPLATES, phrases=PHRASES, percent: int = PERCENT) -> str:
    """The scan by the definition: each block of each text with each template, without order or filters."""
    sets = [(label, _tokens(text)) for label, text in templates]
    rows = ", ".join(f"({i}, '{label}', {_quoted(sorted(set(ts)))}, {1 << (len(ts) - 1).bit_length()})" for i, (label, ts) in enumerate(sets))
    said = ", ".join(f"('{label}', {_quoted(_tokens(text))})" for text, label in phrases)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), t AS (SELECT * FROM (VALUES {rows}) v(i, label, tokens, width)),
p AS (SELECT * FROM (VALUES {said}) v(label, phrase)),
place AS (
  SELECT k, label, i FROM (SELECT k, label, phrase, words, unnest(range(len(words))) AS i FROM d, p) x WHERE words[i + 1 : i + len(phrase)] = phrase
), base AS (SELECT k, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY k),
block AS (SELECT k, label, tokens, words[f + 1 : f + 2 * width] AS held FROM (SELECT k, label, tokens, width, words, unnest(range(0, len(words), width)) AS f FROM d, t) x),
met AS (SELECT k, label, len(list_intersect(held, tokens)) AS shared, len(tokens) AS size FROM block),
blocks AS (SELECT k, label, max(CAST(shared AS DOUBLE) / size) AS share FROM met WHERE 100 * shared >= {percent} * size GROUP BY k, label),
every AS (SELECT k, label FROM place UNION SELECT k, label FROM blocks),
named AS (SELECT k, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY k)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word, coalesce(b.labels, '') AS base_labels, coalesce(n.labels, '') AS labels,
  CASE WHEN b.n_base > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce((SELECT max(share) FROM blocks x WHERE x.k = d.k), CAST(0 AS DOUBLE)) END AS score
FROM d LEFT JOIN base b ON b.k = d.k LEFT JOIN named n ON n.k = d.k
"""


OP11_SQL = sql()

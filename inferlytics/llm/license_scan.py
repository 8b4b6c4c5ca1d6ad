"""License scans by an exact set-similarity join of text blocks with license templates.

A block is a window of words; it matches a template when it holds at least ``THRESHOLD`` of the template's distinct words
(containment). Templates of up to c words (c a power of two) are looked for in blocks of 2c words, one every c words, so
that any stretch of c words lies whole in some block.

All words of templates are ordered by how often they occur in the whole corpus, rarest first. A match needs ``need``
common words, so (prefix filter) a template of size s shares one of its ``s - need + 1`` rarest words with one of the
block's ``b - need + 1`` rarest ones; (length filter) a block has ``need`` words of templates at least; (positional filter)
at a common word, what follows it in either list must suffice. What passes is verified in full. Words of no template
cannot matter and are left out of blocks, and only blocks with a word of some template's prefix are made at all.

The order is settled by one pass over the corpus, combined before the shuffle. The templates' index is broadcast: it is
made of the caller's templates, whose words are counted first (``MOST_WORDS``). Nothing else is shuffled but the matches.

Odd input: a null or empty text has no words, no labels and the score 0. Repeated rows are returned as often as they occur,
null ids are kept. Very long texts are scanned whole, in time linear in their words. An empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inferlytics.llm.common import _bind as bind
from inferlytics.llm.common import settle, table

THRESHOLD = 0.9
MOST_WORDS = 100_000  # of all templates: the index that is broadcast has at most so many rows
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"  # of lowered text; Spark matches a negated class some 25 times more slowly
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = (  # (label, notice): fixed values, the customary notices of the licenses
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
)
Template = tuple[str, list[str], int]  # label, distinct words, words of the blocks


def words_of(text: str) -> list[str]:
    return re.findall("[0-9a-z\x80-\U0010FFFF]+", text.translate(str.maketrans(UPPER, UPPER.lower())))


def prepared(templates: Sequence[tuple[str, str]]) -> list[Template]:
    out = []
    for label, text in templates:
        words = words_of(text)
        if not words:
            raise ValueError(f"the template of {label} has no words")
        out.append((label, sorted(set(words)), 2 << (len(words) - 1).bit_length()))
    if sum(len(t) for _, t, _ in out) > MOST_WORDS:
        raise ValueError(f"templates have over {MOST_WORDS} words")
    return out


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def corpus_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), F.lit(WORD), F.lit(0))


def ordered_words(docs: DataFrame, templates: Sequence[Template]) -> list[str]:
    """All words of templates, rarest in the corpus first."""
    known = sorted({w for _, words, _ in templates for w in words})
    words = docs.select(F.explode(corpus_words(F.col("text"))).alias("word"))
    index = docs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, known))).alias("word"))
    counts = {r["word"]: r["count"] for r in words.join(F.broadcast(index), "word").groupBy("word").count().collect()}
    return sorted(known, key=lambda w: (counts.get(w, 0), w))


def _places(words: Column, text: Column, phrase: Sequence[str]) -> Column:
    """Word numbers where the phrase stands; only texts that hold it in some form are walked through."""
    starts = F.sequence(F.lit(0), F.size(words) - len(phrase))

    def here(i: Column) -> Column:
        hit = F.get(words, i) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            hit = hit & (F.get(words, i + k) == word)
        return hit

    enough = (F.size(words) >= len(phrase)) & text.rlike(GAP.join(map(re.escape, phrase)))
    return F.when(enough, F.filter(starts, here)).otherwise(F.array().cast("array<int>"))


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def _blocks(words: Column, size: int, order: list[str], templates: Sequence[Template], threshold: float) -> Column:
    """Blocks of ``size`` words that hold a word of a template's prefix, as their template words in corpus order."""
    rank = {w: k for k, w in enumerate(order)}
    mine = [sorted(t, key=rank.get) for _, t, s in templates if s == size]
    prefix = sorted({w for t in mine for w in t[: len(t) - needed(len(t), threshold) + 1]})
    known = sorted({w for t in mine for w in t}, key=rank.get)
    least = min(needed(len(t), threshold) for t in mine)
    step = size // 2
    prefix_, known_ = F.array(*map(F.lit, prefix)), F.array(*map(F.lit, known))
    hits = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(prefix_, F.get(words, i)))
    steps = F.array_distinct(F.transform(hits, lambda i: F.floor(i / step).cast("int")))
    windows = F.array_distinct(F.flatten(F.transform(steps, lambda k: F.array(F.greatest(k - 1, F.lit(0)), k))))
    held = F.transform(windows, lambda k: F.array_intersect(known_, F.slice(words, k * step + 1, F.lit(size))))
    made = F.transform(F.filter(held, lambda b: F.size(b) >= least), lambda b: F.struct(F.lit(size).alias("size"), b.alias("words")))
    empty = F.array().cast("array<struct<size:int,words:array<string>>>")
    return F.when(F.arrays_overlap(words, prefix_), made).otherwise(empty)


def _index(spark: SparkSession, order: list[str], templates: Sequence[Template], threshold: float) -> DataFrame:
    """Prefix words of templates: block size, word, place in the template, the template's words, label, needed words."""
    rank = {w: k for k, w in enumerate(order)}
    rows = []
    for label, words, size in templates:
        words = sorted(words, key=rank.get)
        need = needed(len(words), threshold)
        for i, word in enumerate(words[: len(words) - need + 1]):
            fields = {"size": size, "word": word, "i": i, "n": len(words), "need": need, "label": label}
            template = F.array(*map(F.lit, words)).alias("template")
            rows.append(F.struct(*[F.lit(v).alias(k) for k, v in fields.items()], template))
    return spark.range(1).select(F.inline(F.array(*rows)))


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: words, places of the phrases, labels of phrases and of matching templates, and the greatest containment
    that reaches the threshold (else 0)."""
    cut = prepared(templates)
    order = ordered_words(docs, cut)
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())

    def looked_at(words: Column) -> Column:
        found = [_labelled(_places(words, lowered, words_of(p)), label) for p, label in phrases.items()]
        blocks = [_blocks(words, size, order, cut, threshold) for size in sorted({s for _, _, s in cut})]
        return F.struct(F.size(words).alias("n_words"), F.concat(*found).alias("base"), F.concat(*blocks).alias("blocks"))

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), bind(corpus_words(F.col("text")), looked_at).alias("s")
    )
    rows = settle(rows.select("row", "doc_id", "s.*"), "licenses")
    blocks = rows.select("row", F.inline("blocks")).select("row", "size", "words", F.size("words").alias("b"), F.posexplode("words").alias("j", "word"))
    pairs = blocks.join(F.broadcast(_index(docs.sparkSession, order, cut, threshold)), ["size", "word"])
    pairs = pairs.where("b >= need AND j <= b - need AND 1 + least(n - i - 1, b - j - 1) >= need")
    matches = pairs.select("row", "label", "need", F.size(F.array_intersect("template", "words")).alias("common"), "n").where("common >= need")
    by_row = matches.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(F.col("common") / F.col("n")).alias("score"))
    out = rows.join(by_row, "row", "left")
    at = F.transform("base", lambda b: b["at"].cast("long"))
    base = F.transform("base", lambda b: b["label"])
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_list(words: Sequence[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _oracle() -> str:
    """Every block against every template, without filters."""
    phrases = ", ".join(f"({_sql_list(words_of(p))}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"('{label}', {_sql_list(words)}, {size // 2})" for label, words, size in prepared(TEMPLATES))
    return f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents
), p(phrase, label) AS (VALUES {phrases}), t(label, words, step) AS (VALUES {templates}),
b AS (
  SELECT r, i, label FROM w, p, range(len(ws)) x(i) WHERE ws[i + 1] = phrase[1] AND list_slice(ws, i + 1, i + len(phrase)) = phrase
), m AS (
  SELECT r, label, len(list_intersect(words, list_slice(ws, k * step + 1, k * step + 2 * step))) AS common, len(words) AS n
  FROM w, t, range(len(ws) // step + 1) x(k)
), base AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM b GROUP BY r
), own AS (
  SELECT r, max(common / n) AS score FROM m WHERE common >= ceil({THRESHOLD} * n - 1e-9) GROUP BY r
), every AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM b UNION SELECT r, label FROM m WHERE common >= ceil({THRESHOLD} * n - 1e-9)) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN own USING (r) LEFT JOIN every USING (r)
"""


ORACLE = _oracle()

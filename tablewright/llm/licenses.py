"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

Blocks are lines and, across line breaks, runs of consecutive words sized to each template.
Tokens of the templates are ordered by their frequency in the whole corpus, rarest first. A block that contains at least ``threshold`` of a template's tokens
must share one of the template's first tokens in that order (prefix filter), must hold
enough template tokens at all (length filter), and after its first shared token both sides
must have enough tokens left (positional filter). What passes is counted in full.
Everything is DataFrame work.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.runtime import cut

# Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Well-known notices and their labels.
TEMPLATES = (
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-or-later", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit-release", "Released under the MIT License."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
THRESHOLD = 0.9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    """Words of a short text, as the columns have them."""
    return [w for w in re.split(_BREAKS, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def spaced(text: Column) -> Column:
    """A text's words, each between spaces of its own: ' mit  license '; empty without words."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAKS, "  "))
    return F.when(plain == "", F.lit("")).otherwise(F.concat(F.lit(" "), plain, F.lit(" ")))


def _phrase(words: str) -> str:
    return " " + "  ".join(words_of(words)) + " "


def _words_in(column: Column) -> Column:
    """Words of a ``spaced`` text: half its spaces."""
    return ((F.length(column) - F.length(F.replace(column, F.lit(" "), F.lit("")))) / 2).cast("long")


def phrase_columns(s: Column, phrases=PHRASES) -> list[Column]:
    """n_base, first_word, last_word and base labels of a ``spaced`` text."""
    counts, first, last, labels = [], [], [], []
    for words, label in phrases:
        p = _phrase(words)
        there = F.contains(s, F.lit(p))
        counts.append(F.when(there, ((F.length(s) - F.length(F.replace(s, F.lit(p), F.lit("")))) / len(p)).cast("long")).otherwise(F.lit(0).cast("long")))
        first.append(F.when(there, _words_in(F.substring_index(s, p, 1))))
        last.append(F.when(there, _words_in(s) - _words_in(F.substring_index(s, p, -1)) - len(words_of(words))))
        labels.append(F.when(there, F.lit(label)))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return [total.alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"),
            F.array_compact(F.array(*labels)).alias("base")]


class TokenOrder:
    """Templates as token ranks, rarest token first, with the lengths the filters need."""

    def __init__(self, templates, frequency: dict[str, int], threshold: float):
        tokens = sorted({w for _, text in templates for w in words_of(text)}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(tokens)}
        self.templates, self.spans = [], []
        for label, text in templates:
            words = words_of(text)
            ranks = sorted({self.rank[w] for w in words})
            # Tokens a block has to share; the slack keeps 0.9 * 10 at 9.
            need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
            self.templates.append((label, ranks, need))
            # Words of a run: the template's and as many foreign ones as the threshold leaves room for.
            self.spans.append((label, sorted(set(words)), need, math.ceil(len(words) / threshold - 1e-9)))
        self.prefix = sorted({w for w, i in self.rank.items() if any(i in ranks[: len(ranks) - need + 1] for _, ranks, need in self.templates)})
        self.least = min(need for *_, need in self.templates)


def token_frequency(docs: DataFrame, templates) -> dict[str, int]:
    """How often each template token stands in all texts; at most as many rows as the templates have tokens."""
    wanted = sorted({w for _, text in templates for w in words_of(text)})
    found = docs.select(F.explode(F.split(spaced(F.col("text")), " +")).alias("w")).where(F.col("w").isin(wanted)).groupBy("w").count()
    return {r["w"]: r["count"] for r in found.collect()}


def _held(words: Column, order: TokenOrder) -> Column:
    return F.array_distinct(F.filter(words, lambda w: w.isin(list(order.rank))))


def _candidates(docs: DataFrame, order: TokenOrder) -> DataFrame:
    """Rows whose whole text holds enough tokens of a template; no block of the others can match."""
    enough = lambda held: reduce(or_, (F.size(F.array_intersect(held, F.lit(tokens))) >= need for _, tokens, need, _ in order.spans))
    # The one-element array has the tokens looked up once, not per template.
    return docs.where(F.exists(F.array(_held(F.split(spaced(F.col("text")), " +"), order)), enough))


def _runs(docs: DataFrame, order: TokenOrder) -> DataFrame:
    """(doc_id, _k1, _k2, held, only): runs of a template's length, across lines, that hold ``need`` places of its tokens.

    A run starts at a token of its template, so any run that matches is among them; other
    templates are not looked for in it.
    """
    words = docs.select("doc_id", "_k1", "_k2", F.split(F.trim(spaced(F.col("text"))), " +").alias("words"))
    words = words.select("*", _held(F.col("words"), order).alias("all"))
    spans = docs.sparkSession.createDataFrame(order.spans, "only string, tokens array<string>, need int, span int")
    both = words.join(F.broadcast(spans), F.size(F.array_intersect("all", "tokens")) >= F.col("need"))
    at = F.array_compact(F.transform("words", lambda w, i: F.when(F.array_contains("tokens", w), i)))
    # Positional filter: the need-th token from here stands within the run.
    starts = F.transform(F.array(at), lambda at: F.filter(at, lambda p, j: F.get(at, j + F.col("need") - 1) - p < F.col("span")))[0]
    held = F.array_distinct(F.transform(starts, lambda p: F.array_sort(F.array_intersect(F.slice("words", p + 1, F.col("span")), "tokens"))))
    return both.select("doc_id", "_k1", "_k2", F.explode(held).alias("held"), "only")


def matching_blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, _k1, _k2, label, containment): every block that holds ``threshold`` of a template's distinct tokens."""
    spark = docs.sparkSession
    order = TokenOrder(templates, token_frequency(docs, templates), threshold)
    docs = cut(_candidates(docs.select("doc_id", *_row_keys(), "text"), order), "candidates")
    lines = docs.select("doc_id", "_k1", "_k2", F.explode(F.split("text", "\n")).alias("line"))
    held = _held(F.split(spaced(F.col("line")), " +"), order)
    blocks = lines.select("doc_id", "_k1", "_k2", held.alias("held"), F.lit(None).cast("string").alias("only")).union(_runs(docs, order))
    # Prefix and length filters for all templates at once leave few blocks.
    blocks = blocks.where(F.size("held") >= order.least).where(F.arrays_overlap("held", F.lit(order.prefix)))
    by_rank = F.lit(sorted(order.rank, key=order.rank.get))
    ranks = F.array_sort(F.transform("held", lambda w: (F.array_position(by_rank, w) - 1).cast("int")))
    blocks = blocks.select("doc_id", "_k1", "_k2", "only", ranks.alias("ranks"))
    sides = spark.createDataFrame(order.templates, "label string, t array<int>, need int")
    prefix = lambda ranks: F.slice(ranks, 1, F.greatest(F.size(ranks) - F.col("need") + 1, F.lit(0)))
    index = F.broadcast(sides.select("label", "t", "need", F.explode(prefix(F.col("t"))).alias("token")))
    first = F.get(F.array_intersect(prefix(F.col("ranks")), prefix(F.col("t"))), F.lit(0))
    pairs = (blocks.select("*", F.explode("ranks").alias("token")).join(index, "token")
             .where(F.col("only").isNull() | (F.col("only") == F.col("label")))
             .where((F.size("ranks") >= F.col("need")) & (F.col("token") == first))
             .where(1 + F.least(F.size("ranks") - F.array_position("ranks", F.col("token")), F.size("t") - F.array_position("t", F.col("token"))) >= F.col("need")))
    shared = F.size(F.array_intersect("ranks", "t"))
    return pairs.where(shared >= F.col("need")).select("doc_id", "_k1", "_k2", "label", (shared / F.size("t")).alias("containment"))


def _row_keys() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("_k1"), F.xxhash64(F.lit(5), "text", "doc_id").alias("_k2")]


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of ``docs``.

    Phrases are found where their words stand consecutively, also across lines. Template
    labels come from ``matching_blocks``; the score is the largest containment of a template
    in a block that matches it, 1 with a phrase, else 0.

    * A null or empty text, or one without words, has no words and labels and score 0.
    * Places that overlap are all counted. Repeated rows each get the same row.
    * Long texts are scanned whole; lines of any length are blocks, and so is every run of a
      template's number of words over the threshold, wherever lines break.
    * Columns other than doc_id and text are not read.
    """
    hits = (matching_blocks(docs, templates, threshold).groupBy("_k1", "_k2")
            .agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment")))
    s = F.col("_s")
    rows = (docs.select("doc_id", *_row_keys(), spaced(F.col("text")).alias("_s"))
            .select("doc_id", "_k1", "_k2", _words_in(s).alias("n_words"), *phrase_columns(s, phrases)))
    nothing = F.array().cast("array<string>")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", nothing))))
    return rows.join(hits, ["_k1", "_k2"], "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"))

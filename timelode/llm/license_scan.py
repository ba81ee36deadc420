"""License scans: an exact set-similarity join of text blocks with templates.

Blocks are windows of ``BLOCK`` words, every ``STRIDE`` words, so a passage of up
to BLOCK - STRIDE words lies whole in one. Templates of more words (whole license
texts) are joined with blocks twice, four times, ... as long, whichever takes them
whole. A block matches a template if it contains at least ``THRESHOLD`` of the
template's distinct words.

A set knows no order, so at least ``ORDER`` of the template's pairs of neighbours must be neighbours
in the block too; of a template of fewer than ``LEAST_WORDS`` distinct words, all, as such words meet
by chance.

Template words are ordered by their frequency over all documents, rarest first.
A match must hold one of a template's first |T| - need + 1 words (prefix
filter), needs that many distinct words (length filter), and what follows the
first common word on either side must suffice (positional filter). What passes
is counted exactly. The template side has a row for each prefix word of each template
and is broadcast up to ``BROADCAST_ROWS`` of them; texts never leave their partition unless a block holds a prefix word.

Besides, exact phrases are found with the places where they start.

Only DataFrame operations. Defined results: a null or empty text has no words
and no labels; a containment of exactly the threshold matches; words of equal
frequency are ordered by name; score is the best containment, 1 where a phrase stands,
0 without either; a template without words matches nothing; texts of any length are
read whole, block by block; rows are judged one by one, so repeated rows get equal
results, and rows with null ids like others; an empty table gives an empty result;
only doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from math import ceil
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, STRIDE, THRESHOLD = 64, 32, 0.8
ORDER, LEAST_WORDS = 0.5, 10
BROADCAST_ROWS = 20_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases with their labels (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Characteristic sentences of common licenses (fixed values).
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary"),
)


def words(text: Column) -> Column:
    """What ``WORD`` finds in the text with A-Z in lower case. One pass turns every
    other ASCII character into a space; cutting at single spaces needs no regex."""
    ascii_ = [chr(c) for c in range(128)]
    other = "".join(c for c in ascii_ if not c.isalnum())
    upper = "".join(c for c in ascii_ if c.isupper())
    plain = F.translate(F.coalesce(text, F.lit("")), other + upper, " " * len(other) + upper.lower())
    return F.array_remove(F.split(plain, " "), "")


def _template_words(text: str) -> list[str]:
    return sorted(set(re.findall(WORD, text.lower())))


def _template_pairs(text: str) -> tuple[list[str], int]:
    """Its pairs of neighbours, and how many of them a block needs."""
    ws = re.findall(WORD, text.lower())
    pairs = sorted({f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)})
    return pairs, len(pairs) if len(set(ws)) < LEAST_WORDS else ceil(ORDER * len(pairs) - 1e-9)


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def word_ranks(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """Rank of each template word by the number of documents that hold it, rarest
    first. What reaches the driver has one row for each template word."""
    held = docs.select(F.explode(F.array_intersect(words(F.col("text")), _strings(vocabulary))).alias("word"))
    found = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (found.get(w, 0), w)))}


def matches(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK, stride: int = STRIDE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text_key, first_word of the block, label,
    containment: each block and template at or above the threshold."""
    room = block - stride
    by_size: dict[int, list[tuple[int, str, str]]] = {}
    for t, (label, text) in enumerate(templates):
        n, times = len(re.findall(WORD, text.lower())), 1
        while n > times * room:
            times *= 2
        if n:
            by_size.setdefault(times, []).append((t, label, text))
    rank = word_ranks(docs, sorted({w for _, text in templates for w in _template_words(text)}))
    found = [_matches(docs, some, rank, threshold, times * block, times * stride) for times, some in sorted(by_size.items())]
    if not found:
        return docs.sparkSession.createDataFrame([], MATCHES)
    return reduce(DataFrame.unionByName, found)


MATCHES = "doc_id long, text_key long, first_word long, template int, label string, containment double"


def _matches(docs: DataFrame, templates: Sequence[tuple[int, str, str]], rank: dict[str, int], threshold: float, block: int, stride: int) -> DataFrame:
    """matches for templates (number, label, text) that a block's overlap takes whole."""
    spark = docs.sparkSession
    index, prefixes = [], set()
    for t, label, text in templates:
        ws, (pairs, need_pairs) = sorted(_template_words(text), key=rank.__getitem__), _template_pairs(text)
        need = ceil(threshold * len(ws) - 1e-9)
        for place, w in enumerate(ws[: len(ws) - need + 1]):
            index.append((rank[w], t, label, place, need, [rank[x] for x in ws], pairs, need_pairs))
            prefixes.add(w)
    index_rows = spark.createDataFrame(index, "rank int, template int, label string, place int, need int, ranks array<int>, pairs array<string>, need_pairs int")

    # only texts that hold a prefix word go on
    held = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words"))
    held = held.where(F.arrays_overlap("words", _strings(sorted(prefixes))))
    ranks = F.create_map(*[x for w, i in rank.items() for x in (F.lit(w), F.lit(i))])
    prefix_set = _strings(sorted(prefixes))
    at = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(prefix_set, w), i)), lambda i: i.isNotNull())
    last = F.greatest(F.lit(0), F.ceil((F.size("words") - block) / stride).cast("int"))
    cut = F.transform(at, lambda i: F.least(last, F.floor(i / stride).cast("int")))
    cuts = F.array_distinct(F.concat(cut, F.transform(cut, lambda b: F.greatest(F.lit(0), b - 1))))
    blocks = held.select("doc_id", "text_key", "words", F.explode(cuts).alias("b"))
    here = F.slice("words", F.col("b") * stride + 1, block)
    own = F.filter(F.transform(F.array_distinct(here), lambda w: F.element_at(ranks, w)), lambda r: r.isNotNull())
    blocks = blocks.select("doc_id", "text_key", (F.col("b") * stride).cast("long").alias("first_word"), F.array_sort(own).alias("own"), here.alias("here"))
    met = blocks.select("*", F.posexplode("own").alias("at", "rank")).join(F.broadcast(index_rows) if len(index) <= BROADCAST_ROWS else index_rows, "rank")
    met = met.where(F.size("own") >= F.col("need"))
    # common words up to here are at most the two places; the rest comes after
    met = met.where(F.least("at", "place") + F.least(F.size("ranks") - F.col("place"), F.size("own") - F.col("at")) >= F.col("need"))
    both = F.size(F.array_intersect("own", "ranks"))
    met = met.withColumn("both", both).where("both >= need")
    neighbours = F.zip_with("here", F.slice("here", 2, block), lambda a, b: F.concat(a, F.lit(" "), b))
    met = met.where(F.size(F.array_intersect("pairs", neighbours)) >= F.col("need_pairs"))
    return met.select("doc_id", "text_key", "first_word", "template", "label", (F.col("both") / F.size("ranks")).alias("containment")).distinct()


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score."""
    found = matches(docs, templates, threshold).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    found = found.select(F.col("doc_id").alias("doc_"), F.col("text_key").alias("key_"), "found", "best")
    def starts(phrase: str) -> Column:
        """Places in ``own`` from which the phrase's words stand in a row."""

        def place(word: Column, i: Column) -> Column:
            hit = word == phrase.split()[0]
            for k, w in enumerate(phrase.split()):
                hit = hit & F.coalesce(F.get("own", i + k) == w, F.lit(False))
            return F.when(hit, i)

        found = F.filter(F.transform("own", place), lambda i: i.isNotNull())
        return F.coalesce(found, F.array().cast("array<int>"))

    held = lambda phrase: reduce(and_, [F.array_contains("words", w) for w in phrase.split()])
    own = F.when(reduce(or_, [held(p) for p, _ in phrases]), F.col("words"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "text_key", own.alias("own"))
    places = [starts(p).alias(f"p{k}") for k, (p, _) in enumerate(phrases)]
    rows = rows.select("doc_id", "n_words", "text_key", *places)
    every = F.concat(*[F.col(f"p{k}") for k in range(len(phrases))])
    labels = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull())))
    rows = rows.select("doc_id", "n_words", "text_key", every.alias("places"), labels.alias("base"))
    rows = rows.join(found, rows["doc_id"].eqNullSafe(found["doc_"]) & rows["text_key"].eqNullSafe(found["key_"]), "left")
    all_labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )

"""License scan: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a paragraph of a document (lines up to a blank one), and each of its lines. A template is found in a
block when at least THRESHOLD of the template's distinct words are in the block. Words are ordered by
how many blocks of the whole corpus hold them, rarest first. If a template of n words must share
k = ceil(THRESHOLD * n) of them, at least one of its n - k + 1 rarest words is in the block; so only
blocks holding such a prefix word are joined (prefix filter), of those only blocks with k words of
any template (length filter), and of those only where the words from the match on can still reach k
(positional filter). Candidates are verified on their word sets. No block that meets the threshold
is missed. Words that are in no template cannot count, so blocks carry template words only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.session import durable

THRESHOLD = 0.8

# Words are runs of ASCII letters and digits and of all other characters above ASCII.
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Notices that public licenses ask to be shown, and the labels they stand for.
TEMPLATES = (
    ("mit-notice", "Released under the MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                  "associated documentation files, to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-grant", "You may not use this file except in compliance with the License. You may obtain a copy of the "
                         "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)

LOWER = {c: c + 32 for c in range(65, 91)}
words_of = re.compile(LETTERS).findall


def words(text: str | None) -> list[str]:
    return words_of((text or "").translate(LOWER))


def blocks(lines: list[tuple[str, frozenset[str]]]) -> Iterator[frozenset[str]]:
    """Template words of each paragraph and, where it has several lines, of each line."""
    paragraph: list[frozenset[str]] = []
    for line, own in [*lines, ("", frozenset())]:
        if line.strip():
            paragraph.append(own)
            continue
        if paragraph:
            yield frozenset().union(*paragraph)
            if len(paragraph) > 1:
                yield from paragraph
        paragraph = []


def read(text: str | None, vocabulary: frozenset[str]) -> tuple[list[str], list[tuple[int, list[str]]]]:
    """All words of a text, and (number, template words) of the blocks that hold any."""
    every, lines = [], []
    for line in (text or "").translate(LOWER).split("\n"):
        own = words_of(line)
        every += own
        lines.append((line, vocabulary.intersection(own)))
    return every, [(n, sorted(own)) for n, own in enumerate(blocks(lines)) if own]


def template_sets(templates) -> list[tuple[str, frozenset[str]]]:
    return [(label, frozenset(words(text))) for label, text in templates]


def frequencies(docs: DataFrame, vocabulary: frozenset[str]) -> dict[str, int]:
    """How many blocks of all documents hold each template word. One row per template word reaches the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = dict.fromkeys(vocabulary, 0)
            for text in batch.column(0):
                for _, own in read(text.as_py(), vocabulary)[1]:
                    for word in own:
                        counts[word] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = docs.select(docs["text"].alias("text")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in rows.collect()}


def scan(docs: DataFrame, order: dict[str, int], needed: int, prefix: frozenset[str], phrases=PHRASES) -> DataFrame:
    """One row per document: phrase places, and its blocks as arrays of template words, rarest first.

    Blocks without a prefix word of any template, and those of fewer than `needed` template words, which are too
    short for any, stay behind.
    """
    vocabulary = frozenset(order)
    split = [(tuple(phrase.split()), label) for phrase, label in phrases]
    firsts = {p[0] for p, _ in split}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                own, parts = read(text.as_py(), vocabulary)
                starts, labels = [], set()
                if firsts.intersection(own):
                    for at, word in enumerate(own):
                        if word in firsts:
                            for phrase, label in split:
                                if tuple(own[at: at + len(phrase)]) == phrase:
                                    starts.append(at)
                                    labels.add(label)
                found = [{"block": n, "words": sorted(b, key=order.__getitem__)}
                         for n, b in parts if len(b) >= needed and not prefix.isdisjoint(b)]
                rows.append({"doc_id": doc_id.as_py(), "n_words": len(own), "n_base": len(starts),
                             "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                             "base": sorted(labels), "blocks": found})
            yield pa.RecordBatch.from_pylist(rows, schema)

    block = pa.struct([("block", pa.int32()), ("words", pa.list_(pa.string()))])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                        ("last_word", pa.int64()), ("base", pa.list_(pa.string())), ("blocks", pa.list_(block))])
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                                 "base array<string>, blocks array<struct<block:int,words:array<string>>>")


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs` (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels,
    score, found (label, block, containment of every template met).

    score is 1 where a phrase stands, else the largest containment met, else 0. Null text counts as
    empty. Each row is judged by itself, so repeated rows get equal results; other columns are
    ignored; an empty table gives no rows.
    """
    sets = template_sets(templates)
    vocabulary = frozenset().union(*(s for _, s in sets))
    count = frequencies(docs, vocabulary)
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}
    prefixes = []
    for label, own in sets:
        need = math.ceil(threshold * len(own) - 1e-9)
        ranked = sorted(own, key=order.__getitem__)
        prefixes += [(label, word, at, need, ranked) for at, word in enumerate(ranked[: len(own) - need + 1])]
    needed = min(p[3] for p in prefixes)
    # A broadcast of a few rows per template, whatever the corpus.
    probes = F.broadcast(docs.sparkSession.createDataFrame(
        prefixes, "label string, word string, place int, need int, template array<string>"))
    # Ids may repeat, so every row gets a number, fixed by writing it.
    rows = durable(scan(docs, order, needed, frozenset(p[1] for p in prefixes), phrases).withColumn("row", F.monotonically_increasing_id()), "license-blocks")
    held = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.block", F.col("b.words").alias("own"))
    met = held.select("*", F.posexplode("own").alias("at", "word")).join(probes, "word")
    before = F.least("at", "place")
    rest = F.least(F.size("own") - F.col("at"), F.size("template") - F.col("place"))
    met = met.filter((F.size("own") >= F.col("need")) & (before + rest >= F.col("need")))
    shared = F.size(F.array_intersect("own", "template"))
    met = met.filter(shared >= F.col("need")).select(
        "row", F.struct("label", "block", (shared / F.size("template")).alias("containment")).alias("hit")).distinct()
    hits = met.groupBy("row").agg(F.sort_array(F.collect_list("hit")).alias("found"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("found", lambda h: h["label"]))))
    return rows.join(hits, "row", "left").withColumn("found", F.coalesce("found", F.array().cast(hits.schema["found"].dataType))).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(
            F.coalesce(F.array_max(F.transform("found", lambda h: h["containment"])), F.lit(0.0))).alias("score"), "found")

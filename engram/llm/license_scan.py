"""Licence scans: a positional index of rare licence words.

Templates are short licence notices, as words in lower case. Spark counts in how many documents
each template word occurs; idf = ln((documents + 1) / (with the word + 1)). Each template is
indexed by its words of highest idf (half of them, KEYS at most, but so many that the others weigh
less than MIN_SCORE of the template), and a file is looked up by all of these that it has, so that
no template is crowded out by others. Each place of such a word in the file and in a template
votes for one relative position (place in the file minus place in the template); the votes, added
over words, are the intersection of the postings by relative position. Each voted position is
scored by the idf of the template's words found at their places (one word early or late still
counts) over the idf of all its words. A template is found where the score is at least MIN_SCORE
and one of its mandatory phrases stands in the file within the aligned part.

Besides, fixed base phrases are searched at every place; their labels always stand.

Edge cases: a null or empty text has no words, no labels and score 0; first_word and last_word are
null without a base phrase; overlapping and repeated places all count; repeated rows are each
scanned; an empty table gives an empty result; other columns are ignored. Very long texts are
read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import ALNUM_WORD, LOWER, Words, pieces, string_bytes, table, tidied

# Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Opening words of well-known licence notices, and phrases of which one must stand.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("apache", "Licensed under the Apache License, Version 2.0", ["apache license", "apache software license"]),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["www apache org licenses"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["gnu general public license"]),
    ("gpl", "under the terms of the GNU General Public License", ["gnu general public license"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ["lesser general public license", "library general public license"]),
    ("agpl", "under the terms of the GNU Affero General Public License", ["affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", ["bsd style license", "bsd license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ["eclipse public license"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons"]),
]

KEYS = 8
MIN_SCORE = 0.6
#: Positions of a template scored at a time.
STARTS = 20_000

SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def word_hashes(words: list[str]) -> np.ndarray:
    data, offsets = string_bytes(pa.array(words, pa.large_string()))
    return Words(data, offsets, np.ones(256, bool)).hashes()


class Index:
    """Postings of the template words, with their idf."""

    def __init__(self, idf: dict[str, float] | None = None, templates=TEMPLATES, base=BASE_PHRASES):
        self.labels = [t[0] for t in templates]
        bodies = [words_of(t[1]) for t in templates]
        keys = [[words_of(k) for k in t[2]] for t in templates]
        phrases = [(words_of(p), label) for p, label in base.items()]
        every = {w for b in bodies for w in b} | {w for k in keys for p in k for w in p} | {w for p, _ in phrases for w in p}
        self.vocabulary = sorted(every)
        h = word_hashes(self.vocabulary)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.bodies = [np.array([number[w] for w in b]) for b in bodies]
        self.keys = [[[number[w] for w in p] for p in k] for k in keys]
        self.phrases = [([number[w] for w in p], label) for p, label in phrases]
        self.idf = np.array([(idf or {}).get(w, 1.0) for w in self.vocabulary])
        self.rare = np.zeros(len(every), bool)
        for body in self.bodies:
            own, times = np.unique(body, return_counts=True)
            by = np.lexsort((own, -self.idf[own]))
            rest = 1 - np.cumsum((self.idf[own] * times)[by]) / self.idf[body].sum()
            least = int(np.argmax(rest < MIN_SCORE - 1e-6)) + 1  # a match has one of these at least
            self.rare[own[by][: max(min(KEYS, (len(own) + 1) // 2), least)]] = True
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, body in enumerate(self.bodies):
            for q, w in enumerate(body.tolist()):
                self.postings.setdefault(w, []).append((t, q))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The vocabulary number of each word, -1 for other words."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def places(self, w: np.ndarray, phrase: list[int]) -> np.ndarray:
        if len(w) < len(phrase):
            return np.zeros(0, np.int64)
        hit = np.ones(len(w) - len(phrase) + 1, bool)
        for i, x in enumerate(phrase):
            hit &= w[i : len(hit) + i] == x
        return np.flatnonzero(hit)

    def match(self, w: np.ndarray) -> tuple[set[str], float]:
        """Labels of the templates found among a file's words (vocabulary numbers), and the best score."""
        place = np.flatnonzero((w >= 0) & self.rare[w])
        votes: dict[int, list[np.ndarray]] = {}
        for x in np.unique(w[place]).tolist():
            at = place[w[place] == x]
            for t, q in self.postings[x]:
                votes.setdefault(t, []).append(at - q)
        found, best = set(), 0.0
        for t, starts in votes.items():
            body = self.bodies[t]
            every = max(self.idf[body].sum(), 1e-9)
            edge = np.full(len(body) + 1, -2)
            padded = np.concatenate([edge, w, edge])
            starts = np.unique(np.concatenate(starts))
            for low in range(0, len(starts), STARTS):
                some = starts[low : low + STARTS]
                hit = np.zeros((len(some), len(body)), bool)
                for i, x in enumerate(body.tolist()):
                    for shift in (-1, 0, 1):
                        hit[:, i] |= padded[some + (len(edge) + i + shift)] == x
                for k in np.flatnonzero(hit @ self.idf[body] >= (MIN_SCORE - 1e-6) * every).tolist():
                    score, start = float(self.idf[body][hit[k]].sum() / every), int(some[k])
                    if score < MIN_SCORE:
                        continue
                    part = w[max(0, start - 2) : start + len(body) + 2]
                    if any(len(self.places(part, key)) for key in self.keys[t]):
                        found.add(self.labels[t])
                        best = max(best, score)
        return found, min(best, 1.0)

    def scan(self, w: np.ndarray) -> tuple:
        """n_base, first_word, last_word, base_labels, labels, score of one file's vocabulary numbers."""
        starts, base = [], set()
        for phrase, label in self.phrases:
            at = self.places(w, phrase)
            if len(at):
                starts += [at[0], at[-1]]
                base.add(label)
        n = sum(len(self.places(w, p)) for p, _ in self.phrases)
        found, score = self.match(w)
        return n, int(min(starts)) if n else None, int(max(starts)) if n else None, ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if base else score


def document_counts(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """(word int, n long): documents with each word of the vocabulary; word -1: all documents."""

    def count(batches):
        total, docs_n = np.zeros(len(index.vocabulary), np.int64), 0
        for batch in batches:
            docs_n += len(batch)
            for p in pieces(batch.column(0)):
                w = p.words(ALNUM_WORD, LOWER[p.data])
                num = index.numbers(w.hashes())
                pairs = np.unique(w.doc()[num >= 0] * len(total) + num[num >= 0])
                total += np.bincount(pairs % len(total), minlength=len(total))
        rows = np.arange(-1, len(total))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(np.concatenate([[docs_n], total]))], ["word", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(tidied(count), "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_index(docs: DataFrame, templates=TEMPLATES, base=BASE_PHRASES) -> Index:
    """The index with idf over all documents; one count for each template word reaches the driver."""
    index = Index(None, templates, base)
    n = {r.word: r.n for r in document_counts(docs, index).collect()}
    every = n.pop(-1, 0)
    return Index({w: float(np.log((every + 1) / (n.get(i, 0) + 1))) + 1e-6 for i, w in enumerate(index.vocabulary)}, templates, base)


def scan(spark: SparkSession, index: Index):
    """Column function of (text): a struct of SCAN."""
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf(SCAN)
    def scanned(texts: pa.Array) -> pa.Array:
        ix, n_words, rows = shared.value, [], []
        empty = (0, None, None, "", "", 0.0)
        for p in pieces(texts):
            w = p.words(ALNUM_WORD, LOWER[p.data])
            num = ix.numbers(w.hashes())
            n_words.append(w.counts)
            # a file without a rare licence word or a base phrase's first word has nothing to find
            open_words = ix.rare.copy()
            open_words[[p[0] for p, _ in ix.phrases]] = True
            has = np.zeros(p.n, bool)
            has[w.doc()[(num >= 0) & open_words[num]]] = True
            first = w.first.tolist()
            rows += [ix.scan(num[first[i] : first[i + 1]]) if has[i] else empty for i in range(p.n)]
        names = [x.split()[0] for x in SCAN.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        counts = np.concatenate(n_words) if n_words else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(counts.astype(np.int64)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return scanned


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", scan(spark, build_index(docs))("text").alias("s")).select("doc_id", "s.*")

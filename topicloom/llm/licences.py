"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line. Its features are the word 1- to 3-grams that occur in licence statements; their presence,
divided by the square root of the number of words, goes into a multinomial logistic regression over the licence
families and an unknown class. It is trained by stochastic gradient descent in numpy, in one task, on
variations of the statements below (words left out, ordinary words around them) against lines of a bounded
sample of documents (``SAMPLE``), and the statements' words in other orders, as unknown. A temperature fitted on
variations that were kept aside calibrates the probabilities. A predicted family is confirmed if a line holds at
least ``SAME`` of the five-word shingles of one of the family's statements (of a shorter one, all its words in order).

Statements that are wrapped over lines are looked for in blocks, the lines between blank ones, by the same share of shingles
within a span of at most twice the statement's words. Such a span is one paragraph, confirmed, with the probability of its
joined lines; unconfirmed families of its single lines are dropped. Of overlapping statements the one with the larger share counts.

All families found in a document are returned, with the number of their paragraphs and the first of these, counted from 1; a
paragraph counts for its most probable family and for any other of which a whole statement stands there. The main licence is the first of them.

Defined results: a null or empty text is unknown with no paragraphs and no families. Of several licences in a document, a
confirmed one goes first, then the more probable, then the name. Rows that repeat a doc_id are judged each. An empty table gives no
rows, and a model trained on statements alone. Further columns are ignored. Lines of any length are judged whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import in_one_task
from topicloom.llm.decontamination import WORD_BYTES, words

UNKNOWN = "unknown"
#: Public licence statements by family (fixed values).
STATEMENTS = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License.",
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0-1.0": (
        "Licensed under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "proprietary": ("All rights reserved.", "Copyright, all rights reserved. No part of this work may be reproduced without permission."),
}
FAMILIES = [*STATEMENTS, UNKNOWN]
#: Documents, and lines of each, that give examples of the unknown class.
SAMPLE, LINES = 500, 8
VARIATIONS, ASIDE, EPOCHS, BATCH, RATE, DECAY, SEED = 40, 10, 30, 64, 8.0, 1e-5, 23
NGRAM, SHINGLE, SAME, SURE = 3, 5, 0.8, 0.5
FAMILY = "struct<licence:string,probability:double,confirmed:boolean,n_paragraphs:long,first_paragraph:long>"
FOUND = f"struct<licence:string,probability:double,confirmed:boolean,n_paragraphs:long,families:array<{FAMILY}>>"

#: As ``WORD_BYTES``, with line feeds kept.
LINE_BYTES = bytes(10 if b == 10 else c for b, c in enumerate(WORD_BYTES))
BREAK = b"\x01"


def _contained(part: list[bytes], line: list[bytes]) -> float:
    """Share of the shingles of ``part`` that occur in ``line``."""
    n = min(SHINGLE, len(part))
    held = {tuple(line[i : i + n]) for i in range(len(line) - n + 1)}
    own = [tuple(part[i : i + n]) for i in range(len(part) - n + 1)]
    return sum(x in held for x in own) / len(own)


class Model:
    """N-gram weights, bias, temperature."""

    def __init__(self, lines: list[list[bytes]]):
        random = np.random.default_rng(SEED)
        self.templates = {f: [words(s) for s in group] for f, group in STATEMENTS.items()}
        everything = [(f, s) for f, group in self.templates.items() for s in group]
        self.shingles: dict[tuple, list[tuple[str, int]]] = {}
        for f, group in self.templates.items():
            for number, s in enumerate(group):
                n = min(SHINGLE, len(s))
                for part in {tuple(s[i : i + n]) for i in range(len(s) - n + 1)}:
                    self.shingles.setdefault(part, []).append((f, number))
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, s in everything for w in s}), 1)}
        keys = np.unique(np.concatenate([self._keys(np.array([self.vocabulary[w] for w in s])) for _, s in everything]))
        self.keys = keys
        # lines that share a shingle with a statement may be licences
        shared = {tuple(s[i : i + SHINGLE]) for _, s in everything for i in range(max(1, len(s) - SHINGLE + 1))}
        sizes = sorted({len(x) for x in shared})
        plain = [x for x in lines if x and not any(tuple(x[i : i + n]) in shared for n in sizes for i in range(len(x) - n + 1))]
        around = [w for x in plain for w in x] or [b"x"]

        def varied(s: list[bytes]) -> list[bytes]:
            kept = [w for w in s if random.random() > 0.1] or s
            before, after = ([around[i] for i in random.integers(0, len(around), random.integers(0, 12))] for _ in range(2))
            return [*before, *kept, *after] if random.random() < 0.7 else kept

        rows: list[tuple[list[bytes], int, bool]] = []
        for f, s in everything:
            for i in range(VARIATIONS):
                rows.append((varied(s) if i else s, FAMILIES.index(f), i >= VARIATIONS - ASIDE))
                if len(s) > 4 and i % 4 == 1:
                    rows.append(([s[j] for j in random.permutation(len(s))], len(FAMILIES) - 1, i >= VARIATIONS - ASIDE))
        rows += [(x, len(FAMILIES) - 1, i % 4 == 0) for i, x in enumerate(plain)]
        self._train(rows, random)

    def _keys(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of all n-grams of words in the vocabulary."""
        base, out = np.int64(len(self.vocabulary) + 1), [ids[ids > 0].astype(np.int64)]
        for n in range(2, NGRAM + 1):
            size = len(ids) - n + 1
            if size > 0:
                parts = [ids[j : j + size].astype(np.int64) for j in range(n)]
                key = np.zeros(size, np.int64)
                for p in parts:
                    key = key * base + p
                out.append(key[np.logical_and.reduce([p > 0 for p in parts])])
        return np.concatenate(out)

    def _row(self, line: list[bytes]) -> np.ndarray:
        x = np.zeros(len(self.keys), np.float32)
        found = np.unique(self._keys(np.array([self.vocabulary.get(w, 0) for w in line], np.int64)))
        at = np.searchsorted(self.keys, found)
        at = at[np.take(self.keys, at, mode="clip") == found] if len(found) else at
        x[at] = 1 / np.sqrt(len(line))
        return x

    def _train(self, rows: list, random: np.random.Generator) -> None:
        x = np.stack([self._row(line) for line, _, _ in rows])
        y, aside = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        target = np.eye(len(FAMILIES), dtype=np.float32)[y]
        weights, bias = np.zeros((x.shape[1], len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
        learn = np.flatnonzero(~aside)
        for epoch in range(EPOCHS):
            for part in np.array_split(random.permutation(learn), max(1, len(learn) // BATCH)):
                error = _softmax(x[part] @ weights + bias) - target[part]
                rate = RATE * (1 - epoch / EPOCHS)
                weights -= rate * (x[part].T @ error / len(part) + DECAY * weights)
                bias -= rate * error.mean(0)
        self.weights, self.bias = weights.astype(np.float64), bias.astype(np.float64)
        logits = x[aside] @ self.weights + self.bias
        losses = {t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(logits)), y[aside]], 1e-12)).mean() for t in np.geomspace(0.1, 4, 24)}
        self.temperature = float(min(losses, key=losses.get))

    def _wrapped(self, listed: list[bytes], ids: np.ndarray, breaks: np.ndarray) -> list[tuple[int, int, str, float]]:
        """(first line, last line, family, probability) of statements that go over line feeds."""
        at = np.flatnonzero(~breaks)
        line = np.cumsum(breaks)[at]
        new = np.flatnonzero(np.diff(line, prepend=line[0]) > 1)  # blank lines lie between
        block = np.zeros(len(at), np.int64)
        block[new] = 1
        block = np.cumsum(block)
        own = ids[at]
        hits: dict[tuple[str, int], list[tuple[int, tuple]]] = {}
        for n in sorted({len(x) for x in self.shingles}):
            size = len(at) - n + 1
            if size <= 0:
                continue
            inside = block[:size] == block[n - 1 :]
            for j in range(n):
                inside &= own[j : j + size] > 0
            for i in np.flatnonzero(inside).tolist():
                part = tuple(listed[k] for k in at[i : i + n].tolist())
                for place in self.shingles.get(part, ()):
                    hits.setdefault(place, []).append((i, part))
        found = []
        for (name, number), listing in hits.items():
            statement = self.templates[name][number]
            n = min(SHINGLE, len(statement))
            total, low, counts = len(statement) - n + 1, 0, {}
            for high, (i, part) in enumerate(listing):
                counts[part] = counts.get(part, 0) + 1
                while i + n - listing[low][0] > 2 * len(statement) or block[i] != block[listing[low][0]] or counts[listing[low][1]] > 1:
                    counts[listing[low][1]] -= 1
                    low += 1
                share = sum(c > 0 for c in counts.values()) / total
                if share >= SAME:
                    found.append((-share, listing[low][0], i + n - 1, name))
        taken, out = np.zeros(len(at), bool), []
        for _, i, j, name in sorted(found):
            if taken[i : j + 1].any():
                continue
            taken[i : j + 1] = True
            if line[i] != line[j]:
                words_of = [listed[k] for k in at[(line >= line[i]) & (line <= line[j])].tolist()]
                p = _softmax((self._row(words_of)[None] @ self.weights + self.bias) / self.temperature)
                out.append((int(line[i]), int(line[j]), name, float(p[0, FAMILIES.index(name)])))
        return out

    def judge(self, text: str | None) -> dict:
        """The document's families, and the main one."""
        data = (text or "").encode("utf-8", "surrogatepass").translate(LINE_BYTES).replace(b"\n", b" \x01 ")
        listed = data.split()
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in listed], np.int64)
        nothing = {"licence": UNKNOWN, "probability": 0.0, "confirmed": False, "n_paragraphs": 0, "families": []}
        if not len(ids) or not ids.any():
            return nothing
        breaks = np.array([w == BREAK for w in listed]) if BREAK in listed else np.zeros(len(ids), bool)
        ids[breaks] = -1
        line = np.cumsum(breaks)
        count = np.bincount(line[~breaks], minlength=line[-1] + 1)
        base, at, rows = np.int64(len(self.vocabulary) + 1), [], []
        for n in range(1, NGRAM + 1):
            size = len(ids) - n + 1
            if size <= 0:
                continue
            inside, key = np.ones(size, bool), np.zeros(size, np.int64)
            for j in range(n):
                inside &= ids[j : j + size] > 0
            where = np.flatnonzero(inside)
            for j in range(n):
                key[where] = key[where] * base + ids[where + j]
            k = np.minimum(np.searchsorted(self.keys, key[where]), len(self.keys) - 1)
            hit = self.keys[k] == key[where]
            at.append(line[where[hit]])
            rows.append(k[hit])
        # presence: each feature once a line
        pairs = np.unique(np.stack([np.concatenate(at), np.concatenate(rows)], 1), axis=0)
        lines, first = np.unique(pairs[:, 0], return_index=True)
        sums = np.add.reduceat(self.weights[pairs[:, 1]], first, axis=0) / np.sqrt(count[lines])[:, None]
        p = _softmax((sums + self.bias) / self.temperature)
        family = p[:, :-1].argmax(1)
        # at an even chance for any family; below, one of them must be likely by itself or be confirmed
        sure = np.flatnonzero(1 - p[:, -1] >= SURE)
        starts = np.concatenate([[0], np.flatnonzero(breaks) + 1, [len(listed) + 1]])
        found: dict[str, list[tuple[bool, float, int]]] = {}
        for i in sure.tolist():
            own = listed[starts[lines[i]] : starts[lines[i] + 1] - 1]
            for j, name in enumerate(FAMILIES[:-1]):
                # versions of a licence differ by a word: a further family needs a whole statement
                same = max(_contained(s, own) for s in self.templates[name]) >= (SAME if j == family[i] else 1)
                if same or j == family[i] and p[i, j] >= SURE:
                    found.setdefault(name, []).append((not same, -float(p[i, j]), int(lines[i])))
        for first, last, name, probability in self._wrapped(listed, ids, breaks) if breaks.any() else ():
            for other in list(found):
                found[other] = [x for x in found[other] if not (x[0] and first <= x[2] <= last)]
            found.setdefault(name, []).append((False, -probability, first))
        found = {name: x for name, x in found.items() if x}
        if not found:
            return nothing
        families = []
        for other, probability, name in sorted((*min(x)[:2], name) for name, x in found.items()):
            places = [x[2] for x in found[name]]
            families.append({"licence": name, "probability": -probability, "confirmed": not other, "n_paragraphs": len(places), "first_paragraph": min(places) + 1})
        paragraphs = {x[2] for places in found.values() for x in places}
        main = {k: families[0][k] for k in ("licence", "probability", "confirmed")}
        return main | {"n_paragraphs": len(paragraphs), "families": families}


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Train against ordinary lines of at most ``sample`` documents, those with the smallest hashes of their id."""
    doc_id = F.col("doc_id").cast("long")
    order = F.xxhash64(doc_id)
    first = docs.filter(doc_id.isNotNull()).select(order.alias("order")).orderBy("order").limit(sample).collect()
    last = first[-1].order if first else None
    text = F.substring(F.coalesce(F.col("text").cast("string"), F.lit("")), 1, 4000).alias("text")
    chosen = docs.filter(doc_id.isNotNull() & (order <= F.lit(last))).select(doc_id.alias("doc_id"), F.lit(0).alias("label"), text)

    def run(_, __, texts) -> bytes:
        lines = [words(x) for t in texts for x in t.split("\n")[:LINES]]
        return pickle.dumps(Model(lines))

    return pickle.loads(in_one_task(chosen.limit(2 * sample), run, "model"))


def licence(text: Column, model: Model) -> Column:
    """Struct column: licence, probability, confirmed, n_paragraphs, families."""
    held = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf(FOUND)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [held.value.judge(t) for t in texts]
            yield pd.DataFrame(rows, columns=["licence", "probability", "confirmed", "n_paragraphs", "families"])

    return judged(text)


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, licence, probability, confirmed, n_paragraphs, families of every document."""
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), licence(F.col("text").cast("string"), fit(docs)).alias("found")
    )
    return found.select("doc_id", "found.licence", "found.probability", "found.confirmed", "found.n_paragraphs", "found.families")

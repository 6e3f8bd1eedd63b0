"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its words, its pairs of equal words and the character n-grams inside
words, all hashed to ``BUCKETS`` rows; a softmax over the mean gives class probabilities. Vectors and weights are trained together by
stochastic gradient descent in numpy, on a bounded sample of labelled documents (``SAMPLE``), in one task. To score,
the product of vectors and weights is taken once per bucket, which gives the same softmax without the dimension
in between. Whole texts count, in pieces of bounded length.

Defined results: a null or empty text, and one of white space only, has the mean zero, hence the score that the bias
alone gives. Rows that repeat a doc_id are scored each. A null doc_id is held out. Without training rows of both labels
the score of every document is the smoothed share of label 1. Null labels and labels without a document are left
out; an empty table of documents gives no rows. Further columns are ignored, or kept by ``score``.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import held_out, in_one_task, labelled_sample, segments

BUCKET_BITS, DIMENSIONS = 16, 8
BUCKETS = 1 << BUCKET_BITS
NGRAMS = (3, 4)
#: The bucket of the word pair in which both are equal.
REPEAT = 0
#: Added to the number of features in the mean, so that a few words alone decide less.
CALM = 20
#: Labelled documents used for training, at most.
SAMPLE = 8000
EPOCHS, RATE, BATCH, SEED = 5, 2.0, 16, 17
SEGMENT = 1 << 18
FOLDS, FOLD = 5, 0

_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse, for word hashes by prefix sums."""
    if not _powers:
        base = 0x9E3779B97F4A7C15
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(SEGMENT + 2, b, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers


def features(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the words and n-grams of a text, piece by piece, with repeats. Case and punctuation count."""
    up, down = _power_tables()
    top = np.uint64(64 - BUCKET_BITS)
    for data in segments(text, SEGMENT - 2):
        a = np.frombuffer(b" " + data + b" ", np.uint8)
        space = (a <= 32) & ((a == 32) | ((a >= 9) & (a <= 13)))
        a = np.where(space, np.uint8(32), a)
        if space.all():
            continue
        # words: from the byte after a space up to the next space
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        sums = np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)
        word = (sums[end - 1] - sums[start - 1]) * down[start]
        yield ((word ^ (word >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> top).astype(np.int32)
        # a pair of equal words is one feature whatever the word
        yield np.full(np.count_nonzero(word[1:] == word[:-1]), REPEAT, np.int32)
        # n-grams: a space may stand first or last only, as the mark of a word's edge
        wide, inner = a.astype(np.uint32), space[1:]
        for n in NGRAMS:
            size = len(a) - n + 1
            if size <= 0:
                continue
            gram, apart = np.zeros(size, np.uint32), np.zeros(size, bool)
            for j in range(n):
                gram |= wide[j : j + size] << np.uint32(8 * j)
            for j in range(n - 2):
                apart |= inner[j : j + size]
            gram = (gram ^ np.uint32(n * 0x01000193)) * np.uint32(0x9E3779B1)
            yield ((gram ^ (gram >> np.uint32(15)))[~apart] * np.uint32(0x85EBCA77) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a text; shares add up to less than one."""
    counts = np.zeros(BUCKETS, np.int32)
    for f in features(text):
        counts += np.bincount(f, minlength=BUCKETS).astype(np.int32)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / (CALM + counts.sum())).astype(np.float32)


def train(labels: list[int], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, weights, bias) of two classes, by stochastic gradient descent with a falling rate."""
    random = np.random.default_rng(SEED)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    share = (sum(labels) + 1) / (len(labels) + 2)
    bias[:] = np.log([1 - share, share])
    if len(set(labels)) < 2:
        vectors[:] = 0
        return vectors, weights, bias
    bags = [bag(t) for t in texts]
    target = np.eye(2, dtype=np.float32)[labels]
    steps, done = EPOCHS * len(bags), 0
    weights[:] = random.normal(0, 0.5, weights.shape)
    for _ in range(EPOCHS):
        order = random.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            rate = np.float32(RATE * (1 - done / steps))
            done += len(part)
            hidden = np.stack([s @ vectors[at] if len(at) else np.zeros(DIMENSIONS, np.float32) for at, s in (bags[j] for j in part)])
            logits = hidden @ weights + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            error = p / p.sum(1, keepdims=True) - target[part]
            back = error @ weights.T
            weights -= rate / len(part) * hidden.T @ error
            bias -= rate / len(part) * error.sum(0)
            for j, g in zip(part, back, strict=True):
                at, s = bags[j]
                vectors[at] -= rate * 8 * s[:, None] * g
    return vectors, weights, bias


class Model:
    """Trained parameters, and the score's share per bucket that follows from them."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.vectors, self.weights, self.bias = vectors, weights, bias
        self.by_bucket = (vectors.astype(np.float64) @ (weights[:, 1] - weights[:, 0])).astype(np.float64)
        self.least = float(bias[1] - bias[0])

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for f in features(text):
            total += float(self.by_bucket[f].sum())
            n += len(f)
        return float(1 / (1 + np.exp(-(total / (CALM + n) + self.least))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Train on labelled documents outside the held-out fold. The model has a fixed size."""
    rows = labelled_sample(docs, labels, label, ~held_out(F.col("doc_id"), FOLDS, FOLD), sample)

    def run(_, marks, texts) -> bytes:
        out = io.BytesIO()
        np.savez(out, *train([int(y > 0) for y in marks], list(texts)))
        return out.getvalue()

    with np.load(io.BytesIO(in_one_task(rows, run, "model"))) as arrays:
        return Model(*(arrays[k] for k in arrays.files))


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 for a column of texts."""
    held = SparkSession.active().sparkContext.broadcast((model.vectors, model.weights, model.bias))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = Model(*held.value)
        for texts in batches:
            yield pd.Series([one.score(t) for t in texts], dtype=float)

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels)
    doc_id = F.col("doc_id").cast("long")
    scored = docs.select(
        doc_id.alias("doc_id"), held_out(doc_id, FOLDS, FOLD).alias("held_out"), score(F.col("text").cast("string"), model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words (ASCII lower-cased), and those word beginnings of 4 and 5 bytes that are tied to label 1. Examples are all documents of a bounded
sample of labelled ones (``SAMPLE``) that hold a word, as TF-IDF vectors of unit length over all their terms; a query's
vector has all its terms as well, also those that no example holds. A likelihood-ratio test tells terms that are tied
to label 1; they weigh more, by the ratio over ``RATIO``, and no term weighs less than by TF-IDF. Near copies count once
in this test, or words of a copied document would seem to tell.

Examples are sorted by their strongest term and cut into blocks. The ``FREQUENT`` terms with most postings are held as
dense rows, with the largest weight per block; postings of the other terms are added up for a batch of queries. Blocks
with high upper bounds come first, then those that can still reach a query's k-th best cosine, so the neighbours are
exact; ties go to the smaller doc_id.

Votes of the neighbours are weighted by 1 / (distance + ``NEAR``) squared, so that a copy outweighs the other
neighbours; neighbours that are missing count at distance 1 with the sample's share of label 1. The
votes that examples get from the others are made monotone against their labels with smoothed pooled averages, which
calibrates the score. Documents that share no term with an example have no neighbours; their score is the smoothed share of
label 1 among examples without words.

Defined results: a null or empty text has no terms. Rows that repeat a doc_id are scored each. A null doc_id is held
out. With one label only in the sample there is nothing to compare and all scores are equal. Null labels, and labels without
a document, are left out. An empty table gives no rows. Whole texts count, however long. Further columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import held_out, in_one_task, labelled_sample
from topicloom.llm.decontamination import words
from topicloom.llm.simhash import BKTree, Groups, fingerprint

#: Labelled documents used at most.
SAMPLE = 12_000
#: Likelihood ratio (G squared) from which a term weighs more, and documents it must occur in for that.
RATIO, LEAST = 30.0, 5
#: Bits in which near copies among the examples may differ.
COPIES = 10
BEGINNINGS = (4, 5)
K, NEAR, BLOCK = 15, 0.1, 64
#: Terms held as dense rows, and queries searched at once.
FREQUENT, QUERIES = 384, 64
FOLDS, FOLD = 3, 1
FOUND = "struct<score:double,evidence:array<struct<doc_id:long,label:int,cosine:double>>>"


def bag_of(text: str | None, starts: set | None = None, only: set | None = None) -> dict[bytes, int]:
    """Counts of words and of their beginnings, which are marked by a star; if ``only`` is given, of no other beginnings
    than those in it, whose first four bytes are in ``starts``."""
    found: dict[bytes, int] = Counter(words(text))
    begun: dict[bytes, int] = {}
    for word in found if starts is None else [w for w in found if w[:4] in starts]:
        for n in BEGINNINGS:
            if len(word) > n and (only is None or word[:n] + b"*" in only):
                term = word[:n] + b"*"
                begun[term] = begun.get(term, 0) + found[word]
    dict.update(found, begun)
    return found


def first_copies(texts: list[str]) -> np.ndarray:
    """Places of the first text of each group of near copies (by SimHash)."""
    points = np.array([fingerprint(t) for t in texts], np.uint64)
    distinct, at = np.unique(points, return_inverse=True)
    groups = Groups(len(distinct))
    if len(distinct):
        BKTree(distinct).join(COPIES, groups)
    return np.unique(groups.roots(at), return_index=True)[1]


def emphasis(held: list[np.ndarray], labels: np.ndarray, texts: list[str], width: int) -> np.ndarray:
    """A factor of at least one per term: more for terms that occur in more documents of label 1 than chance gives."""
    marked = np.flatnonzero(labels)
    positive = marked[first_copies([texts[i] for i in marked.tolist()])]

    def frequency(places: np.ndarray) -> np.ndarray:
        return np.bincount(np.concatenate([held[i] for i in places.tolist()]), minlength=width)

    a, b = frequency(positive), frequency(np.flatnonzero(labels == 0))
    ones, zeros = len(positive), int((labels == 0).sum())
    expected = (a + b) * ones / (ones + zeros)
    found = np.flatnonzero((a >= LEAST) & (a > expected))
    a, b, expected = a[found], b[found], expected[found]
    rest = np.where(b > 0, b * np.log(np.maximum(b, 1) / (a + b - expected)), 0.0)
    factors = np.ones(width)
    factors[found] = np.maximum(1.0, 2 * (a * np.log(a / expected) + rest) / RATIO)
    return factors


class BlockMaxIndex:
    """Unit vectors in blocks: dense rows of the frequent terms with their largest weight per block, postings of the others."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.count = len(vectors)
        self.blocks = max(1, -(-self.count // BLOCK))
        ids = np.concatenate([v[0] for v in vectors]) if vectors else np.empty(0, np.int64)
        weights = np.concatenate([v[1] for v in vectors]) if vectors else np.empty(0)
        places = np.repeat(np.arange(self.count), [len(v[0]) for v in vectors])
        frequency = np.bincount(ids, minlength=width)
        often = np.argsort(-frequency, kind="stable")[:FREQUENT]
        self.dense_of = np.full(width, -1, np.int32)
        self.dense_of[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.blocks * BLOCK))
        frequent = self.dense_of[ids] >= 0
        self.dense[self.dense_of[ids[frequent]], places[frequent]] = weights[frequent]
        self.largest = self.dense.reshape(len(often), self.blocks, BLOCK).max(2)
        ids, weights, places = ids[~frequent], weights[~frequent], places[~frequent]
        order = np.argsort(ids, kind="stable")
        self.places, self.weights = places[order], weights[order]
        self.starts = np.concatenate([[0], np.cumsum(np.where(self.dense_of < 0, frequency, 0))])

    def _rare(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The share of the cosines that comes from postings."""
        out = np.zeros((len(queries), self.blocks * BLOCK))
        for row, (ids, weights) in zip(out, queries, strict=True):
            start, end = self.starts[ids], self.starts[ids + 1]
            held = np.flatnonzero(end > start)
            if len(held):
                parts = [slice(i, j) for i, j in zip(start[held].tolist(), end[held].tolist(), strict=True)]
                products = np.repeat(weights[held], end[held] - start[held])
                products *= np.concatenate([self.weights[x] for x in parts])
                row[:] = np.bincount(np.concatenate([self.places[x] for x in parts]), products, len(row))
        return out

    def search_many(self, queries: list, k: int, rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (places, cosines) of the k nearest with a cosine above zero; equal cosines by ``rank``."""
        if not queries or not self.count:
            return [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        scores = self._rare(queries)
        blocks = scores.reshape(len(queries), self.blocks, BLOCK)
        q = np.zeros((len(queries), len(self.dense)))
        for row, (ids, weights) in zip(q, queries, strict=True):
            to = self.dense_of[ids]
            row[to[to >= 0]] = weights[to >= 0]
        bound = q @ self.largest + blocks.max(2)
        columns = self.dense.reshape(len(self.dense), self.blocks, BLOCK)

        def scored(which: np.ndarray) -> None:
            blocks[:, which] += (q @ columns[:, which].reshape(len(self.dense), len(which) * BLOCK)).reshape(len(queries), -1, BLOCK)

        early = np.argsort(-bound.max(0), kind="stable")[: max(1, -(-self.blocks // 8))]
        scored(early)
        seen = np.sort(blocks[:, early].reshape(len(queries), -1), 1)
        least = seen[:, -k] if seen.shape[1] >= k else np.zeros(len(queries))
        late = np.ones(self.blocks, bool)
        late[early] = False
        late = np.flatnonzero(late)
        open_blocks = bound >= least[:, None] - 1e-9
        late = late[open_blocks[:, late].any(0)]
        if len(late):
            scored(late)
        skipped = np.ones(self.blocks, bool)
        skipped[early] = skipped[late] = False
        blocks[:, skipped] = 0.0  # no document of theirs is among the k nearest
        out = []
        for row in scores:
            least_of_k = np.partition(row, -k)[-k] if len(row) > k else 0.0
            at = np.flatnonzero((row >= least_of_k - 1e-9) & (row > 0))
            cosines = np.round(row[at], 12)
            at, cosines = at[cosines > 0], cosines[cosines > 0]
            order = np.lexsort((rank[at], -cosines))[:k]
            out.append((at[order], cosines[order]))
        return out

    def search(self, ids: np.ndarray, weights: np.ndarray, k: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.search_many([(ids, weights)], k, rank)[0]


class Model:
    """Terms and their weights, examples, their index, and the calibration."""

    def __init__(self, doc_ids: list[int], labels: list[int], texts: list[str]):
        marks = np.array([int(y > 0) for y in labels], np.int64)
        n, ones = len(marks), int(marks.sum())
        self.number: dict[bytes, int] = {}
        self.weights, self.unknown = np.empty(0), 1.0
        rows = []
        self.share = share = (ones + 1) / (n + 2)
        if 0 < ones < n:
            held, counts = [], []
            for text in texts:
                bag = bag_of(text)
                held.append(np.array([self.number.setdefault(t, len(self.number)) for t in bag], np.int32))
                counts.append(np.fromiter(bag.values(), np.int32, len(bag)))
            width = len(self.number)
            idf = np.log((1 + n) / (1 + np.bincount(np.concatenate(held), minlength=width))) + 1
            factors = emphasis(held, marks, texts, width)
            kept = (factors > 1) | np.array([not t.endswith(b"*") for t in self.number])
            new = np.cumsum(kept, dtype=np.int32) - 1
            counts = [c[kept[h]] for h, c in zip(held, counts, strict=True)]
            held = [new[h[kept[h]]] for h in held]
            self.number = {t: i for i, t in enumerate(t for t, k in zip(self.number, kept.tolist(), strict=True) if k)}
            self.weights, self.unknown = (idf * factors)[kept], math.log(1 + n) + 1
            strongest = [int(h[np.argmax((1 + np.log(c)) * self.weights[h])]) if len(h) else -1 for h, c in zip(held, counts, strict=True)]
            rows = sorted((s, i, y, at) for at, (s, i, y) in enumerate(zip(strongest, doc_ids, marks.tolist(), strict=True)) if s >= 0)
        plain = [int(y) for y, t in zip(marks, texts, strict=True) if not rows or not words(t)]
        self.without = (sum(plain) + share) / (len(plain) + 1)
        self.doc_ids, self.labels = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        self.held, self.counts = [held[r[3]] for r in rows], [counts[r[3]] for r in rows]
        self._prepare()
        self._calibrate(share)

    def _prepare(self) -> None:
        self.begun = {t for t in self.number if t.endswith(b"*")}
        self.starts = {t[:4] for t in self.begun}
        self.index = BlockMaxIndex([self.vector(*x) for x in zip(self.held, self.counts, strict=True)], len(self.weights))

    def __getstate__(self):
        import zstandard

        state = {k: v for k, v in self.__dict__.items() if k not in ("index", "number", "begun", "starts", "held", "counts")}
        state["sizes"] = [len(x) for x in self.held]
        whole = [np.concatenate(x).tobytes() if x else b"" for x in (self.held, self.counts)]
        state["packed"] = [zstandard.ZstdCompressor().compress(x) for x in (b" ".join(self.number), *whole)]
        return state

    def __setstate__(self, state):
        import zstandard

        names, held, counts = (zstandard.ZstdDecompressor().decompress(x) for x in state.pop("packed"))
        ends = np.cumsum(state.pop("sizes"))[:-1]
        self.__dict__.update(state)
        self.number = {t: i for i, t in enumerate(names.split())}
        self.held, self.counts = (np.split(np.frombuffer(x, np.int32), ends) if len(self.doc_ids) else [] for x in (held, counts))
        self._prepare()

    def vector(self, ids: np.ndarray, counts: np.ndarray, others: np.ndarray | tuple = ()) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights of unit length; ``others`` are the counts of terms that no example holds."""
        weights = (1 + np.log(counts)) * self.weights[ids]
        outside = (1 + np.log(others)) * self.unknown if len(others) else np.empty(0)
        return ids, weights / math.sqrt(weights @ weights + outside @ outside)

    def query(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        bag = bag_of(text, self.starts, self.begun)
        ids, counts = np.fromiter(map(self.number.get, bag, repeat(-1)), np.int64, len(bag)), np.fromiter(bag.values(), np.int64, len(bag))
        known = ids >= 0
        return self.vector(ids[known], counts[known], counts[~known]) if known.any() else (np.empty(0, np.int64), np.empty(0))

    def votes(self, queries: list, leave: np.ndarray | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each query the vote, and the places and cosines it rests on; ``leave`` has a place to leave out for each."""
        found, out = self.index.search_many(queries, K + (leave is not None), self.doc_ids), []
        for i, (at, cosines) in enumerate(found):
            keep = ((at != leave[i]).nonzero()[0] if leave is not None else np.arange(len(at)))[:K]
            at, cosines = at[keep], cosines[keep]
            votes = 1 / (1 - cosines + NEAR) ** 2
            missing = (K - len(at)) / (1 + NEAR) ** 2
            vote = (votes @ self.labels[at] + missing * self.share) / (votes.sum() + missing)
            out.append((float(vote) if len(at) else math.nan, at, cosines))
        return out

    def _calibrate(self, share: float) -> None:
        votes: list[tuple[float, int]] = []
        for i in range(0, len(self.held), QUERIES):
            part = np.arange(i, min(i + QUERIES, len(self.held)))
            own = [self.vector(self.held[j], self.counts[j]) for j in part.tolist()]
            votes += zip([v[0] for v in self.votes(own, part)], self.labels[part].tolist(), strict=True)
        pools: list[list[float]] = []  # [least vote, sum of labels, count, largest vote]
        for vote, y in sorted(x for x in votes if not math.isnan(x[0])):
            if pools and pools[-1][3] == vote:
                pools[-1][1] += y
                pools[-1][2] += 1
            else:
                pools.append([vote, y, 1, vote])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                _, ys, m, high = pools.pop()
                pools[-1][1] += ys
                pools[-1][2] += m
                pools[-1][3] = high
        # level in a pool, straight lines between pools
        self.steps = np.array([x for p in pools for x in (p[0], p[3])])
        self.levels = np.maximum.accumulate([(p[1] + share) / (p[2] + 1) for p in pools for _ in range(2)]) if pools else np.empty(0)

    def judge(self, texts: list[str | None]) -> list[dict]:
        """Scores, and the neighbours they rest on."""
        if not len(self.doc_ids):
            return [{"score": self.without, "evidence": []}] * len(texts)
        known: dict[str | None, dict] = {}
        distinct = list(dict.fromkeys(texts))
        for i in range(0, len(distinct), QUERIES):
            part = distinct[i : i + QUERIES]
            for text, (vote, at, cosines) in zip(part, self.votes([self.query(t) for t in part]), strict=True):
                score = self.without
                if not math.isnan(vote) and len(self.steps):
                    score = float(np.interp(vote, self.steps, self.levels))
                rows = zip(self.doc_ids[at].tolist(), self.labels[at].tolist(), cosines.tolist(), strict=True)
                known[text] = {"score": score, "evidence": [{"doc_id": i, "label": y, "cosine": c} for i, y, c in rows]}
        return [known[t] for t in texts]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Take examples from labelled documents outside the held-out fold; bounded by ``sample``."""
    rows = labelled_sample(docs, labels, label, ~held_out(F.col("doc_id"), FOLDS, FOLD), sample)
    return pickle.loads(in_one_task(rows, lambda *columns: pickle.dumps(Model(*map(list, columns))), "model"))


def toxicity(text: Column, model: Model) -> Column:
    """Struct column: score, and the nearest examples as evidence."""
    held = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf(FOUND)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(held.value.judge(texts.tolist()), columns=["score", "evidence"])

    return judged(text)


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every document."""
    model = fit(docs, labels)
    doc_id = F.col("doc_id").cast("long")
    found = docs.select(
        doc_id.alias("doc_id"), held_out(doc_id, FOLDS, FOLD).alias("held_out"), toxicity(F.col("text").cast("string"), model).alias("found")
    )
    predicted = (F.col("found.score") >= threshold).cast("int").alias("predicted")
    return found.select("doc_id", "held_out", F.col("found.score").alias("score"), predicted, F.col("found.evidence").alias("evidence"))

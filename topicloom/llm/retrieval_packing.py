"""Lexical retrieval packing: windows of token ids, each filled with documents that are like its first one.

A document's ids fill whole windows of their own as far as they go; the rest, its tail, is packed with others. Tails are
dealt to shards of bounded size, each with an inverted index of BM25 weights of its documents' token ids (whole
documents, not only tails; document frequencies, their number and mean length are those of all documents). The first
unused document of a shard is a seed: the index returns the unused documents in the order of their scores for all
distinct ids of the seed, and they fill the window; that which doesn't fit is cut there, and the rest of it is the next
seed. So all windows of a shard are full but the last, which is cut into sequences whose lengths are powers of two.

To have neighbours meet, documents are placed along a line by their heaviest id (BM25 weight), and shards are stretches
of it of equal weight. An id that is the heaviest of many documents takes more than one stretch, over which they are
spread by row, copies too. What the driver and tasks share is a number per entry of the vocabulary.

Defined results: a null or empty text is its end id alone and has no terms; such documents are placed first. Rows that
repeat a doc_id are packed each for itself. A null doc_id stays null. Equal scores go by place in the shard. An empty
table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import spans_of, stage
from topicloom.llm.tokens import ID, _gather, default_path, encoder

CAPACITY = 2048
#: BM25's parameters.
K1, B = 1.2, 0.75
#: Weight of a shard: a document weighs the tokens of its tail, and ``OWN`` for being one.
SHARD, OWN = 1 << 20, 512
#: A list of postings that holds one in so many documents of its shard is kept as a full row of weights.
DENSE = 8

STAGED = "doc_id long, n long, tail binary, heads array<long>, bag binary, times binary, terms array<int>, docs array<long>"
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _bag(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(ids, return_counts=True)


def tokenized(docs: DataFrame, capacity: int, end_id: int, path: str) -> DataFrame:
    """Staged rows of documents: number of ids, ids of the tail, checksums of the full windows before it, and, if there
    are any, the distinct ids of the whole document and how often it has them. Each task adds a row with the number of its
    documents that hold an id."""
    names = [c.strip().split(" ")[0] for c in STAGED.split(",")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, end = encoder(path), ID.type(end_id)
        held = np.zeros(one.tokenizer.get_vocab_size(), np.int64)

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

        for batch in batches:
            found = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), one.documents(batch.column(1)), strict=True):
                terms, times = _bag(ids)
                held[terms] += 1
                whole = np.append(ids, end)
                tail = len(whole) // capacity * capacity
                heads = [zlib.crc32(whole[i : i + capacity]) for i in range(0, tail, capacity)]
                bag = (terms.astype(ID).tobytes(), times.astype(ID).tobytes()) if tail else (None, None)
                found.append((doc_id, len(whole), whole[tail:].astype(ID).tobytes(), heads, *bag, None, None))
            if found:
                yield rows(found)
        terms = np.flatnonzero(held)
        yield rows([(None, None, None, None, None, None, terms.tolist(), held[terms].tolist())])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(plain.mapInArrow(run, STAGED), "lexical-tokens")


class Weights:
    """BM25 weights from the statistics of all documents. Its size is that of the vocabulary."""

    def __init__(self, docs: int, tokens: int, held: dict[int, int], vocabulary: int):
        found = np.zeros(vocabulary)
        found[list(held)] = list(held.values())
        self.idf = np.log1p((docs - found + 0.5) / (found + 0.5)).astype(np.float32)
        self.mean = max(1.0, tokens / max(1, docs))

    def of(self, terms: np.ndarray, times: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return self.idf[terms] * (times * (K1 + 1) / (times + K1 * (1 - B + B * length / self.mean))).astype(np.float32)


def weights(staged: DataFrame, vocabulary: int) -> Weights:
    """Statistics of all documents: one row per entry of the vocabulary reaches the driver."""
    sums = staged.filter("n is not null").agg(F.count("n"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()
    held = staged.filter("n is null").select(F.explode(F.arrays_zip("terms", "docs")).alias("x"))
    counts = held.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.docs").alias("docs")).collect()
    return Weights(sums[0], sums[1], {r.term: r.docs for r in counts}, vocabulary)


def _bags(batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct ids, how often) of each document, without its end id."""
    for tail, bag, times in zip(batch["tail"].to_pylist(), batch["bag"].to_pylist(), batch["times"].to_pylist(), strict=True):
        if bag is None:
            yield _bag(np.frombuffer(tail, ID)[:-1])
        else:
            yield np.frombuffer(bag, ID), np.frombuffer(times, ID)


def placed(staged: DataFrame, weight: Weights, capacity: int) -> DataFrame:
    """Documents with tails, and the shard of each."""
    def heaviest(batch) -> np.ndarray:
        found = []
        for (terms, times), n in zip(_bags(batch), batch["n"].to_pylist(), strict=True):
            found.append(int(terms[np.argmax(weight.of(terms, times, n - 1))]) + 1 if len(terms) else 0)
        return np.array(found, np.int64)

    size = len(weight.idf) + 1

    def load(batch) -> np.ndarray:
        return batch["n"].to_numpy(zero_copy_only=False).astype(np.int64) % capacity + OWN

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            np.add.at(total, heaviest(batch), load(batch))
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total[keys])], ["key", "load"])

    tails = staged.filter(F.col("n") % capacity > 0)
    found = tails.select("n", "tail", "bag", "times").mapInArrow(sums, "key long, load long")
    loads = np.zeros(size, np.int64)
    for row in found.groupBy("key").agg(F.sum("load").alias("load")).collect():  # at most one row per entry of the vocabulary
        loads[row.key] = row.load
    before = np.cumsum(loads) - loads

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = heaviest(batch)
            at = before[key] + (batch["spread"].to_numpy() * loads[key]).astype(np.int64)
            yield batch.append_column("shard", pa.array(at // SHARD))

    # row numbers of a staged table: a repeated task finds the same
    row = F.monotonically_increasing_id()
    spread = (F.pmod(F.xxhash64(row), F.lit(1 << 30)) / float(1 << 30)).alias("spread")
    rows = tails.select("doc_id", "n", "tail", "bag", "times", row.alias("row"), spread)
    return rows.mapInArrow(shards, "doc_id long, n long, tail binary, bag binary, times binary, row long, spread double, shard long")


class Index:
    """Inverted index over the documents of one shard: rare ids have lists of (document, weight), common ones a full row."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], lengths: np.ndarray, weight: Weights):
        self.n = len(bags)
        sizes = np.array([len(t) for t, _ in bags], np.int64)
        self.at = spans_of(sizes)
        terms = np.concatenate([t for t, _ in bags]).astype(np.int64)
        times = np.concatenate([c for _, c in bags])
        docs = np.repeat(np.arange(self.n), sizes)
        values = weight.of(terms, times, lengths[docs] - 1)
        _, self.terms, counts = np.unique(terms, return_inverse=True, return_counts=True)
        order = np.argsort(self.terms, kind="stable")
        self.docs, self.values = docs[order], values[order]
        self.counts, self.starts = counts, spans_of(counts)[:-1]
        dense = counts * DENSE >= self.n
        self.row_of = np.where(dense, np.cumsum(dense) - 1, -1)
        self.rows = np.zeros((np.count_nonzero(dense), self.n), np.float32)
        row = np.repeat(self.row_of, counts)
        self.rows[row[row >= 0], self.docs[row >= 0]] = self.values[row >= 0]

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document for the distinct ids of one of them."""
        terms = self.terms[self.at[doc] : self.at[doc + 1]]
        rows = self.row_of[terms]
        rare = terms[rows < 0]
        held = _gather(self.docs, self.starts, self.counts, rare)
        values = _gather(self.values, self.starts, self.counts, rare)
        return self.rows[rows[rows >= 0]].sum(0) + np.bincount(held, values, self.n).astype(np.float32)

    def ranked(self, doc: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents, best first."""
        scores = self.scores(doc)
        left = np.flatnonzero(unused)
        while len(left):
            few = min(16, len(left))
            value = scores[left]
            least = np.partition(value, len(left) - few)[len(left) - few]
            top = left[value >= least]
            yield from top[np.argsort(-scores[top], kind="stable")].tolist()
            left = left[value < least]


def windows(lengths: np.ndarray, index: Index, capacity: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start in its tail, length); all full but the last."""
    unused = np.ones(len(lengths), bool)
    seed, start = 0, 0
    while seed < len(lengths):
        unused[seed] = False
        window = [(seed, start, int(lengths[seed]) - start)]
        room = capacity - window[0][2]
        follow = None
        for doc in index.ranked(seed, unused) if room else ():
            size = min(int(lengths[doc]), room)
            unused[doc] = False
            window.append((doc, 0, size))
            room -= size
            if size < lengths[doc]:
                follow = (doc, size)
            if not room:
                break
        yield window
        if follow:
            seed, start = follow
        else:
            start = 0
            while seed < len(lengths) and not unused[seed]:
                seed = int(np.argmax(unused)) if unused.any() else len(lengths)


def powers_of_two(window: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """A window cut into sequences whose lengths are powers of two, the longest first."""
    left = sum(size for *_, size in window)
    pieces = window[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        sequence = []
        while room:
            doc, start, size = pieces.pop()
            if size > room:
                pieces.append((doc, start + room, size - room))
                size = room
            sequence.append((doc, start, size))
            room -= size
        yield sequence


def pack(staged: DataFrame, weight: Weights, capacity: int) -> DataFrame:
    """Pieces of all tails, shard by shard."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row").combine_chunks()
        n = table["n"].to_numpy()
        tails = [np.frombuffer(t, ID) for t in table["tail"].to_pylist()]
        lengths = np.array([len(t) for t in tails], np.int64)
        index = Index(list(_bags(table)), n, weight)
        doc_ids, shard = table["doc_id"].to_pylist(), table["shard"][0].as_py()
        rows, no = [], 0
        for window in windows(lengths, index, capacity):
            whole = sum(size for *_, size in window) == capacity
            for sequence in [window] if whole else powers_of_two(window):
                offset = 0
                for doc, start, size in sequence:
                    before = int(n[doc] - lengths[doc])
                    crc = zlib.crc32(tails[doc][start : start + size])
                    rows.append((doc_ids[doc], before + start, size, crc, int(n[doc]), (shard << 32) + no, offset))
                    offset += size
                no += 1
        names = [c.strip().split(" ")[0] for c in RESULT.split(",")]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return placed(staged, weight, capacity).groupBy("shard").applyInArrow(run, RESULT)


def retrieval_packing(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Pack documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``capacity`` is a power of two."""
    path = path or default_path()
    staged = tokenized(docs, capacity, end_id, path)
    weight = weights(staged, encoder(path).tokenizer.get_vocab_size())
    heads = staged.filter("size(heads) > 0").select("doc_id", "n", F.posexplode("heads").alias("i", "crc"))
    full = heads.select(
        "doc_id",
        (F.col("i").cast("long") * capacity).alias("start"),
        F.lit(capacity).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return full.unionByName(pack(staged, weight, capacity))

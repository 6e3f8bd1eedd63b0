"""Benchmark decontamination by winnowing.

A window is ``width`` consecutive words of a benchmark item; an item of fewer words is one window. Items of at
least ``width`` words form one class, shorter ones a class for each length n. In a class with windows of n words,
k-grams of k = ceil(n / 2) words are hashed, and of the n - k + 1 k-grams in a window the smallest hash is kept
(the last of equal ones). Equal windows keep the same k-gram at the same place, so every occurrence of a
window is found by joining the kept fingerprints of documents and items; each hit is then extended to both
sides as far as the words agree, and counts if it spans n words. Hashes only propose: words are compared.

Items are dealt to blocks of about ``BLOCK_BYTES`` of text; each block's index is built by a task and written to
the shared folder. Documents stay where they are: a task joins each batch with one block at a time, so memory
is bounded whatever the benchmark's size, and no row of documents is shuffled.

Defined results: a null or empty text has no words, no hits and isn't contaminated; the digest of no items is that
of the empty string. Rows that repeat a document are judged each for itself; repeated item ids count once; null item
ids count as one item that the digest leaves out. Items without words match nothing. Further columns are kept by
``with_hits``. Very long texts are one row as any other; their words are held at once.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import created, filesystem, new_folder, own_name, spans_of

WIDTH = 13
BLOCK_BYTES = 16 << 20
#: Documents are joined in batches of about so many bytes.
BATCH_BYTES = 4 << 20
#: Lower-cases A-Z, keeps a-z, 0-9 and all bytes outside ASCII, and turns the rest into spaces.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)
FOUND = "struct<n_words:long,n_hit:long,n_items:long,items:array<long>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) kept of a sequence of word ids, where windows hold positive ids only."""
    k = -(-n // 2)
    w = n - k + 1
    if len(ids) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    bad = spans_of(ids <= 0)
    starts = np.flatnonzero(bad[n:] == bad[:-n])
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    # k-grams of these windows only
    need = np.zeros(len(ids) + 1, np.int32)
    np.add.at(need, starts, 1)
    np.add.at(need, starts + w, -1)
    at = np.flatnonzero(np.cumsum(need[:-1]) > 0)
    hashes = np.zeros(len(at), np.uint64)
    for j in range(k):
        hashes = (hashes + ids[at + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    hashes = _mixed(hashes + np.uint64(n))
    first = np.searchsorted(at, starts)
    best, kept = hashes[first], first.copy()
    for j in range(1, w):
        other = hashes[first + j]
        better = other <= best
        best = np.where(better, other, best)
        kept[better] = first[better] + j
    kept = np.unique(kept)
    return at[kept], hashes[kept]


def build_index(item_ids: list[int | None], texts: list[str | None], width: int) -> dict[str, np.ndarray]:
    """Arrays of a block: vocabulary, the items' words as ids, and fingerprints with their places."""
    vocabulary: dict[bytes, int] = {}
    numbers, sizes = [np.array([-1], np.int64)], []
    for text in texts:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
        sizes.append(len(ids))
        numbers.append(np.array([*ids, -1], np.int64))
    flat, starts = np.concatenate(numbers), 1 + spans_of(np.array(sizes, np.int64) + 1)
    classes, places, hashes = [], [], []
    for i, size in enumerate(sizes):
        if size:
            at, h = fingerprints(flat[starts[i] : starts[i] + size], min(size, width))
            classes.append(np.full(len(at), min(size, width), np.int64))
            places.append(at + starts[i])
            hashes.append(h)
    join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    cls, place, h = join(classes, np.int64), join(places, np.int64), join(hashes, np.uint64)
    order = np.lexsort((place, h, cls))
    return {
        "words": np.array(b" ".join(vocabulary)),
        "flat": flat,
        "starts": starts[:-1],
        "item_ids": np.array([x or 0 for x in item_ids], np.int64),
        "item_null": np.array([x is None for x in item_ids], bool),
        "classes": cls[order],
        "places": place[order],
        "hashes": h[order],
    }


@lru_cache(maxsize=1)
def load_index(path: str) -> dict:
    store, at = filesystem(path)
    with store.open_input_file(at) as source, np.load(io.BytesIO(source.read())) as arrays:
        index = dict(arrays)
    listed = index.pop("words").item()
    index["vocabulary"] = {w: i for i, w in enumerate(listed.split(b" "), 1)} if listed else {}
    return index


def occurrences(ids: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, item number) of all maximal common spans that hold a window."""
    flat, found = index["flat"], []
    for n in np.unique(index["classes"]).tolist():
        low, high = np.searchsorted(index["classes"], [n, n + 1])
        known = index["hashes"][low:high]
        at, h = fingerprints(ids, n)
        left, right = np.searchsorted(known, h), np.searchsorted(known, h, "right")
        times = right - left
        p = np.repeat(at, times)
        q = index["places"][low + np.repeat(left, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        back, ahead = _agree(ids, flat, p - 1, q - 1, -1), _agree(ids, flat, p, q, 1)
        long = back + ahead >= n
        item = np.searchsorted(index["starts"], q[long], "right") - 1
        found.append((p[long] - back[long], p[long] + ahead[long], item))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def _agree(ids: np.ndarray, flat: np.ndarray, p: np.ndarray, q: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from (p, q) on in one direction. Both sequences are fenced by other numbers."""
    count, live = np.zeros(len(p), np.int64), np.arange(len(p))
    while len(live):
        same = ids[p[live] + step * count[live]] == flat[q[live] + step * count[live]]
        live = live[same]
        count[live] += 1
    return count


def judge(texts: list[str | None], blocks: list[str]) -> list[dict]:
    """Words, hit words and items of each text, against every block of the benchmark."""
    docs = [words(t) for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = 1 + spans_of(sizes + 1)
    hit = np.zeros(int(starts[-1]) + 1, np.int64)
    items: list[dict] = [{} for _ in docs]
    for path in blocks:
        index = load_index(path)
        get = index["vocabulary"].get
        ids = np.zeros(int(starts[-1]), np.int64)
        for start, doc in zip(starts.tolist(), docs, strict=False):
            ids[start : start + len(doc)] = [get(w, 0) for w in doc]
        begin, end, item = occurrences(ids, index)
        np.add.at(hit, begin, 1)
        np.add.at(hit, end, -1)
        doc = np.searchsorted(starts, begin, "right") - 1
        for d, i in np.unique(np.stack([doc, item], 1), axis=0).tolist() if len(doc) else []:
            items[d][None if index["item_null"][i] else int(index["item_ids"][i])] = True
    covered = spans_of(np.cumsum(hit) > 0)
    n_hit = covered[starts[:-1] + sizes] - covered[starts[:-1]]
    return [
        {"n_words": int(n), "n_hit": int(h), "n_items": len(found), "items": [x for x in found if x is not None]}
        for n, h, found in zip(sizes, n_hit, items, strict=True)
    ]


def write_index(benchmark: DataFrame, folder: str, width: int = WIDTH) -> list[str]:
    """Index the benchmark (item_id, text) in blocks; returns the blocks' files, one name per ``BLOCK_BYTES``."""
    created(folder)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 + size // BLOCK_BYTES

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item_id", "text"], kind="stable", na_position="first")
        ids = [None if pd.isna(x) else int(x) for x in rows["item_id"]]
        texts = [x if isinstance(x, str) else None for x in rows["text"]]
        held = io.BytesIO()
        np.savez(held, **build_index(ids, texts, width))
        store, root = filesystem(folder)
        name = own_name(int(rows["block"].iloc[0]), ".npz")
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(held.getvalue())
        return pd.DataFrame({"file": [name]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)).cast("long"))
    files = dealt.groupBy("block").applyInPandas(build, "file string")
    return sorted(f"{folder}/{row.file}" for row in files.collect())


def hits(text: Column, blocks: list[str]) -> Column:
    """Struct column: n_words, n_hit, n_items, items."""

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows: list[dict] = []
            part: list[str | None] = []
            size = 0
            for t in texts:
                part.append(t)
                size += len(t or "")
                if size > BATCH_BYTES:
                    rows += judge(part, blocks)
                    part, size = [], 0
            rows += judge(part, blocks)
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items"])

    return find(text)


def contaminated(found: str) -> Column:
    """The rule: at least one hit word, and at least a twentieth of all words hit."""
    return (F.col(f"{found}.n_hit") > 0) & (20 * F.col(f"{found}.n_hit") >= F.col(f"{found}.n_words"))


def with_hits(docs: DataFrame, benchmark: DataFrame, into: str, width: int = WIDTH) -> DataFrame:
    """``docs`` with the struct of ``hits`` as a further column named ``into``."""
    blocks = write_index(benchmark, new_folder(docs.sparkSession, "benchmark-index"), width)
    return docs.withColumn(into, hits(F.col("text").cast("string"), blocks))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = with_hits(slim, benchmark, "found", width)
    listed = F.array_join(F.array_sort(F.col("found.items").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        "found.n_items",
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        contaminated("found").alias("contaminated"),
    )

"""Token-id files: a shared zstandard dictionary, a frame per document, and an offset index.

A data set is a folder with one dictionary and any number of files; documents lie in ascending id order
within a file and over the files. Layout of a file, integers little-endian:

    magic (8 bytes) | SHA-256 of the dictionary (32 bytes)
    one zstandard frame per document: its ids as unsigned integers of 2 or 4 bytes
    index: per document doc_id (i8), is_null (u1), frame offset (u8), ids before it in this file (u8), n ids (u8), as columns
    footer: documents (u8), bytes per id (u8), index offset (u8), magic (8 bytes)

So one document is read with the footer, the index and one frame. Files are named by the attempt that
wrote them; the manifest (a table in the same folder) lists those of finished attempts, in order.

Defined results: a null or empty text has the end id only. A null doc_id comes first. Rows that repeat a
doc_id are all kept, in the order of their texts' hashes. An empty table gives a data set without files.
Further columns are ignored. The dictionary is trained on the ids of at most ``SAMPLE_DOCS`` documents (those
with the smallest hashes of their ids; repeated ids at most double it), at most ``SAMPLE_IDS`` ids of each; it changes sizes, not content. With
too few of them for training, it is empty.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.llm.common import created, filesystem, new_folder, own_name
from topicloom.llm.tokens import ID, default_path, encoder, token_ids

MAGIC = b"TOKIDS01"
FOOTER = "<QQQ8s"
INDEX = (("doc_id", "<i8"), ("is_null", "u1"), ("offset", "<u8"), ("before", "<u8"), ("n", "<u8"))
SAMPLE_DOCS = 2000
SAMPLE_IDS = 2048
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
READ_BATCH = 1 << 22

MANIFEST = "part int, file string, documents long, tokens long"
TOKENS = "doc_id long, file_start long, n_tokens long, ids binary"


@dataclass(frozen=True)
class Dataset:
    """Where a data set lies. The dictionary is at most ``DICTIONARY_BYTES`` long and travels with tasks."""

    folder: str
    dictionary: bytes

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")


def _packed(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, path: str, end_id: int, width: int) -> bytes:
    """A dictionary from the serialized ids of a bounded sample of documents; empty if they are too few."""
    import zstandard

    order = F.xxhash64("doc_id")
    first = docs.filter("doc_id is not null").select(order.alias("order")).orderBy("order").limit(SAMPLE_DOCS).collect()
    if not first:
        return b""
    # only ids are sorted; the texts are picked by their ids' hashes, and repeated ids are bounded as well
    chosen = docs.filter("doc_id is not null").filter(order <= first[-1].order).filter("length(text) > 0")
    head = F.substring("text", 1, 8 * SAMPLE_IDS)
    sample = chosen.select(head.alias("text")).limit(2 * SAMPLE_DOCS).select(token_ids(F.col("text"), path).alias("ids"))
    ids = (np.frombuffer(r.ids, ID)[:SAMPLE_IDS] for r in sample.collect())
    samples = [_packed(np.append(x, ID.type(end_id)), width) for x in ids]
    if len(samples) < 16 or sum(map(len, samples)) < 8192:
        return b""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()


def _zstd(dictionary: bytes):
    import zstandard

    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held), zstandard.ZstdDecompressor(dict_data=held)


def write(docs: DataFrame, folder: str, end_id: int, path: str | None = None) -> Dataset:
    """Tokenize ``docs`` (doc_id, text) and write them as a data set below ``folder``."""
    path = path or default_path()
    width = 2 if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionary = train_dictionary(docs, path, end_id, width)
    store, root = created(folder)
    with store.open_output_stream(f"{root}/dictionary", compression=None) as out:
        out.write(dictionary)

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, (compressor, _) = encoder(path), _zstd(dictionary)
        store, root = filesystem(folder)
        part = TaskContext.get().partitionId()
        out, name, index, at, before = None, own_name(part, ".ids"), [], 40, 0
        try:
            for batch in batches:
                frames = []
                for doc_id, ids in zip(batch.column(0).to_pylist(), one.documents(batch.column(1)), strict=True):
                    ids = np.append(ids, ID.type(end_id))
                    frame = compressor.compress(_packed(ids, width))
                    index.append((doc_id or 0, doc_id is None, at, before, len(ids)))
                    frames.append(frame)
                    at += len(frame)
                    before += len(ids)
                if frames and out is None:
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(MAGIC + hashlib.sha256(dictionary).digest())
                if frames:
                    out.write(b"".join(frames))
            if out is not None:
                for values, (_, kind) in zip(zip(*index, strict=True), INDEX, strict=True):
                    out.write(np.array(values, kind).tobytes())
                out.write(struct.pack(FOOTER, len(index), width, at, MAGIC))
        finally:
            if out is not None:
                out.close()
        if index:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "documents": [len(index)], "tokens": [before]})

    placed = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    )
    placed.mapInArrow(write_part, MANIFEST).write.parquet(f"{folder}/manifest")
    return Dataset(folder, dictionary)


class File:
    """Reads one file: its index, and single documents by position."""

    def __init__(self, store, path: str, dictionary: bytes):
        self.source = store.open_input_file(path)
        size = self.source.size()
        head = self.source.read_at(40, 0)
        tail = size - struct.calcsize(FOOTER)
        self.documents, self.width, self.index_at, magic = struct.unpack(FOOTER, self.source.read_at(size - tail, tail))
        if head[:8] != MAGIC or magic != MAGIC:
            raise ValueError(f"{path} is not a token-id file")
        if head[8:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        data, at, self.index = self.source.read_at(tail - self.index_at, self.index_at), 0, {}
        for name, kind in INDEX:
            n = self.documents * np.dtype(kind).itemsize
            self.index[name] = np.frombuffer(data[at : at + n], kind)
            at += n
        self.ends = np.append(self.index["offset"][1:], np.uint64(self.index_at)).astype(np.int64)
        self.decompressor = _zstd(dictionary)[1]

    def find(self, doc_id: int) -> list[int]:
        """Positions of a document id, by bisection."""
        known = int(self.index["is_null"].sum())  # null ids lie in front
        ids = self.index["doc_id"][known:]
        return list(range(known + int(np.searchsorted(ids, doc_id)), known + int(np.searchsorted(ids, doc_id, "right"))))

    def ids(self, i: int) -> np.ndarray:
        """Ids of the document at position ``i``; reads its frame only."""
        at = int(self.index["offset"][i])
        return self._decode(self.source.read_at(int(self.ends[i]) - at, at), i)

    def _decode(self, frame: bytes, i: int) -> np.ndarray:
        data = self.decompressor.decompress(frame, max_output_size=int(self.index["n"][i]) * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype(ID)

    def all_ids(self) -> Iterator[tuple[int, np.ndarray]]:
        """(position, ids) of every document, reading the file front to back in bounded pieces."""
        first = 0
        while first < self.documents:
            start = int(self.index["offset"][first])
            last = max(first + 1, int(np.searchsorted(self.ends, start + READ_BATCH, "right")))
            data = self.source.read_at(int(self.ends[last - 1]) - start, start)
            for i in range(first, last):
                yield i, self._decode(data[int(self.index["offset"][i]) - start : int(self.ends[i]) - start], i)
            first = last


def read(spark: SparkSession, dataset: Dataset, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids as bytes.

    Files are independent tasks. The manifest has one row per file, so its running sum is small.
    """
    folder, dictionary = dataset.folder, dataset.dictionary
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = dataset.manifest(spark).withColumn("first", F.coalesce(before, F.lit(0)))
    count = max(1, files.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                one = File(store, f"{root}/{row['file']}", dictionary)
                rows: list[tuple] = []
                size = 0
                for i, ids in one.all_ids():
                    data = ids.tobytes()
                    doc_id = None if one.index["is_null"][i] else int(one.index["doc_id"][i])
                    rows.append((doc_id, row["first"] + int(one.index["before"][i]), len(ids), zlib.crc32(data), *[data] * with_ids))
                    size += 64 + len(data) * with_ids
                    if size > READ_BATCH:
                        yield _rows(rows, with_ids)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows, with_ids)

    return files.select("file", "first").repartition(count, "file").mapInArrow(read_files, schema)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def token_files(docs: DataFrame, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write ``docs`` in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    return read(spark, write(docs, new_folder(spark, "token-files"), end_id, path), with_ids=False)

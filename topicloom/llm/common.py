"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.session import new_folder, stage

__all__ = ["created", "filesystem", "new_folder", "own_name", "held_out", "segments", "stage", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder or file that all machines share."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def created(folder: str):
    """The same, after making the folder."""
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    return store, path


def own_name(partition: int, suffix: str) -> str:
    """A file name that no other attempt of the same task uses. What a lost or repeated attempt has
    written is never read: readers go by the manifest, which holds the names of finished attempts."""
    return f"part-{partition:06d}-{uuid.uuid4().hex}{suffix}"


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether a document is kept from training: by the CRC-32 of its id as text. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def segments(text: str | None, most: int = 1 << 20) -> Iterator[bytes]:
    """The UTF-8 bytes of a text in pieces of at most ``most`` bytes that end at ASCII white space where
    there is any. The cuts depend on the text alone, so results don't depend on its neighbours."""
    data = (text or "").encode("utf-8", "surrogatepass")
    at = 0
    while len(data) - at > most:
        cut = max(data.rfind(b" ", at, at + most), data.rfind(b"\n", at, at + most)) + 1 or at + most
        yield data[at:cut]
        at = cut
    yield data[at:]


def spans_of(lengths: np.ndarray) -> np.ndarray:
    """Starts of runs with these lengths, and the end of the last."""
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int) -> DataFrame:
    """(doc_id, label, text) of at most ``most`` labelled documents that satisfy ``keep``, a condition on doc_id.

    Those with the smallest hashes of their id are taken. Only ids are sorted; they are then broadcast, being at most
    ``most``. Repeated ids count once, with the smallest label and the smallest text.
    """
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    marked = labels.select(doc_id, F.col(label).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    ids = marked.filter(keep).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = stage(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "sample")
    texts = docs.select(doc_id, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def in_one_task(sample: DataFrame, fit, schema: str) -> bytes:
    """What ``fit(doc_ids, labels, texts)`` makes of a bounded sample, in one task, which is repeated if it is lost.
    Rows come in the order of doc_id."""
    import pyarrow as pa

    def run(batches):
        rows = sorted((i, y, t) for b in batches for i, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True))
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_pydict({schema: pa.array([fit(*columns)], pa.binary())})

    made = sample.select("doc_id", "label", "text").repartition(1).mapInArrow(run, f"{schema} binary").first()
    return made[0] if made else fit((), (), ())  # an empty sample has no task

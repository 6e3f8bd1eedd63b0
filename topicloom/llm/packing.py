"""Best-fit packing of tokenized documents, certified by lower bounds.

Documents are tokenized where they lie; only (doc_id, piece, start, length, checksum) move. Pieces of full
capacity fill sequences of their own. The rest is dealt to partitions of about ``PART`` pieces, each packed by
best-fit decreasing. A lower bound from dual feasible functions certifies a partition's number of bins. Partitions
that need more bins than their bound, and all partitions' last loosely filled bins, give their pieces to a pool
that is dealt anew into other (fewer) partitions, and packed again; bins already filled up stay. This repeats
until every partition is certified and one partition is left, or nothing is gained. Ties go to the fuller bin,
then to the bin opened first; pieces of equal length keep the order of (doc_id, piece).

Defined results: a null or empty text is its end id alone. Rows that repeat a doc_id are packed each for itself. A
null doc_id stays null. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import stage
from topicloom.llm.tokens import ID, default_path, encoder

CAPACITY = 4096
#: Pieces in a partition: what one task sorts and packs at once.
PART = 100_000
#: A bin with at most this share left empty stays as it is when its partition is packed again.
FULL = 1 / 512
ROUNDS = 6

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Per piece of a document: doc_id, piece, start, length, ids_crc32."""
    path = path or default_path()

    @F.arrow_udf("array<struct<length:long,crc:long>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one, end = encoder(path), ID.type(end_id)
        kind = pa.list_(pa.struct([("length", pa.int64()), ("crc", pa.int64())]))
        for texts in batches:
            rows = []
            for ids in one.documents(texts):
                parts = np.split(ids_end := np.append(ids, end), range(capacity, len(ids_end), capacity))
                rows.append([{"length": len(x), "crc": zlib.crc32(x)} for x in parts])
            yield pa.array(rows, kind)

    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    cuts = docs.select(doc_id, cut(F.col("text").cast("string")).alias("cuts"))
    # every document has a piece; the inner form would test for that first, and tokenize a second time
    rows = cuts.select("doc_id", F.posexplode_outer("cuts").alias("piece", "cut"))
    return rows.select(
        "doc_id",
        "piece",
        (F.col("piece").cast("long") * capacity).alias("start"),
        F.col("cut.length").alias("length"),
        F.col("cut.crc").alias("ids_crc32"),
    )


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length. Bins are found by a bit set over the room that is left."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, n = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = open_rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                open_rooms &= ~(1 << room)
        else:
            b, room, n = n, capacity, n + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by two families of dual feasible functions: thresholds (large pieces
    count as whole bins, those below the threshold as nothing) and rounding (u_k)."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths.astype(np.int64), return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    for t in np.unique(np.minimum(sizes, capacity - sizes)):
        if 0 <= t <= capacity // 2:
            value = np.where(sizes > capacity - t, capacity, np.where(sizes < t, 0, sizes))
            best = max(best, -(-int((value * counts).sum()) // capacity))
    for k in range(1, 33):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (capacity * k)))
    return best


def _packer(capacity: int, round_no: int, last: bool):
    """Packs one partition; ``settled`` is false for pieces that go to the pool."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"], kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        n = int(bins.max()) + 1
        certified = n == lower_bound(lengths, capacity)
        room = capacity - np.bincount(bins, lengths, n)
        if last:
            settled = np.ones(n, bool)
        elif certified:
            settled = np.arange(n) != int(np.argmax(room))
        else:
            settled = room <= FULL * capacity
        if not last and n == 1:
            settled[:] = False
        own = (round_no << 56) + (int(rows["part"].iloc[0]) << 24)
        return rows.assign(sequence_id=own + bins, offset=offsets, settled=settled[bins])

    return pack


PACKED = f"{PIECES}, part long, sequence_id long, offset long, settled boolean"


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Deal ``items`` (as ``pieces`` gives them) to sequences of at most ``capacity``: adds sequence_id, offset."""
    items = stage(items, "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = items.filter(F.col("length") == capacity).select(
        *names, (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    done = [full]
    pool = items.filter(F.col("length") < capacity)
    count = pool.count()
    for round_no in range(1, ROUNDS + 1):
        if not count:
            break
        parts = -(-count // PART)
        last = round_no == ROUNDS or parts == 1
        # the row number comes from a staged table, so a repeated task deals alike; equal rows are spread
        row = F.xxhash64(F.monotonically_increasing_id(), F.lit(round_no))
        dealt = pool.withColumn("part", F.pmod(row, F.lit(parts)))
        packed = stage(dealt.groupBy("part").applyInPandas(_packer(capacity, round_no, last), PACKED), "packed")
        done.append(packed.filter("settled").select(*names, "sequence_id", "offset"))
        if last:
            break
        pool = packed.filter("not settled").select(*names)
        count = pool.count()
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, capacity, end_id, path), capacity)

"""Exact nearest neighbours by a block matrix join on int8 tiles.

Each vector becomes integers of -127 to 127 times a scale of its own, and the length of what that loses. The product
of two blocks of integers gives a distance for every pair that is off by at most the two losses. A pair
whose least possible distance is beyond the k-th best found so far, or beyond the k-th smallest upper bound of its tile, is dropped;
the others are computed from the original vectors in double precision and merged into the query's heap. A
task keeps k candidates per query, and the last step ranks those of all tasks.

The vectors are written once to the shared folder, and the queries again, dealt by hash to blocks of about ``GROUP_BYTES``. A
grid of tasks then joins blocks of queries with slices of the candidates: a task reads one block and streams the files of one
slice past it, so it holds a block, a batch and k candidates per query. Blocks and slices are found by counting; there are
as many slices as keep the machines busy, and enough that none is much above ``SLICE_BYTES``. No vector passes the driver, none is
broadcast, and only heaps are shuffled.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without vec_id. Vectors of another dimension than a query's are no candidates for it. Rows that repeat a
vec_id are candidates each; as a query the least of them counts. A query's own id is never its neighbour. Equal
distances go to the smaller vec_id. Without candidates a query has no rows. Further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import filesystem, new_folder

K, MODULUS = 10, 100
GROUP_BYTES, SLICE_BYTES = 16 << 20, 4 << 30
#: Tasks per core, while there are files enough.
WAVES = 3
#: Cells beyond this number share tasks.
MOST_TASKS = 100_000
#: Queries by candidates of a tile.
TILE_QUERIES, TILE_ROWS = 1024, 4096
FOUND = "query_id long, vec_id long, score double"


class Block:
    """Vectors of one dimension: as given, as integers, their scales, lengths and losses."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        top = np.abs(self.vectors).max(1)
        self.scale = top / 127
        # a subnormal scale would lose everything; such vectors are bounded by their whole length
        safe = np.where(self.scale > 1e-290, self.scale, 1.0)
        self.numbers = np.rint(self.vectors / safe[:, None]).astype(np.int8)
        kept = self.numbers * safe[:, None]
        self.scale = safe
        self.loss = np.sqrt(((self.vectors - kept) ** 2).sum(1)) * (1 + 1e-9) + 1e-300
        # products of int8 are exact in the float type that a matrix product is fast in
        self.exact = np.float32 if 127 * 127 * vectors.shape[1] < 1 << 24 else np.float64
        self.square = safe**2 * (self.numbers.astype(np.int64) ** 2).sum(1)

    def part(self, rows: slice) -> Block:
        one = object.__new__(Block)
        one.exact = self.exact
        for name in ("ids", "vectors", "scale", "numbers", "loss", "square"):
            setattr(one, name, getattr(self, name)[rows])
        return one


def bounds(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible distance of every pair, from the integers."""
    product = a.numbers.astype(a.exact) @ b.numbers.T.astype(a.exact)
    square = a.square[:, None] + b.square[None, :] - 2 * (a.scale[:, None] * b.scale[None, :]) * product
    rounding = 1e-12 * (a.square[:, None] + b.square[None, :])
    loss = a.loss[:, None] + b.loss[None, :]
    low = np.sqrt(np.maximum(square - rounding, 0)) - loss
    return low, np.sqrt(np.maximum(square + rounding, 0)) + loss


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of row pairs, summed in the order of components."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        gap = a[:, j] - b[:, j]
        total += gap * gap
    return np.sqrt(total)


class Heaps:
    """The k nearest found so far for each query of a block."""

    def __init__(self, queries: Block, k: int):
        self.queries, self.k = queries, k
        self.held: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
        self.worst = np.full(len(queries.ids), np.inf)

    def meet(self, rows: Block) -> None:
        for first in range(0, len(self.queries.ids), TILE_QUERIES):
            part = slice(first, min(first + TILE_QUERIES, len(self.queries.ids)))
            tile = self.queries.part(part)
            low, high = bounds(tile, rows)
            own = tile.ids[:, None] == rows.ids[None, :]
            low[own] = high[own] = np.inf
            limit = self.worst[part]
            if high.shape[1] > self.k:
                limit = np.minimum(limit, np.partition(high, self.k - 1, axis=1)[:, self.k - 1])
            q, r = np.nonzero((low <= limit[:, None]) & ~own)
            if not len(q):
                continue
            exact = distances(tile.vectors[q], rows.vectors[r])
            cuts = np.searchsorted(q, np.arange(len(tile.ids) + 1))
            for i in np.unique(q).tolist():
                a, b = cuts[i], cuts[i + 1]
                new = zip(exact[a:b].tolist(), rows.ids[r[a:b]].tolist(), strict=True)
                best = heapq.nsmallest(self.k, [*self.held[first + i], *new])
                self.held[first + i] = best
                if len(best) == self.k:
                    self.worst[first + i] = best[-1][0]


def usable(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the rows that take part, by dimension."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    start = vectors.offsets.to_numpy()[:-1].astype(np.int64)
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    known = ~np.asarray(ids.is_null()) & ~np.asarray(vectors.is_null())
    numbers = ids.fill_null(0).to_numpy()
    for size in np.unique(sizes[known & (sizes > 0)]).tolist():
        at = np.flatnonzero(known & (sizes == size))
        rows = flat[start[at][:, None] + np.arange(size)]
        good = np.isfinite(rows).all(1) & rows.any(1)
        if good.any():
            yield numbers[at[good]], rows[good]


def vectors_of(folder: str, piece: int = 0, pieces: int = 1, tile: int = TILE_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of every ``pieces``-th Parquet file of a folder, in batches of at most ``tile`` rows; none if there is no such folder."""
    store, path = filesystem(folder)
    files = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    for name in sorted(f.path for f in files if f.path.endswith(".parquet"))[piece::pieces]:
        with store.open_input_file(name) as source:
            for batch in pq.ParquetFile(source).iter_batches(tile, columns=["vec_id", "embedding"]):
                yield from usable(batch.column(0), batch.column(1))


def block_of(folder: str, number: int) -> dict[int, Block]:
    """The queries of a block by dimension."""
    parts: dict[int, list] = {}
    for ids, matrix in vectors_of(f"{folder}/block={number}"):
        parts.setdefault(matrix.shape[1], []).append((ids, matrix))
    return {size: Block(*(np.concatenate(c) for c in zip(*found, strict=True))) for size, found in parts.items()}


def searched(cells: Iterator[int], queries: str, rows: str, slices: int, k: int, tile: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of each query of a cell's block among the candidates of its slice."""
    for cell in cells:
        block, piece = divmod(cell, slices)
        heaps = {size: Heaps(found, k) for size, found in block_of(queries, block).items()}
        for ids, matrix in vectors_of(rows, piece, slices, tile) if heaps else ():
            if matrix.shape[1] in heaps:
                heaps[matrix.shape[1]].meet(Block(ids, matrix))
        for held in heaps.values():
            triples = [(q, i, d) for q, best in zip(held.queries.ids.tolist(), held.held, strict=True) for d, i in best]
            if triples:
                columns = zip(zip(*triples, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, k: int = K, modulus: int = MODULUS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose vec_id is divisible by ``modulus``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & whole & F.exists("embedding", lambda x: x != 0))
    folder = new_folder(spark, "vectors")
    rows.write.parquet(f"{folder}/rows")
    held = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    asked, weight = F.col("vec_id") % modulus == 0, 8 * F.size("embedding") + 8
    size, size_asked = held.agg(F.sum(weight), F.sum(F.when(asked, weight))).first()
    blocks = 1 + (size_asked or 0) // GROUP_BYTES
    busy = -(-WAVES * spark.sparkContext.defaultParallelism // blocks)
    slices = max(1, min(len(held.inputFiles()), max(busy, 1 + (size or 0) // SLICE_BYTES)))
    # the least of rows with one id
    queries = held.filter(asked).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    queries.repartition("block").write.partitionBy("block").parquet(f"{folder}/queries")

    tile = TILE_ROWS

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = (i for batch in batches for i in batch.column(0).to_pylist())
        return searched(cells, f"{folder}/queries", f"{folder}/rows", slices, k, tile)

    cells = blocks * slices
    found = spark.range(0, cells, 1, min(cells, MOST_TASKS)).mapInArrow(search, FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Near-duplicates by SimHash: fingerprints, BK-trees in shards, and connected components.

Fingerprints at most ``radius`` bits apart agree wholly on one of ``radius`` + 1 blocks of their bits, so each
distinct fingerprint goes to one shard per block, keyed by that block's value, and every link lies within a
shard. A shard with more than ``SHARD`` fingerprints is dealt anew by the blocks of its remaining bits, which is
exact for the same reason. In a shard, a BK-tree (children keyed by the integer Hamming distance to their
parent) is walked by all fingerprints of the shard at once, following only edges within the radius. Trees stay
with the tasks that build them: they grow with the corpus, so they are not broadcast.

A shard gives a star per group it has joined instead of its pairs; stars are joined over shards by alternating
large-star and small-star steps on tables, staged in the shared folder.

Defined results: a null or empty text, or one of white space only, has the fingerprint zero and is linked like any
other. Rows that repeat a doc_id are rows of their own. A null doc_id is never a component's id unless the whole
component has none. An empty table gives no rows. Further columns are ignored, or kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import stage

WORDS, SEED, BITS, RADIUS = 4, 42, 64, 4
#: Fingerprints in a shard beyond which it is dealt anew, and how often that is done.
SHARD, DEPTH = 20_000, 3
#: Fingerprints compared directly in a tree's leaf.
LEAF = 64
#: Comparisons made at once.
CELLS = 1 << 21


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of a text's word shingles, unsigned."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(found) - words + 1)
    last = ends[min(words, len(found)) - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, BITS)
        ones += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column) -> Column:
    """Column of fingerprints, as signed longs."""

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return hashed(text)


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class Groups:
    """Disjoint sets over numbers below n; roots are the smallest members."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if (up == r).all():
                self.parent[x] = r
                return r
            r = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


class BKTree:
    """A BK-tree over 64-bit points. Small subtrees are leaves, compared directly."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.root = self._build(np.arange(len(points)))

    def _build(self, members: np.ndarray):
        if len(members) <= LEAF:
            return members
        pivot, rest = members[0], members[1:]
        distance = np.bitwise_count(self.points[rest] ^ self.points[pivot])
        order = np.argsort(distance, kind="stable")
        keys, first = np.unique(distance[order], return_index=True)
        return int(pivot), [(int(k), self._build(x)) for k, x in zip(keys, np.split(rest[order], first[1:]), strict=True)]

    def join(self, radius: int, groups: Groups) -> None:
        """Join all points at most ``radius`` apart."""
        todo = [(self.root, np.arange(len(self.points)))]
        while todo:
            node, queries = todo.pop()
            if isinstance(node, tuple):
                pivot, children = node
                distance = np.bitwise_count(self.points[queries] ^ self.points[pivot]).astype(np.int64)
                near = queries[distance <= radius]
                groups.join(near, np.full(len(near), pivot))
                for key, child in children:
                    within = queries[np.abs(distance - key) <= radius]
                    if len(within):
                        todo.append((child, within))
            else:
                self._compare(node, queries, radius, groups)

    def _compare(self, leaf: np.ndarray, queries: np.ndarray, radius: int, groups: Groups) -> None:
        own = groups.roots(leaf)
        if (own == own[0]).all():  # those joined with all of the leaf have nothing to find
            queries = queries[groups.roots(queries) != own[0]]
        for i in range(0, len(queries), CELLS // LEAF):
            part = queries[i : i + CELLS // LEAF]
            near = np.bitwise_count(self.points[part][:, None] ^ self.points[leaf][None, :]) <= radius
            a, b = np.nonzero(near)
            groups.join(part[a], leaf[b])


def stars(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, centre) of each group of distinct points joined by links; points alone are left out."""
    groups = Groups(len(points))
    BKTree(points).join(radius, groups)
    roots = groups.roots(np.arange(len(points)))
    member = np.flatnonzero(roots != np.arange(len(points)))
    return points[member], points[roots[member]]


def _blocks(bits: list[int], count: int) -> list[list[int]]:
    """``bits`` cut into ``count`` runs of about equal length."""
    cuts = [len(bits) * i // count for i in range(count + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def shards(distinct: DataFrame, radius: int = RADIUS, most: int = SHARD) -> DataFrame:
    """(shard, fp): every fingerprint once for each of its shards.

    A shard is named by the blocks used and their value; ``used`` is the mask of bits that its members share.
    """

    def dealt(rows: DataFrame, used: int, way: str) -> list[tuple[DataFrame, int, str]]:
        free = [b for b in range(BITS) if not (used >> b) & 1]
        out = []
        for i, block in enumerate(_blocks(free, radius + 1)):
            mask = _mask(block)
            key = F.concat(F.col("shard"), F.lit(f"/{i}:"), F.hex(F.col("fp").bitwiseAND(F.lit(mask).cast("long"))))
            out.append((rows.select(key.alias("shard"), "fp"), used | (mask & (1 << 64) - 1), f"{way}{i}"))
        return out

    ready, todo = [], dealt(distinct.select(F.lit("").alias("shard"), "fp"), 0, "")
    for depth in range(DEPTH):
        together = _union([rows for rows, _, _ in todo])
        crowded = stage(together.groupBy("shard").count().filter(F.col("count") > most), "crowded").select("shard")
        if depth == DEPTH - 1 or crowded.isEmpty():
            ready += [rows for rows, _, _ in todo]
            break
        ready += [rows.join(crowded, "shard", "left_anti") for rows, _, _ in todo]
        todo = [x for rows, used, way in todo for x in dealt(rows.join(crowded, "shard", "left_semi"), used, way)]
    return _union(ready)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def links(distinct: DataFrame, radius: int = RADIUS, most: int = SHARD) -> DataFrame:
    """(a, b): stars over distinct fingerprints (column fp) that hold every link within the radius, a > b."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            names, points = batch.column(0).to_pylist(), batch.column(1).to_numpy().view(np.uint64)
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if names[a] != shard:
                    if held:
                        yield from _edges(held, radius)
                    shard, held = names[a], []
                held.append(points[a:b])
        if held:
            yield from _edges(held, radius)

    placed = shards(distinct, radius, most).repartition("shard").sortWithinPartitions("shard")
    return placed.mapInArrow(join, "a long, b long").distinct()


def _edges(held: list[np.ndarray], radius: int) -> Iterator[pa.RecordBatch]:
    points = np.concatenate(held)
    if len(points) > 1:
        a, b = (x.view(np.int64) for x in stars(points, radius))
        if len(a):
            yield pa.RecordBatch.from_pydict({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that occurs in ``edges`` (a > b); root is the component's smallest node."""
    before = None
    while True:
        edges = stage(edges.select("a", "b"), "edges")
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def classes(hashed: DataFrame, radius: int = RADIUS, most: int = SHARD) -> DataFrame:
    """(fp, component_id) of the fingerprints in ``hashed`` (doc_id, fp)."""
    distinct = stage(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    linked = stage(components(links(distinct.select("fp"), radius, most)).withColumnRenamed("node", "fp"), "linked")
    smallest = distinct.join(linked, "fp").groupBy("root").agg(F.min("first").alias("smallest"))
    named = linked.join(smallest, "root").select("fp", "smallest")
    return distinct.join(named, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints(F.col("text").cast("string")).alias("fp"))
    hashed = stage(slim, "hashed")
    found = hashed.join(classes(hashed, radius), "fp")
    return found.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id, then the smallest hash of its text.

    Only ids and hashes are grouped. Rows are chosen by doc_id and text, so of rows alike in both one stays.
    """
    spark_text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), spark_text.cast("string"))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), fingerprints(F.col("text").cast("string")).alias("fp")
    )
    hashed = stage(slim, "hashed")
    rank = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("key"))
    first = F.min(F.struct(rank.alias("rank"), F.col("key"))).alias("least")
    by_fp = hashed.groupBy("fp").agg(first)
    # a component without ids is named by its smallest fingerprint
    root = components(links(stage(by_fp.select("fp"), "fingerprints"), radius)).withColumnRenamed("node", "fp")
    named = by_fp.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = stage(named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias("kept_key")), "kept")
    own = "__kept_key"
    rows = docs.withColumn(own, key).join(kept, F.col(own) == F.col("kept_key"), "left_semi")
    order = Window.partitionBy(own).orderBy(*[F.col(f"`{c}`").cast("string") for c in docs.columns if c != "text"])
    place = "__place"
    return rows.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).select(*[f"`{c}`" for c in docs.columns])

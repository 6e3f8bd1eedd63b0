"""Mean pairwise Jaccard similarity of keyword sets, without forming pairs of documents.

Equal sets are one row with a count. Pairs of sets of up to ``LINEAR`` keywords (documents carry at most eight) are
counted by subsets: if ``n_a(T)`` sets of size ``a`` contain subset ``T``, then the sum over all ``T`` of ``t`` keywords
of ``n_a(T) * n_b(T)`` counts each pair ``C(|A & B|, t)`` times. Inverting those binomial sums gives the exact number of
pairs with each overlap, in work linear in the number of sets however often one keyword or one set repeats.

Pairs with a larger set come from an inverted index over the distinct sets: the list of a keyword is cut into blocks,
heavy ones into many, and a task multiplies the incidence matrices of a block of larger sets and a block of any sets. A
pair counts at its first common keyword only. That work is the number of larger sets times that of sets beside them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.session import fan_out, stage

#: Keywords of a set whose subsets are counted.
LINEAR = 8
#: Sets in a block of a keyword's list.
BLOCK = 512
_BIG = "decimal(38,0)"


def _subset_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All non-empty subsets of sets of keyword hashes: a subset is known by the exclusive or of its keywords' 128 bits."""
    for batch in batches:
        sizes = batch["size"].to_numpy()
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            taken = batch.take(pa.array(rows))
            found = []
            for column in ("high", "low"):
                hashes = taken[column].flatten().to_numpy().reshape(len(rows), size)
                keys = np.zeros((len(rows), 1), np.int64)
                for k in range(size):
                    keys = np.concatenate([keys, keys ^ hashes[:, k : k + 1]], 1)
                found.append(keys[:, 1:].ravel())
            t = np.array([i.bit_count() for i in range(1, 1 << int(size))], np.int32)
            times = len(t)
            which = pa.array(np.repeat(np.arange(len(rows)), times))
            yield pa.RecordBatch.from_arrays(
                [taken["topic"].take(which), pa.array(found[0]), pa.array(found[1]), pa.array(np.tile(t, len(rows))),
                 pa.array(np.full(len(which), size, np.int32)), taken["copies"].take(which)],
                ["topic", "high", "low", "t", "a", "copies"],
            )


def keyword_sets(documents: DataFrame) -> DataFrame:
    """(topic, keywords, copies): the distinct non-empty sets, staged."""
    sets = (
        documents.select("topic", F.array_sort(F.array_distinct("keywords")).alias("keywords"))
        .where(F.size("keywords") > 0)
        .groupBy("topic", "keywords")
        .agg(F.count("*").alias("copies"))
    )
    return stage(sets, "keyword-sets")


def pair_moments(sets: DataFrame) -> DataFrame:
    """(topic, a, b, t, moment) with a <= b: pairs of sets weighted by C(overlap, t)."""
    sizes = range(1, LINEAR + 1)
    hashed = fan_out(sets, "topic", "keywords").select(
        "topic", "copies", F.size("keywords").alias("size"),
        F.transform("keywords", lambda k: F.xxhash64(k)).alias("high"),
        F.transform("keywords", lambda k: F.xxhash64(F.lit(1), F.reverse(k), k)).alias("low"),
    )
    spread = hashed.mapInArrow(_subset_rows, "topic string, high long, low long, t int, a int, copies long")
    # One counter per set size. A subset of a single document pairs with nothing.
    by_subset = (
        spread.groupBy("topic", "high", "low", "t")
        .agg(*[F.sum(F.when(F.col("a") == s, F.col("copies")).otherwise(0)).alias(f"n{s}") for s in sizes],
             F.sum("copies").alias("holders"))
        .where("holders > 1")
    )
    counts = "filter(array(" + ", ".join(f"named_struct('a', {s}, 'n', n{s})" for s in sizes) + "), c -> c.n > 0)"
    pairs = F.expr(
        f"""flatten(transform({counts}, x -> transform(filter({counts}, y -> y.a >= x.a), y -> named_struct(
            'a', x.a, 'b', y.a, 'm', IF(x.a = y.a,
              cast(cast(x.n AS {_BIG}) * (x.n - 1) / 2 AS {_BIG}), cast(cast(x.n AS {_BIG}) * y.n AS {_BIG}))))))"""
    )
    # the outer form: the inner one would compute the pairs twice, and none is empty
    return (
        by_subset.select("topic", "t", F.inline_outer(pairs)).groupBy("topic", "a", "b", "t").agg(F.sum("m").alias("moment"))
    )


def _tile(key: tuple, table: pa.Table) -> pa.Table:
    """The Jaccard values of the pairs of one block of larger sets and one block of any sets whose first common keyword
    is that of the list, summed over the documents that have the sets."""
    sides = [table.filter(table["left"]), table.filter(pc.invert(table["left"]))]
    words = sorted({k for s in sides for ks in s["keywords"].to_pylist() for k in ks})
    number = {k: i for i, k in enumerate(words)}
    matrices = []
    for side in sides:
        held = np.zeros((side.num_rows, len(words)), np.float32)
        for row, ks in enumerate(side["keywords"].to_pylist()):
            held[row, [number[k] for k in ks]] = 1
        matrices.append(held)
    a, b = matrices
    before = number[key[1].as_py()]
    first = a[:, :before] @ b[:, :before].T == 0
    overlap = (a @ b.T).astype(np.float64)
    ids, copies = ([s[c].to_numpy() for s in sides] for c in ("id", "copies"))
    # of two larger sets each stands on both sides
    once = (sides[1]["keywords"].combine_chunks().value_lengths().to_numpy() <= LINEAR)[None, :] | (ids[0][:, None] < ids[1][None, :])
    union = a.sum(1)[:, None] + b.sum(1)[None, :] - overlap
    value = np.where(first & once, overlap / union, 0.0) * copies[0][:, None] * copies[1][None, :]
    return pa.table({"topic": pa.array([key[0].as_py()], pa.string()), "s": pa.array([float(value.sum())])})


def larger_pairs(sets: DataFrame) -> DataFrame:
    """(topic, s): summed Jaccard values of the pairs with a set of more than ``LINEAR`` keywords."""
    large = F.size("keywords") > LINEAR
    numbered = sets.withColumn("id", F.monotonically_increasing_id()).withColumn("large", large)
    topics = sets.where(large).select("topic").distinct()
    beside = numbered.join(topics, "topic", "left_semi").withColumn("keyword", F.explode("keywords"))
    lists = stage(
        beside.groupBy("topic", "keyword").agg(F.count("*").alias("n"), F.count_if("large").alias("n_large")).where("n_large > 0"), "keyword-lists"
    )
    held = beside.join(lists, ["topic", "keyword"])
    lefts, rights = F.ceil(F.col("n_large") / BLOCK), F.ceil(F.col("n") / BLOCK)
    place = F.xxhash64("id")
    columns = ["topic", "keyword", "id", "keywords", "copies"]

    def blocks(own: Column, others: Column, left: bool) -> DataFrame:
        rows = held.where("large") if left else held
        mine, other = F.pmod(place, own), F.explode(F.sequence(F.lit(0).cast("long"), others - 1))
        named = [mine.alias("i"), other.alias("j")] if left else [other.alias("i"), mine.alias("j")]
        return rows.select(*columns, F.lit(left).alias("left"), *named)

    both = blocks(lefts, rights, True).unionByName(blocks(rights, lefts, False))
    sums = both.groupBy("topic", "keyword", "i", "j").applyInArrow(_tile, "topic string, s double")
    same = sets.where(large).select("topic", (F.col("copies") * (F.col("copies") - 1) / 2.0).alias("s"))
    return sums.unionByName(same).groupBy("topic").agg(F.sum("s").alias("s"))


def _jaccard_sum() -> Column:
    """Sum of Jaccard values of all pairs with sizes a and b, from their moments ``m``."""
    rows = ", ".join(
        f"named_struct('i', {i}, 'c', array("
        + ", ".join(f"cast({(-1) ** (t - i) * comb(t, i) if t >= i else 0} AS bigint)" for t in range(1, LINEAR + 1))
        + "))"
        for i in range(1, LINEAR + 1)
    )
    # Per overlap i: the exact number of pairs, then its share of the union.
    pairs = (
        f"aggregate(zip_with(r.c, sequence(1, {LINEAR}), (c, t) -> cast(c * coalesce(try_element_at(m, t), 0) AS {_BIG})),"
        f" cast(0 AS {_BIG}), (acc, v) -> cast(acc + v AS {_BIG}))"
    )
    return F.expr(
        f"aggregate(transform(array({rows}), r -> cast({pairs} AS double) * r.i / greatest(a + b - r.i, 1)),"
        " cast(0 AS double), (acc, v) -> acc + v)"
    )


def consistency(documents: DataFrame) -> DataFrame:
    """(topic, sets, consistency): mean Jaccard over all pairs of non-empty keyword sets."""
    sets = keyword_sets(documents)
    totals = sets.groupBy("topic").agg(F.sum("copies").alias("sets"))
    by_sizes = pair_moments(sets.where(F.size("keywords") <= LINEAR)).groupBy("topic", "a", "b").agg(
        F.map_from_entries(F.collect_list(F.struct("t", "moment"))).alias("m")
    )
    sums = by_sizes.select("topic", _jaccard_sum().alias("s"))
    if not sets.where(F.size("keywords") > LINEAR).isEmpty():  # else the index would be empty
        sums = sums.unionByName(larger_pairs(sets))
    sums = sums.groupBy("topic").agg(F.sum("s").alias("s"))
    n = F.col("sets").cast("double")
    mean = F.when(F.col("sets") < 2, F.lit(0.0)).otherwise(F.coalesce(F.col("s"), F.lit(0.0)) / (n * (n - 1) / 2))
    return totals.join(sums, "topic", "left").select("topic", "sets", mean.alias("consistency"))

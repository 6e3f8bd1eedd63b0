"""Top-k per group.

``row_number() <= k`` is planned with a rank limit on both sides of the shuffle, so a
task sends at most k rows per group and a hot group stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.session import stage


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group under ``order``, with their 1-based rank."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1, "_first").drop("_first")


def ordered_list(order: Column, value: Column) -> Column:
    """Aggregate: ``value``s of a group of bounded size, as an array sorted by ``order``."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def in_order(df: DataFrame, order: list[Column], position: str = "position") -> DataFrame:
    """``df`` with each row's 1-based place under ``order``, without a window over all rows.

    Rows are sorted by ranges over the cluster and staged with their partition and their place in
    it; the places before a partition come from one count per partition.
    """
    low = (1 << 33) - 1  # the generated id holds the partition above its low 33 bits
    sorted_rows = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = stage(sorted_rows, "in-order").withColumn("_part", F.shiftright("_id", 33))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit(low)) + 1
    return placed.join(parts, "_part").withColumn(position, place).drop("_part", "_id", "_before")


def ranked_in_groups(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """``df`` with each row's 1-based place in its group under ``order``: its place among all rows less that of the group's
    first. A group of any size is spread over the cluster, and no array or window holds it."""
    placed = in_order(df, [*[F.col(k) for k in keys], *order], "_place")
    first = placed.groupBy(*keys).agg(F.min("_place").alias("_first"))
    return placed.join(first, keys).withColumn(rank, F.col("_place") - F.col("_first") + 1).drop("_place", "_first")

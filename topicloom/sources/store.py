"""Run history, API usage and result snapshots as append-only Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.ranking import first_per_group

SNAPSHOT_TTL_SECONDS = 86_400
#: Buckets of a store by key. Part of a table's definition: all its appends and readers share it.
BUCKETS = 64


def _append(rows: DataFrame, at: str, month: str, path: str) -> None:
    """The rebalance hint sizes files at run time: a busy month is split over several
    tasks, a quiet one gets a single file."""
    dated = rows.withColumn(month, F.date_format(at, "yyyy-MM"))
    dated.hint("rebalance", month).write.mode("append").partitionBy(month).parquet(path)


def append_runs(runs: DataFrame, path: str) -> None:
    """Runs go into capture-month folders, so date filters prune."""
    _append(runs, "captured_at", "captured_month", path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def since(stored: DataFrame, at: str, low: Column) -> DataFrame:
    """Stored rows from ``low`` on. Only the folders of its month and later ones are read."""
    month = next(c for c in ("captured_month", "logged_month") if c in stored.columns)
    return stored.where((F.col(month) >= _month(low)) & (F.col(at) >= low))


def runs_in_windows(stored: DataFrame, windows: DataFrame) -> DataFrame:
    """Stored runs of each window (topic, since, until; both ends count). Windows are joined by the months they reach, so the
    months that a selection of windows needs are found at run time and the other folders aren't read."""
    first = F.date_trunc("month", "since")
    months = windows.withColumn("captured_month", F.explode(F.sequence(first, F.col("until"), F.expr("INTERVAL 1 MONTH"))))
    months = months.withColumn("captured_month", _month(F.col("captured_month")))
    found = stored.join(months, ["captured_month", "topic"])
    return found.where((F.col("captured_at") >= F.col("since")) & (F.col("captured_at") <= F.col("until")))


def append_usage(log: DataFrame, path: str) -> None:
    _append(log, "logged_at", "logged_month", path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_snapshots(snapshots: DataFrame, path: str) -> None:
    """Result snapshots: key, captured_at, result."""
    _append(snapshots, "captured_at", "captured_month", path)


def fresh_snapshots(snapshots: DataFrame, as_of: Column, ttl_seconds: int = SNAPSHOT_TTL_SECONDS,
                    tombstones: DataFrame | None = None) -> DataFrame:
    """The newest snapshot per key younger than the time to live and not deleted since.

    ``tombstones`` (key, deleted_at) hide snapshots taken at or before the deletion.
    """
    young = snapshots.where(
        (F.col("captured_at") > as_of - F.expr(f"INTERVAL {ttl_seconds} SECONDS")) & (F.col("captured_at") <= as_of)
    )
    if tombstones is not None:
        gone = (
            tombstones.where(F.col("deleted_at") <= as_of)
            .groupBy("key")
            .agg(F.max("deleted_at").alias("deleted_at"))
        )
        young = young.join(gone, "key", "left").where(
            F.col("deleted_at").isNull() | (F.col("captured_at") > F.col("deleted_at"))
        ).drop("deleted_at")
    return first_per_group(young, ["key"], [F.desc("captured_at"), F.desc("id")])


def lookup(requests: DataFrame, fresh: DataFrame) -> DataFrame:
    """Requests (key, refresh) with their cached result; ``refresh`` skips the lookup."""
    found = requests.join(fresh.select("key", "result"), "key", "left")
    return found.withColumn("result", F.when(~F.col("refresh"), F.col("result")))


# ---- tables bucketed by key ------------------------------------------------------------


def append_bucketed(rows: DataFrame, table: str, path: str, key: str, at: str, buckets: int = BUCKETS) -> None:
    """Append to the table at ``path``, bucketed by ``key`` and sorted by it and time, one file per bucket and append. What
    groups, ranks or joins by ``key`` then reads it without an exchange."""
    writer = rows.repartition(buckets, key).write.format("parquet").mode("append").bucketBy(buckets, key).sortBy(key, at)
    writer.option("path", path).saveAsTable(table)


def open_bucketed(spark: SparkSession, table: str, path: str, schema: str, key: str, at: str, buckets: int = BUCKETS) -> DataFrame:
    """The table, made known to a session that has not written it."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}, {at}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


def compact_snapshots(spark: SparkSession, table: str, path: str, as_of: Column, ttl_seconds: int = SNAPSHOT_TTL_SECONDS,
                      tombstones: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Keep what ``fresh_snapshots`` keeps: expired, deleted and superseded snapshots go.

    The rows are written to a folder of their own below ``path``, then the table is pointed there. If that is not
    reached, the table is as before; run again, it keeps the same rows. Files of the old folder are left to the caller.
    """
    fresh = fresh_snapshots(spark.table(table), as_of, ttl_seconds, tombstones)
    folder, made = f"{path}/compacted-{uuid.uuid4().hex}", f"{table}_{uuid.uuid4().hex}"
    append_bucketed(fresh, made, folder, "key", "captured_at", buckets)
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{folder}'")
    spark.sql(f"DROP TABLE {made}")  # its files belong to ``table`` now
    spark.catalog.refreshTable(table)
    return spark.table(table)

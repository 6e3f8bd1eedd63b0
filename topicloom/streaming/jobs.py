"""Streams over the repeated batch jobs: posts, API usage, topic history, trend alerts.

Every writer is safe to run again: file sinks commit per batch, and ``foreachBatch``
writers replace the folder of their own batch number, so a batch replayed after a lost
executor or driver leaves the same rows.
"""

from __future__ import annotations

import datetime as dt
import struct
from collections import defaultdict
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from topicloom.functions.text import content_hash
from topicloom.operators import history, reports
from topicloom.operators.validation import usable_posts
from topicloom.sources import landed


def _write(df: DataFrame, name: str, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        df.writeStream.format("parquet")
        .queryName(name)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


def _write_batches(df: DataFrame, name: str, path: str, checkpoint: str, mode: str) -> StreamingQuery:
    """Each batch in a folder of its own, replaced when the batch runs again."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        df.writeStream.foreachBatch(save)
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


# ---- posts ---------------------------------------------------------------------


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(at: dt.datetime) -> int:
    return int(at.timestamp() * 1000)


#: Groups of content hashes. State is kept by group, so a checkpoint holds for one number only.
HASH_GROUPS = 4096
#: A hash that has been seen, and the millisecond at which it is forgotten.
SEEN = struct.Struct("<32sq")


class FirstOfContent(StatefulProcessor):
    """Emits the first post of a content hash: the earliest of the batch in which the hash is new. The hash is forgotten
    by a timer, when the watermark has passed its post by ``delay``.

    Posts come by group of hashes, since calls to the state store for each hash take far longer than its rows. What a
    group has seen lies in slots, by when it is forgotten, a quarter of ``delay`` to a slot, and each slot in parts. A batch
    writes its new hashes as one more part, joined with those before it that are no larger, so a hash is written again as
    often as the slot's size doubles. A slot has a timer at the time its next hash is forgotten, and goes with the last.
    """

    def __init__(self, delay: str, order: list[str]):
        self.delay_ms = int(pd.Timedelta(delay).total_seconds() * 1000)
        self.slot_ms = max(1, self.delay_ms // 4)
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "slot long, part int", "hashes binary")

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs()
        first = {}
        for r in rows:
            at = _millis(r["collected_at"])
            if at < mark:
                continue
            text, rank = r["content_hash"], tuple(r[c] for c in self.order)
            held = first.get(text)
            if held is None or rank < held[0]:
                first[text] = (rank, at + self.delay_ms, r)
        if not first:
            return
        slots = self._slots()
        # timers go off after a batch's rows, so what they are about to forget doesn't count
        known = {slot: {h: t for hashes in parts.values() for h, t in SEEN.iter_unpack(hashes) if t >= mark} for slot, parts in slots.items()}
        posts, added = [], defaultdict(dict)
        for text, (_, until, post) in first.items():
            name = bytes.fromhex(text)
            if not any(name in hashes for hashes in known.values()):
                added[until // self.slot_ms][name] = until
                posts.append(post)
        for slot, new in added.items():
            self._add(slot, slots.get(slot, {}), new)
            soonest = min(new.values())
            if not any(mark < t <= soonest for t in known.get(slot, {}).values()):
                self.handle.registerTimer(soonest)
        yield from posts

    def _slots(self) -> dict[int, dict[int, bytes]]:
        slots = defaultdict(dict)
        for (slot, part), (hashes,) in self.seen.iterator():
            slots[slot][part] = hashes
        return slots

    def _add(self, slot: int, parts: dict[int, bytes], new: dict[bytes, int]) -> None:
        hashes = b"".join(SEEN.pack(*h) for h in new.items())
        into = max(parts, default=-1) + 1
        for part in sorted(parts, reverse=True):
            if len(parts[part]) > len(hashes):
                break
            hashes += parts[part]
            if into in parts:
                self.seen.removeKey((slot, into))
            into = part
        self.seen.updateValue((slot, into), (hashes,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark, slot = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() // self.slot_ms
        parts = self._slots()[slot]
        left = {part: [h for h in SEEN.iter_unpack(hashes) if h[1] > mark] for part, hashes in parts.items()}
        soonest = min((t for hashes in left.values() for _, t in hashes), default=None)
        for part, hashes in parts.items():
            if soonest is None:
                self.seen.removeKey((slot, part))
            # those of before the watermark count no more wherever they lie; those of its millisecond still would
            elif any(t == mark for _, t in SEEN.iter_unpack(hashes)):
                self.seen.updateValue((slot, part), (b"".join(SEEN.pack(*h) for h in left[part]),))
        if soonest is not None and soonest not in set(self.handle.listTimers()):
            self.handle.registerTimer(soonest)
        yield from ()

    def close(self) -> None:
        pass


@contextmanager
def _keyed_state(spark: SparkSession):
    """Timers need the RocksDB state store; a query takes the setting it finds when it starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def distinct_posts(arriving: DataFrame, delay: str = "1 day", arrival: str = "post_id") -> DataFrame:
    """Usable posts, the first of each content and url, from a stream of posts.

    What has been seen is kept by content hash in the state store, not read back from the output: a copy is
    dropped while its hash is kept, i.e. until the watermark, ``delay`` behind the newest post, passes the first post by
    ``delay``. Of copies in one batch the earliest stays; a copy that arrives in a later batch is dropped though it may
    be older. Rows behind the watermark and rows without a time are dropped.
    """
    posts = usable_posts(arriving.where(F.col("collected_at").isNotNull())).withColumn("content_hash", content_hash(F.col("content"), F.col("url")))
    grouped = posts.withColumn("_group", F.pmod(F.xxhash64("content_hash"), F.lit(HASH_GROUPS)).cast("int"))
    return (
        grouped.withWatermark("collected_at", delay)
        .groupBy("_group")
        .transformWithState(FirstOfContent(delay, ["collected_at", arrival]), posts.schema, "Append", "EventTime")
    )


def run_posts(arriving: DataFrame, path: str, checkpoint: str, delay: str = "1 day", arrival: str = "post_id") -> StreamingQuery:
    """The file sink commits whole batches, so one that runs again leaves its rows once."""
    with _keyed_state(arriving.sparkSession):
        return _write(distinct_posts(arriving, delay, arrival), "distinct-posts", path, checkpoint)


# ---- landed files -----------------------------------------------------------------


def run_landed(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Lines of arriving files: usable records below ``path``/records, rejected lines with their reason below
    ``path``/quarantine. Both folders of a batch are replaced when it runs again."""

    def save(batch: DataFrame, batch_id: int) -> None:
        judged = landed.judged_lines(batch)
        landed.accepted(judged).write.mode("overwrite").parquet(f"{path}/records/batch_id={batch_id}")
        landed.quarantined(judged).write.mode("overwrite").parquet(f"{path}/quarantine/batch_id={batch_id}")

    return (
        lines.writeStream.foreachBatch(save)
        .queryName("landed-files")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# ---- API usage -------------------------------------------------------------------


def usage_panes(log: DataFrame, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Usage per source and pane; every call is counted once. Sums stay mergeable."""
    return (
        log.withWatermark("logged_at", delay)
        .groupBy(F.window("logged_at", width).alias("pane"), "source")
        .agg(*history.usage_sums())
        .select(F.col("pane.start").alias("pane_start"), "source", *history.USAGE_SUMS)
    )


def run_usage(log: DataFrame, path: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    return _write_batches(usage_panes(log, delay), "usage-panes", path, checkpoint, "update")


def read_usage(spark: SparkSession, path: str, panes: int = 7) -> DataFrame:
    """Usage over sliding windows of ``panes`` daily panes, merged when read. An updated pane appears once per batch; its
    newest version counts."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("pane_start", "source").agg(F.max_by(F.struct(*history.USAGE_SUMS), "batch_id").alias("sums"))
    return history.rolling_usage(newest.select("pane_start", "source", "sums.*"), panes)


# ---- topic history ------------------------------------------------------------------


def run_history(runs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Totals per topic live in the state store; each batch writes those of its topics."""
    return _write_batches(history.topic_totals(runs), "topic-history", path, checkpoint, "update")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The newest totals of each topic."""
    rows = spark.read.parquet(path)
    newest = F.max_by(F.struct(*[c for c in rows.columns if c != "batch_id"]), "batch_id")
    return history.topic_history(rows.groupBy("topic").agg(newest.alias("totals")).select("totals.*"))


# ---- alerts ---------------------------------------------------------------------------


def run_alerts(runs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Alert rows for the three best trends of every new run."""
    alerts = runs.select(
        "id",
        "topic",
        "captured_at",
        F.posexplode(F.transform(F.slice("trends", 1, 3), reports.alert_line)).alias("pos", "line"),
    )
    return _write(alerts, "trend-alerts", path, checkpoint)

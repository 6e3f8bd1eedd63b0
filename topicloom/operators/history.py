"""Run history, API usage and topic totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.text import topic_key
from topicloom.operators.ranking import first_per_group, top_per_group

RECENT_TOPICS = 25
RECENT_RUNS = 10
SCORE_RUNS = 10
SCORE_SCALE = 90


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each topic."""
    return first_per_group(runs, ["topic"], [F.desc("captured_at"), F.asc("id")])


def recent_topics(runs: DataFrame, limit: int = RECENT_TOPICS, by_name: bool = False) -> DataFrame:
    """Newest run of ``limit`` topics, newest first. ``by_name`` takes the first topics by
    name instead of the most recent ones."""
    latest = latest_runs(runs).select("topic", "captured_at", "elapsed_secs", "sources_count")
    newest = [F.desc("captured_at"), F.asc("topic")]
    if by_name:
        latest = latest.orderBy("topic").limit(limit)
        return latest.orderBy(*newest)
    return latest.orderBy(*newest).limit(limit)


def runs_of_topic(runs: DataFrame, topic: str, limit: int = RECENT_RUNS) -> DataFrame:
    return runs.where(F.col("topic") == topic).orderBy(F.desc("captured_at"), F.asc("id")).limit(limit)


def usage_order() -> list[Column]:
    return [F.desc("total_calls"), F.asc("source")]


def usage_summary(log: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Calls, mean response time, records and errors per source over the last ``days``."""
    window = log.where(F.col("logged_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    return (
        window.groupBy("source")
        .agg(
            F.count("*").alias("total_calls"),
            F.round(F.coalesce(F.avg("response_ms"), F.lit(0.0)), 1).alias("avg_response_ms"),
            F.sum("record_count").alias("total_records"),
            F.count_if(F.col("status_code") >= 400).alias("error_count"),
        )
        .orderBy(*usage_order())
    )


#: Mergeable sums of API calls.
USAGE_SUMS = ["total_calls", "timed_calls", "sum_ms", "total_records", "error_count"]


def usage_sums() -> list[Column]:
    return [
        F.count("*").alias("total_calls"),
        F.count("response_ms").alias("timed_calls"),
        F.sum("response_ms").alias("sum_ms"),
        F.sum("record_count").alias("total_records"),
        F.count_if(F.col("status_code") >= 400).alias("error_count"),
    ]


def usage_panes(log: DataFrame) -> DataFrame:
    """Usage sums per source and day, each call counted once."""
    return log.groupBy(F.date_trunc("day", "logged_at").alias("pane_start"), "source").agg(*usage_sums())


def _merged_usage(panes: DataFrame, *keys: str) -> DataFrame:
    """One row per key out of panes' sums."""
    sums = panes.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in USAGE_SUMS])
    mean = F.round(F.coalesce(F.col("sum_ms") / F.nullif("timed_calls", F.lit(0)), F.lit(0.0)), 1)
    return sums.select(*keys, "total_calls", mean.alias("avg_response_ms"), "total_records", "error_count")


def rolling_usage(panes: DataFrame, days: int = 7) -> DataFrame:
    """Usage per source over windows of ``days`` daily panes, one window a day. A pane, not a call, is in ``days`` windows."""
    starts = F.sequence(F.col("pane_start") - F.expr(f"INTERVAL {days - 1} DAYS"), F.col("pane_start"), F.expr("INTERVAL 1 DAY"))
    rows = panes.withColumn("window_start", F.explode(starts))
    merged = _merged_usage(rows, "window_start", "source")
    return merged.withColumn("window_end", F.col("window_start") + F.expr(f"INTERVAL {days} DAYS"))


def usage_from_panes(panes: DataFrame, log: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """``usage_summary`` out of stored panes: of the log only the part of a day is read with which the window begins."""
    start = as_of - F.expr(f"INTERVAL {days} DAYS")
    whole = F.date_trunc("day", start) + F.when(start == F.date_trunc("day", start), F.expr("INTERVAL 0 DAYS")).otherwise(F.expr("INTERVAL 1 DAY"))
    edge = log.where((F.col("logged_at") >= start) & (F.col("logged_at") < whole))
    held = panes.where(F.col("pane_start") >= whole).unionByName(usage_panes(edge))
    return _merged_usage(held, "source").orderBy(*usage_order())


def topic_totals(runs: DataFrame) -> DataFrame:
    """Mergeable state per topic: runs, summed elapsed time, last run."""
    return runs.groupBy("topic").agg(
        F.count("*").alias("total_runs"),
        F.sum("elapsed_secs").alias("sum_elapsed"),
        F.max("captured_at").alias("last_run_at"),
    )


def merge_totals(*states: DataFrame) -> DataFrame:
    """One state out of several; how new runs are folded into the stored history."""
    union = states[0]
    for state in states[1:]:
        union = union.unionByName(state)
    return union.groupBy("topic").agg(
        F.sum("total_runs").alias("total_runs"),
        F.sum("sum_elapsed").alias("sum_elapsed"),
        F.max("last_run_at").alias("last_run_at"),
    )


def topic_history(state: DataFrame) -> DataFrame:
    return state.select(
        "topic", "last_run_at", "total_runs", (F.col("sum_elapsed") / F.col("total_runs")).alias("avg_elapsed")
    )


def last_runs(runs: DataFrame, n: int = SCORE_RUNS) -> DataFrame:
    """The last ``n`` runs of each topic; ``back`` is 1 for the newest."""
    return top_per_group(runs, ["topic"], [F.desc("captured_at"), F.desc("id")], n, "back")


def score_history(runs: DataFrame) -> DataFrame:
    """(topic, back, pos, value): trend scores of the last ten runs on a 0-90 scale of their
    maximum. A topic contributes at most ten runs of twelve trends to its window."""
    points = last_runs(runs).select("topic", "back", F.posexplode("trends").alias("pos", "trend"))
    best = F.max("trend.score").over(Window.partitionBy("topic"))
    top = F.when(best == 0, F.lit(1.0)).otherwise(best)
    value = F.least(F.lit(100), F.bround(F.col("trend.score") / top * SCORE_SCALE, 0).cast("int"))
    return points.select("topic", "back", "pos", value.alias("value"))


def merge_histories(server: DataFrame, local: DataFrame, limit: int = RECENT_TOPICS) -> DataFrame:
    """Distinct topics (case and outer blanks ignored), server rows first; both inputs
    carry ``topic`` and ``ord``."""
    both = server.select("topic", "ord", F.lit(0).alias("side")).unionByName(
        local.select("topic", "ord", F.lit(1).alias("side"))
    )
    keyed = both.withColumn("key", F.lower(F.trim(F.coalesce("topic", F.lit(""))))).where(F.col("key") != "")
    place = [F.asc("side"), F.asc("ord"), F.asc("topic")]
    return first_per_group(keyed, ["key"], place).orderBy(*place).limit(limit)


def latest_trends(runs: DataFrame) -> DataFrame:
    """(topic_key, trends) of the newest snapshot per normalised topic. A ``topic_key`` that the runs carry is used as it
    is, so that runs bucketed by it need no exchange."""
    key = F.col("topic_key") if "topic_key" in runs.columns else topic_key(F.col("topic")).alias("topic_key")
    return runs.groupBy(key).agg(
        F.max_by("trends", F.struct("captured_at", "id")).alias("trends")
    )

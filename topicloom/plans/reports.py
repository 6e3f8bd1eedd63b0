"""The history page and the market view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.operators import history, jobs, series


def history_report(runs: DataFrame, usage: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """(report, name, n): recent topics, usage per source and the number of runs."""
    recent = history.recent_topics(runs).select(
        F.lit("runs").alias("report"), F.col("topic").alias("name"), F.col("sources_count").alias("n")
    )
    calls = history.usage_summary(usage, as_of, days).select(
        F.lit("usage").alias("report"), F.col("source").alias("name"), F.col("total_calls").alias("n")
    )
    total = runs.agg(F.count("*").alias("n")).select(F.lit("total").alias("report"), F.lit("runs").alias("name"), "n")
    return recent.unionByName(calls).unionByName(total)


def market_intel(timeline: DataFrame, listings: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """One row per topic: series summary, 52-week forecast and job summary."""
    ahead = series.forecast(timeline)
    forecast = ahead.groupBy("topic").agg(
        F.array_sort(F.collect_list(F.struct("step", "dt", "value"))).alias("forecast")
    )
    return (
        series.summarise(timeline)
        .join(forecast, "topic", "left")
        .join(jobs.summarise_jobs(listings, totals), "topic", "full")
    )

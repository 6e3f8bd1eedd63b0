"""Filters, orders and derived columns of the explore view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.operators.ranking import in_order

SENTIMENTS = ("positive", "negative", "neutral")
DATE_RANGES = {"7d": 7, "30d": 30, "90d": 90}


def by_source(results: DataFrame, source: str) -> DataFrame:
    return results.where(F.col("source") == source)


def by_sentiment(results: DataFrame, label: str) -> DataFrame:
    """A missing sentiment counts as neutral."""
    return results.where(F.coalesce("sentiment.label", F.lit("neutral")) == label)


def by_date_range(results: DataFrame, name: str, as_of: Column) -> DataFrame:
    """A missing date counts as the epoch; ``all`` keeps everything."""
    if name == "all":
        return results
    # Not wrapped in coalesce, so that the bound reaches the scan; a null never passes.
    return results.where(F.col("collected_at") >= as_of - F.expr(f"INTERVAL {DATE_RANGES.get(name, 90)} DAYS"))


def by_likes(results: DataFrame, at_least: int) -> DataFrame:
    """Only linkedin rows carry likes; other rows pass."""
    if at_least <= 0:
        return results
    return results.where((F.col("source") != "linkedin") | (F.coalesce("likes", F.lit(0)) >= at_least))


def sort_keys(order: str, arrival: str) -> list[Column]:
    if order == "date":
        return [F.desc_nulls_last("collected_at"), F.asc(arrival)]
    if order == "sentiment":
        return [F.desc(F.coalesce("sentiment.score", F.lit(0.0))), F.asc(arrival)]
    return [F.asc(arrival)]


def sort_results(results: DataFrame, order: str, arrival: str) -> DataFrame:
    return results.orderBy(*sort_keys(order, arrival))


def ranked_results(results: DataFrame, order: str, arrival: str) -> DataFrame:
    """Results with their ``position`` in the order."""
    return in_order(results, sort_keys(order, arrival))


def explore(results: DataFrame, as_of: Column, arrival: str, show: str = "all", date_range: str = "all",
            likes: int = 0, order: str = "relevance") -> DataFrame:
    """``show`` is ``all``, a sentiment label or a source."""
    if show in SENTIMENTS:
        results = by_sentiment(results, show)
    elif show != "all":
        results = by_source(results, show)
    return sort_results(by_likes(by_date_range(results, date_range, as_of), likes), order, arrival)


def results_per_query(queries: DataFrame, results: DataFrame) -> DataFrame:
    counts = results.groupBy("query").agg(F.count("*").alias("results"))
    return queries.join(counts, "query", "left").na.fill({"results": 0})


def trend_shares(trends: Column) -> Column:
    """Trends with ``share``: the score as a percentage of the best (at least 1), one decimal."""
    best = F.greatest(F.array_max(F.transform(trends, lambda t: t["score"])), F.lit(1.0))
    return F.transform(
        trends,
        lambda t: F.struct(t["label"].alias("label"), F.round(t["score"] / best * 100, 1).alias("share")),
    )

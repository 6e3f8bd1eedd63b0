"""Engagement arithmetic, source types and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NEWS_HOSTS = ["news", "reuters", "techcrunch", "forbes", "wsj", "bbc", "cnn"]
BLOG_HOSTS = ["blog", "medium", "substack", "wordpress"]
SOURCE_WEIGHTS = {"news": 0.8, "blog": 0.5, "unknown": 0.3}
HOST_PATTERN = r"^[a-zA-Z][^:]*://([^/?#]*)"
ENGAGEMENT_GATE = 5.0
TIMELINES = {"7h": 7, "24h": 24, "48h": 48, "7d": 168, "30d": 720, "90d": 2160, "180d": 4320}
DEFAULT_TIMELINE = "30d"


def total_engagement(likes: Column, comments: Column, shares: Column) -> Column:
    zero = F.lit(0)
    return F.coalesce(likes, zero) + F.coalesce(comments, zero) + F.coalesce(shares, zero)


def baseline_engagement(current: Column, total: Column) -> Column:
    """A tenth of the interactions, at most 100, where no score is set yet."""
    unset = F.coalesce(current, F.lit(0.0)) == 0
    return F.when(unset & (total > 0), F.least(total / 10.0, F.lit(100.0))).otherwise(
        F.coalesce(current, F.lit(0.0))
    )


def source_type(source: Column, url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, HOST_PATTERN, 1))
    news = (F.lower(F.coalesce(source, F.lit(""))) == "newsapi") | host.rlike("|".join(NEWS_HOSTS))
    return F.when(news, "news").when(host.rlike("|".join(BLOG_HOSTS)), "blog").otherwise("unknown")


def source_weight(kind: Column) -> Column:
    weight = F.lit(SOURCE_WEIGHTS["unknown"])
    for name in ("blog", "news"):
        weight = F.when(kind == name, SOURCE_WEIGHTS[name]).otherwise(weight)
    return weight


def timeline_cutoff(timeline: str, as_of: Column) -> Column:
    """The start of a named look-back window; an unknown name means 30 days."""
    hours = TIMELINES.get(timeline, TIMELINES[DEFAULT_TIMELINE])
    return as_of - F.expr(f"INTERVAL {hours} HOURS")


def shares_of_largest(likes: Column, comments: Column, shares: Column) -> list[Column]:
    """Each metric as a percentage of the largest of the three."""
    parts = {"likes": likes, "comments": comments, "shares": shares}
    filled = {k: F.coalesce(v, F.lit(0)) for k, v in parts.items()}
    largest = F.greatest(*filled.values(), F.lit(1))
    return [F.bround(v * 100.0 / largest, 0).cast("bigint").alias(f"{k}_pct") for k, v in filled.items()]

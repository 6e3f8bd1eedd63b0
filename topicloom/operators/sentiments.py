"""Sentiment summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.sentiment import label_of, sentiment


def with_sentiment(posts: DataFrame, text: str = "content") -> DataFrame:
    return posts.withColumn("sentiment", sentiment(F.col(text)))


def _summary() -> list[Column]:
    def pct(label: str) -> Column:
        return F.round(F.count_if(F.col("label") == label) / F.count("*") * 100, 1).alias(f"{label}_pct")

    mean = F.round(F.sum("milli_score") / F.count("*") / 1000, 3)
    return [
        label_of(mean).alias("overall_label"),
        mean.alias("overall_score"),
        pct("positive"),
        pct("negative"),
        pct("neutral"),
        F.count("*").alias("count"),
    ]


def _flat(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Scores have three decimals, so whole thousandths add up exactly in any order."""
    return scored.select(
        *keys,
        F.col("sentiment.label").alias("label"),
        F.round(F.col("sentiment.score") * 1000).cast("bigint").alias("milli_score"),
    )


def sentiment_summary(scored: DataFrame, keys: list[str]) -> DataFrame:
    return _flat(scored, keys).groupBy(*keys).agg(*_summary())


def sentiment_by_source(scored: DataFrame, topic: str = "topic", source: str = "source") -> DataFrame:
    """Overall rows (source ``(all)``) and one row per source, in one pass."""
    by = F.when(F.grouping(source) == 1, F.lit("(all)")).otherwise(F.col(source))
    return (
        _flat(scored, [topic, source])
        .groupingSets([[F.col(topic)], [F.col(topic), F.col(source)]], F.col(topic), F.col(source))
        .agg(by.alias("_source"), *_summary())
        .drop(source)
        .withColumnRenamed("_source", source)
    )


def summary_or_neutral(topics: DataFrame, summary: DataFrame, topic: str = "topic") -> DataFrame:
    """Every topic, with the neutral summary where it has no posts."""
    return topics.select(topic).join(summary, topic, "left").na.fill(
        {
            "overall_label": "neutral",
            "overall_score": 0.0,
            "positive_pct": 0.0,
            "negative_pct": 0.0,
            "neutral_pct": 100.0,
            "count": 0,
        }
    )

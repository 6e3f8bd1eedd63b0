"""Engagement scores, their scaling over a topic, and the engagement gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.scoring import ENGAGEMENT_GATE, source_type, source_weight, total_engagement
from topicloom.functions.patterns import text_counts
from topicloom.functions.text import let
from topicloom.operators.ranking import ordered_list
from topicloom.session import stage

# Fixed values.
FULL_LENGTH_WORDS = 400
FULL_DENSITY = 0.12
IMPORTANT_RANKS = 10
IMPORTANT_SCORE = 0.3
FULL_INTERACTIONS = 500
INTERACTION_POINTS = 30.0


def keyword_lists(keywords: DataFrame) -> DataFrame:
    """One row per topic: its keywords (at most 40) as an array."""
    important = (F.col("rank") <= IMPORTANT_RANKS) & (F.col("score") >= IMPORTANT_SCORE)
    item = F.struct("keyword", "score", important.alias("important"))
    return keywords.groupBy("topic").agg(ordered_list(F.col("rank"), item).alias("topic_keywords"))


def _hits(items: Column, counts: Column) -> Column:
    hits = F.zip_with(items, counts, lambda k, n: F.struct(k["keyword"], k["score"], k["important"], n.alias("hits")))
    return F.filter(hits, lambda h: h["hits"] > 0)


def _counted(text: Column, items: Column) -> Column:
    return text_counts(F.lower(text), F.transform(items, lambda k: k["keyword"]))


def keyword_hits(text: Column, items: Column) -> Column:
    """Keywords found in a text, as (keyword, score, important, hits); substrings count. One pass over the text."""
    return _hits(items, _counted(text, items)["counts"])


def text_engagement(text: Column, items: Column) -> Column:
    """0-100 from length, keyword density and important keywords; 0 without words. One pass over the text."""
    important_total = F.size(F.filter(items, lambda k: k["important"]))

    def combine(words: Column, hits: Column) -> Column:
        weighted = F.aggregate(hits, F.lit(0.0), lambda acc, h: acc + h["hits"] * h["score"])
        important = F.size(F.filter(hits, lambda h: h["important"]))
        length_part = F.least(words, F.lit(FULL_LENGTH_WORDS)) / F.lit(float(FULL_LENGTH_WORDS))
        density_part = F.least(weighted / words, F.lit(FULL_DENSITY)) / FULL_DENSITY
        important_part = F.least(important / F.greatest(important_total, F.lit(1)), F.lit(1.0))
        return 100.0 * (0.5 * length_part + 0.3 * density_part + 0.2 * important_part)

    # the counts come from Python, which a lambda's body can't call
    return let(
        _counted(text, items),
        lambda f: F.when(f["words"] == 0, F.lit(0.0)).otherwise(combine(f["words"], _hits(items, f["counts"]))),
    )


def raw_scores(posts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(topic, post_id, raw_score): text score times source weight plus real interactions."""
    weight = source_weight(source_type(F.col("source"), F.col("url")))
    total = total_engagement(F.col("likes"), F.col("comments"), F.col("shares"))
    boost = F.least(total / float(FULL_INTERACTIONS), F.lit(1.0)) * INTERACTION_POINTS
    none = F.array().cast("array<struct<keyword:string,score:double,important:boolean>>")
    items = F.coalesce(F.col("topic_keywords"), none)
    return posts.join(keyword_lists(keywords), "topic", "left").select(
        "topic", "post_id", (text_engagement(F.col("content"), items) * (0.7 + weight) + boost).alias("raw_score")
    )


def scale_scores(scores: DataFrame) -> DataFrame:
    """(topic, post_id, engagement_score): min-max to 0-100 over the topic, two decimals.

    The extremes come from a partial aggregate and are joined back, so a hot topic is
    never gathered in one task.
    """
    ends = scores.groupBy("topic").agg(F.min("raw_score").alias("low"), F.max("raw_score").alias("high"))
    span = F.col("high") - F.col("low")
    flat = F.when(F.col("raw_score") > 0, 100.0).otherwise(0.0)
    scaled = F.when(span < 1e-9, flat).otherwise((F.col("raw_score") - F.col("low")) / span * 100.0)
    return scores.join(ends, "topic").select("topic", "post_id", F.round(scaled, 2).alias("engagement_score"))


def score_posts(posts: DataFrame, keywords: DataFrame) -> DataFrame:
    """Scores are computed once, staged as a narrow table, then scaled."""
    return scale_scores(stage(raw_scores(posts, keywords), "raw-scores"))


def passes_gate(threshold: float = ENGAGEMENT_GATE) -> Column:
    total = total_engagement(F.col("likes"), F.col("comments"), F.col("shares"))
    return (F.col("engagement_score") >= threshold) | ((F.col("source") == "linkedin") & (total > 0))


def gate_posts(posts: DataFrame, scores: DataFrame, threshold: float = ENGAGEMENT_GATE) -> DataFrame:
    return posts.drop("engagement_score").join(scores, ["topic", "post_id"]).where(passes_gate(threshold))

"""Collection: expand topics, route landed candidates, try thin topics again with broader queries, apply provider
order and caps, and de-duplicate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.operators import collect as ops
from topicloom.operators.validation import validate_posts
from topicloom.session import stage


@dataclass
class Collected:
    """``queries`` used in the end, validated ``posts`` of each topic, ``groups`` of each query, and the topics that
    were ``retried``."""

    queries: DataFrame
    posts: DataFrame
    groups: DataFrame
    retried: DataFrame


def collect(topics: DataFrame, web: DataFrame, news: DataFrame, fallback: DataFrame, social: DataFrame,
            as_of: Column, arrival: str = "post_id", social_total: int = 25, timeline: str = "30d",
            region: str | None = None) -> Collected:
    """``web``, ``news``, ``fallback``: rows carrying the query they answer. ``social``: rows with a tag and a
    ``provider_rank``, taken for the first three queries of a topic from the first provider that has any, of
    which those before the timeline are then left out.

    Contents are distinct within a topic, and within a query, before contents and URLs are. A topic with
    fewer than three validated rows is collected once more, with its first three queries broadened;
    what those find takes the place of the first wave.
    """

    def wave(queries: DataFrame) -> DataFrame:
        found = ops.with_fallbacks(queries, web, news, fallback)
        return found.drop("topic").join(queries.select("topic", "query"), "query")

    def validated(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("_place", F.struct("topic", arrival))
        return validate_posts(placed, "_place", as_of, within=["topic"]).drop("_place")

    expanded = ops.expand_queries(topics)
    # each of these is read by several branches below
    first = stage(wave(expanded), "first-wave")
    thin = stage(ops.retry_topics(topics, validated(ops.distinct_contents(first, arrival, "topic"))), "thin-topics")
    broad = ops.broaden_queries(expanded.join(thin, "topic", "left_semi"))
    queries = expanded.join(thin, "topic", "left_anti").unionByName(broad)
    base = stage(first.join(thin, "topic", "left_anti").unionByName(wave(broad), allowMissingColumns=True), "collected")

    leading = queries.where(F.col("ord") < ops.ENRICH_QUERIES)
    chosen = ops.first_provider(ops.route_items(ops.in_region(social, region), leading))
    extra = stage(ops.cap_per_query(ops.since(chosen, timeline, as_of), leading, social_total, arrival).drop("tag", "provider_rank"), "enrichment")
    groups = ops.merge_enrichment(
        ops.distinct_contents(base, arrival, "query"), ops.distinct_contents(extra, arrival, "query"), arrival
    )
    by_topic = ops.distinct_contents(base, arrival, "topic").unionByName(extra, allowMissingColumns=True)
    return Collected(queries, validated(by_topic), groups, thin.select("topic"))

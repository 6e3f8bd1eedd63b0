"""Collection over landed candidates: routing, provider order, fallbacks, caps, retries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.lenient import expand_topic
from topicloom.functions.scoring import timeline_cutoff
from topicloom.functions.text import strip
from topicloom.functions.wordlists import REGIONS, RETRY_SUFFIX
from topicloom.operators.ranking import ordered_list, top_per_group
from topicloom.operators.validation import deduplicate, rejection_reason

SECONDARY_BELOW = 10
MIN_DOCS = 3
RETRY_QUERIES = 3
ENRICH_QUERIES = 3


def expand_queries(topics: DataFrame) -> DataFrame:
    """(topic, ord, query): four templated queries per topic."""
    return topics.select("topic", F.posexplode(expand_topic(F.col("topic"))).alias("ord", "query"))


def broaden_queries(queries: DataFrame, suffix: str = RETRY_SUFFIX) -> DataFrame:
    """The first three queries of each topic, with the retry suffix."""
    first = top_per_group(queries, ["topic"], [F.asc("ord")], RETRY_QUERIES)
    return first.select("topic", "ord", F.concat("query", F.lit(suffix)).alias("query"))


def route_items(items: DataFrame, queries: DataFrame) -> DataFrame:
    """Items gain ``query``: the one equal to their tag, else the first that contains the
    tag or is contained in it, else the topic's first.

    A topic has at most eight queries; they travel as one array per topic, so a tag is
    routed inside its row and no item is paired with every query.
    """
    lists = queries.groupBy("topic").agg(ordered_list(F.col("ord"), F.col("query")).alias("_queries"))
    tag, known = F.col("tag"), F.col("_queries")
    similar = F.filter(known, lambda q: F.contains(q, tag) | F.contains(tag, q))
    routed = F.when(F.array_contains(known, tag), tag).otherwise(F.coalesce(F.get(similar, 0), F.get(known, 0)))
    return items.join(lists, "topic").withColumn("query", routed).drop("_queries")


def with_fallbacks(queries: DataFrame, primary: DataFrame, secondary: DataFrame, last: DataFrame,
                   below: int = SECONDARY_BELOW) -> DataFrame:
    """Per query: all primary rows; secondary rows where primary has fewer than ``below``;
    rows of ``last`` where both are empty."""
    counts = primary.groupBy("query").agg(F.count("*").alias("_n"))
    short = queries.select("query").distinct().join(counts, "query", "left").where(F.coalesce("_n", F.lit(0)) < below)
    extra = secondary.join(short.select("query"), "query", "left_semi")
    found = counts.select("query").unionByName(extra.select("query").distinct())
    empty = queries.select("query").distinct().join(found, "query", "left_anti")
    return (
        primary.join(queries.select("query").distinct(), "query", "left_semi")
        .unionByName(extra, allowMissingColumns=True)
        .unionByName(last.join(empty, "query", "left_semi"), allowMissingColumns=True)
    )


def first_provider(rows: DataFrame, provider_rank: str = "provider_rank") -> DataFrame:
    """Per query, the rows of its first provider that returned any."""
    winners = rows.groupBy("query").agg(F.min(provider_rank).alias(provider_rank))
    return rows.join(winners, ["query", provider_rank], "left_semi")


def since(rows: DataFrame, timeline: str, as_of: Column) -> DataFrame:
    return rows.where(F.col("collected_at") >= timeline_cutoff(timeline, as_of))


def in_region(rows: DataFrame, region: str | None) -> DataFrame:
    """Rows of one named region; global or an unknown name means all rows."""
    return rows.where(F.col("region") == region) if region in REGIONS else rows


def cap_per_query(rows: DataFrame, queries: DataFrame, total: int, arrival: str) -> DataFrame:
    """At most ``ceil(total / queries)`` rows per query, then ``total`` per topic in query order.

    The caps are the request size (5 to 200 posts), so both ranks are limited before
    their shuffles.
    """
    sizes = queries.groupBy("topic").agg(
        F.greatest(F.lit(1), F.ceil(F.lit(total) / F.count("*")).cast("int")).alias("_cap")
    )
    ordered = rows.join(queries.select("topic", "query", "ord"), ["topic", "query"])
    first = top_per_group(ordered, ["topic", "query"], [F.asc(arrival)], total, "_n")
    within = first.join(sizes, "topic").where(F.col("_n") <= F.col("_cap"))
    return top_per_group(within, ["topic"], [F.asc("ord"), F.asc("_n")], total, "_rank").drop("_n", "_cap", "_rank", "ord")


def per_query_limit(total: int, queries: int) -> int:
    return max(1, math.ceil(total / queries))


def merge_enrichment(existing: DataFrame, extra: DataFrame, arrival: str) -> DataFrame:
    """Extra rows join the groups of their queries; a repeat of an existing row is dropped."""
    both = existing.withColumn("_wave", F.lit(0)).unionByName(
        extra.withColumn("_wave", F.lit(1)), allowMissingColumns=True
    )
    ordered = both.withColumn("_place", F.struct("_wave", arrival))
    return deduplicate(ordered, ["content", "url"], "_place", within=["query"]).drop("_wave", "_place")


def distinct_contents(rows: DataFrame, arrival: str, within: str) -> DataFrame:
    """Usable rows with stripped texts, each content once ``within`` a topic or a query, whatever its URL."""
    usable = rows.where(rejection_reason(F.col("content"), F.col("url")).isNull())
    stripped = usable.withColumn("content", strip(F.col("content"))).withColumn("url", strip(F.col("url")))
    return deduplicate(stripped, ["content"], arrival, within=[within]).drop("content_hash")


def retry_topics(topics: DataFrame, validated: DataFrame, minimum: int = MIN_DOCS) -> DataFrame:
    """(topic, docs): topics with fewer than ``minimum`` validated rows, none included."""
    counts = validated.groupBy("topic").agg(F.count("*").alias("docs"))
    return (
        topics.select("topic")
        .join(counts, "topic", "left")
        .select("topic", F.coalesce("docs", F.lit(0).cast("bigint")).alias("docs"))
        .where(F.col("docs") < minimum)
    )

"""Trends from any assignment of documents to clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.labels import cluster_label
from topicloom.operators.ranking import ordered_list, top_per_group
from topicloom.operators.terms import RANK_PLACES

CLUSTER_KEYWORDS = 8
MAX_TRENDS = 12


def cluster_terms(documents: DataFrame, assignments: DataFrame, key: str = "post_id") -> DataFrame:
    """(topic, cluster, term, low, mean_weight, frequency) over each cluster's members.

    ``documents``: weighted documents of a term model; ``assignments``: topic, key, cluster.
    Whole documents are joined; their terms are spread out and added up after that.
    """
    sizes = assignments.groupBy("topic", "cluster").agg(F.count("*").alias("members"))
    return (
        documents.join(assignments, ["topic", key])
        # no document is empty, and the inner form would compute the weights a second time to find out
        .select("topic", "cluster", F.inline_outer("items"))
        .groupBy("topic", "cluster", "term", "low")
        .agg(F.sum("weight").alias("weight_sum"), F.sum("literal").alias("frequency"))
        .join(sizes, ["topic", "cluster"])
        .withColumn("mean_weight", F.col("weight_sum") / F.col("members"))
    )


def cluster_keywords(terms: DataFrame, k: int = CLUSTER_KEYWORDS) -> DataFrame:
    """Filtered first, then the ``k`` heaviest terms of each cluster."""
    useful = terms.where((F.col("frequency") > 0) & ~F.col("low"))
    order = [F.desc(F.round("mean_weight", RANK_PLACES)), F.asc("term")]
    return top_per_group(useful, ["topic", "cluster"], order, k)


def cluster_trends(keywords: DataFrame) -> DataFrame:
    """(topic, cluster, label, keywords, score); a cluster without keywords yields no row."""
    return (
        keywords.groupBy("topic", "cluster")
        .agg(
            ordered_list(F.col("rank"), F.col("term")).alias("keywords"),
            F.round(F.avg("mean_weight") * F.sum("frequency"), 5).alias("score"),
        )
        .withColumn("label", cluster_label("keywords"))
    )


def rank_trends(trends: DataFrame, max_trends: int = MAX_TRENDS) -> DataFrame:
    """Best first; equal scores keep cluster order. Adds ``trend_rank``."""
    return top_per_group(trends, ["topic"], [F.desc("score"), F.asc("cluster")], max_trends, "trend_rank")


def trends_of(documents: DataFrame, assignments: DataFrame, key: str = "post_id", max_trends: int = MAX_TRENDS) -> DataFrame:
    return rank_trends(cluster_trends(cluster_keywords(cluster_terms(documents, assignments, key))), max_trends)


def single_cluster(posts: DataFrame, sizes: DataFrame, key: str = "post_id") -> DataFrame:
    """Topics of one document need no clustering: that document is cluster 0."""
    return posts.join(sizes.where("n_docs = 1"), "topic").select("topic", key, F.lit(0).alias("cluster"))


def top_keywords(trends: DataFrame, n: int = 10) -> DataFrame:
    """(topic, rank, keyword): first distinct keywords in trend order, then keyword order."""
    first = (
        trends.select("topic", "trend_rank", F.posexplode("keywords").alias("pos", "keyword"))
        .groupBy("topic", "keyword")
        .agg(F.min(F.col("trend_rank") * 1000 + F.col("pos")).alias("place"))
    )
    return top_per_group(first, ["topic"], [F.asc("place")], n).select("topic", "rank", "keyword")


def trend_lists(trends: DataFrame) -> DataFrame:
    """One row per topic with its ranked trends as ARRAY<STRUCT<label, keywords, score>>."""
    item = F.struct("label", "keywords", "score")
    return trends.groupBy("topic").agg(ordered_list(F.col("trend_rank"), item).alias("trends"))

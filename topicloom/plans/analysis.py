"""Document processing and the full analysis, for all topics of a post table at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.scoring import source_type, source_weight
from topicloom.functions.sentiment import scanned_sentiment
from topicloom.functions.text import preview, topic_key
from topicloom.operators import cluster, engagement, evolution, insights, sentiments, similarity, trends
from topicloom.operators.ranking import ordered_list
from topicloom.operators.terms import TermModel
from topicloom.operators.validation import validate_posts
from topicloom.session import stage

Clustering = Callable[[DataFrame, TermModel], DataFrame]


def kmeans_clusters(restarts: int = cluster.RESTARTS, max_iterations: int = cluster.MAX_ITERATIONS) -> Clustering:
    """Documents of a topic by k-means; a topic's only document is a cluster by itself."""

    def assign(posts: DataFrame, model: TermModel) -> DataFrame:
        many = cluster.cluster_documents(
            posts, model.documents, model.sizes, restarts, max_iterations
        )
        return many.unionByName(trends.single_cluster(posts, model.sizes))

    return assign


def column_clusters(name: str) -> Clustering:
    """Documents grouped by a column they already carry."""
    return lambda posts, model: posts.select("topic", "post_id", F.col(name).alias("cluster"))


class Processed:
    """Scored documents and trends of every topic.

    ``documents``: topic, post_id, source, source_type, source_weight, url,
    content_preview, engagement_score, keywords, collected_at, sentiment, metadata.
    ``trends``: topic, trend_rank, cluster, label, keywords, score.
    """

    def __init__(self, posts: DataFrame, clustering: Clustering | None = None):
        first = TermModel(posts)
        scores = engagement.score_posts(posts, first.keywords())
        # The survivors are read several times below; their scores cost two scans.
        self.posts = stage(engagement.gate_posts(posts, scores), "survivors")
        self.model = TermModel(self.posts)
        kind = source_type(F.col("source"), F.col("url"))
        empty = F.array().cast("array<string>")
        # what is read from the texts comes before the join, which would shuffle them
        told = self.posts.select(
            "topic",
            "post_id",
            "source",
            kind.alias("source_type"),
            source_weight(kind).alias("source_weight"),
            "url",
            preview(F.col("content")).alias("content_preview"),
            "engagement_score",
            "collected_at",
            scanned_sentiment(F.col("content")).alias("sentiment"),
            F.struct("likes", "comments", "shares").alias("metadata"),
        )
        keywords = F.coalesce("keywords", empty).alias("keywords")
        place = told.columns.index("engagement_score") + 1
        self.documents = stage(
            told.join(self.model.document_keywords(), ["topic", "post_id"], "left").select(
                *told.columns[:place], keywords, *told.columns[place:]
            ),
            "documents",
        )
        assign = clustering or kmeans_clusters()
        self.assignments = assign(self.posts, self.model)
        self.trends = stage(trends.trends_of(self.model.documents, self.assignments), "trends")

    def top_keywords(self) -> DataFrame:
        return trends.top_keywords(self.trends)

    def sentiment_summary(self) -> DataFrame:
        return sentiments.sentiment_by_source(self.documents)


def process(posts: DataFrame, clustering: Clustering | None = None) -> Processed:
    """Two passes of terms, the first to score and gate, the second over the survivors. ``posts`` is read several times:
    stage what is costly to compute."""
    return Processed(posts, clustering)


def analyse(posts: DataFrame, history: DataFrame, as_of: Column, arrival: str = "post_id",
            clustering: Clustering | None = None) -> DataFrame:
    """One row per topic: document count, keywords, trends, evolution against the latest
    stored trends, opportunities, insights and sentiment.

    ``history``: topic_key, trends (see ``latest_trends``). A topic without surviving
    documents yields no row.
    """
    # read several times by the terms, the scores and the gate; validation and its shuffle of the texts run once
    return report(process(stage(validate_posts(posts, arrival, as_of), "validated"), clustering), history)


def report(processed: Processed, history: DataFrame) -> DataFrame:
    """The rows of ``analyse`` for processed posts."""
    documents = processed.documents
    lists = trends.trend_lists(processed.trends)
    keywords = processed.top_keywords().groupBy("topic").agg(
        ordered_list(F.col("rank"), F.col("keyword")).alias("top_keywords")
    )
    overall = sentiments.sentiment_summary(documents, ["topic"])
    by_source = sentiments.sentiment_summary(documents, ["topic", "source"])
    fields = [c for c in overall.columns if c != "topic"]
    source_map = by_source.groupBy("topic").agg(
        F.map_from_entries(F.collect_list(F.struct("source", F.struct(*fields)))).alias("by_source")
    )
    no_trends = F.array().cast(f"array<{evolution.TREND_TYPE}>")
    rows = (
        processed.model.sizes.join(lists, "topic", "left")
        .withColumn("trends", F.coalesce("trends", no_trends))
        .withColumn("topic_key", topic_key(F.col("topic")))
        .join(history.select("topic_key", F.col("trends").alias("previous")), "topic_key", "left")
        .join(keywords, "topic", "left")
        .join(insights.top_documents(documents, ["post_id", "engagement_score", "keywords"]), "topic")
        .join(similarity.consistency(documents), "topic", "left")
    )
    rows = evolution.score_opportunities(evolution.trend_evolution(rows)).withColumn(
        "confidence",
        insights.confidence(F.col("n_docs"), F.coalesce("consistency", F.lit(0.0)), F.col("trends")),
    )
    rows = stage(rows, "analysis")
    told = insights.rule_insights(rows)
    return (
        rows.select(
            "topic",
            F.col("n_docs").alias("sources_analysed"),
            F.coalesce("top_keywords", F.array().cast("array<string>")).alias("top_keywords"),
            "trends",
            F.transform(
                "evolution",
                lambda e: F.struct(
                    *[e[f].alias(f) for f in ("trend", "previous_score", "current_score", "change", "status")]
                ),
            ).alias("trend_evolution"),
            F.col("opportunities").alias("opportunity_scores"),
        )
        .join(told.select("topic", F.struct("summary", "key_takeaways", "opportunities", "confidence").alias("insights")), "topic")
        .join(overall.select("topic", F.struct(*fields).alias("sentiment_summary")), "topic")
        .join(source_map, "topic")
    )

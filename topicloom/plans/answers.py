"""Whole answers to analysis requests: stored ones, the analysis of the rest, and what is kept for later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from topicloom.functions.sentiment import sentiment
from topicloom.functions.text import fingerprint
from topicloom.functions.topics import classify_topic
from topicloom.operators import history, reports
from topicloom.operators.ranking import ordered_list
from topicloom.operators.validation import validate_posts
from topicloom.plans.analysis import Clustering, process, report
from topicloom.plans.collect import Collected
from topicloom.session import new_folder, stage, staging
from topicloom.sources import store

# Fixed text: why a topic has no analysis.
NO_DATA = "No valid data collected for this topic."
NO_SURVIVORS = "No posts met the engagement threshold for trend detection."


@dataclass
class Answers:
    """``answers``: one row per request (topic, key, cached, error, answer). ``results``: ranked results of the analysed
    topics' queries. ``documents``: their scored documents. ``runs``, ``snapshots``: rows to append to the stores."""

    answers: DataFrame
    results: DataFrame
    documents: DataFrame
    runs: DataFrame
    snapshots: DataFrame

    def parts(self) -> dict[str, DataFrame]:
        return dict(vars(self))


def open_requests(requests: DataFrame, snapshots: DataFrame, as_of: Column) -> DataFrame:
    """Requests (topic, refresh, and a key if it isn't the topic's fingerprint) with the stored ``result`` they can take, or null."""
    keyed = requests if "key" in requests.columns else requests.withColumn("key", fingerprint(F.col("topic")))
    return store.lookup(keyed.select("topic", "refresh", "key"), store.fresh_snapshots(snapshots, as_of))


def query_results(collected: Collected, topics: DataFrame, arrival: str = "post_id") -> DataFrame:
    """Ranked results of every query of ``topics``."""
    queries = collected.queries.join(topics, "topic", "left_semi")
    groups = collected.groups.join(topics, "topic", "left_semi")
    return reports.ranked_results(queries, groups.withColumn("sentiment", sentiment(F.col("content"))), arrival)


def answer(requests: DataFrame, collected: Collected, runs: DataFrame, snapshots: DataFrame, as_of: Column,
           arrival: str = "post_id", clustering: Clustering | None = None) -> Answers:
    """Requests (topic, refresh) answered from the store where it holds a fresh result, else by analysis.

    ``runs`` (id, topic, captured_at, trends) holds earlier trends, ``snapshots`` (id, key, captured_at, result) earlier
    answers as JSON. Posts of topics that aren't analysed are left out before any text is read. A topic without valid
    posts, or without one that passes the engagement gate, gets an error and is not stored. A request that repeats a topic
    and key counts once and asks for a refresh if one of them does.
    """
    once = open_requests(requests, snapshots, as_of).groupBy("topic", "key").agg(
        F.when(~F.bool_or("refresh"), F.max("result")).alias("result")
    )
    found = stage(once, "requests")
    todo = found.where("result IS NULL").select("topic", "key")
    topics = todo.select("topic").distinct()
    posts = collected.posts.join(topics, "topic", "left_semi")
    valid = stage(validate_posts(posts, arrival, as_of, within=["topic"]), "validated")
    processed = process(valid, clustering)
    told = report(processed, history.latest_trends(runs))

    queries = collected.queries.join(topics, "topic", "left_semi")
    listed = queries.groupBy("topic").agg(ordered_list(F.col("ord"), F.col("query")).alias("queries"))
    counts = valid.groupBy("topic").agg(F.count("*").alias("_valid"))
    fields = [F.col(c) for c in told.columns if c != "topic"]
    rows = (
        todo.join(listed, "topic", "left")
        .join(counts, "topic", "left")
        .join(told.withColumn("_told", F.lit(True)), "topic", "left")
        .select(
            "topic",
            "key",
            F.when(F.col("_valid").isNull(), NO_DATA).when(F.col("_told").isNull(), NO_SURVIVORS).alias("error"),
            F.struct("topic", F.struct(*classify_topic(F.col("topic"))).alias("query_intelligence"), "queries", *fields).alias("answer"),
        )
    )
    made = stage(rows, "answers")
    shape = made.schema["answer"].dataType
    assert isinstance(shape, StructType)
    kept = found.where("result IS NOT NULL").select(
        "topic", "key", F.lit(True).alias("cached"), F.lit(None).cast("string").alias("error"), F.from_json("result", shape).alias("answer")
    )
    fresh = made.select("topic", "key", F.lit(False).alias("cached"), "error", F.when(F.col("error").isNull(), F.col("answer")).alias("answer"))

    good = made.where("error IS NULL")
    return Answers(
        answers=kept.unionByName(fresh),
        results=query_results(collected, topics, arrival),
        documents=processed.documents,
        runs=good.select(
            "topic", as_of.alias("captured_at"), F.col("answer.sources_analysed").alias("sources_count"), "answer.trends", "answer.insights"
        ),
        snapshots=good.select("key", as_of.alias("captured_at"), F.to_json("answer").alias("result")),
    )


def write_answers(spark: SparkSession, build, folder: str | None = None) -> Answers:
    """``build()`` -> Answers, written to ``folder`` and read from there. All that was staged for it is gone afterwards."""
    folder = folder or new_folder(spark, "answers")
    with staging(spark):
        made = build().parts()
        shapes = {name: df.schema for name, df in made.items()}
        for name, df in made.items():
            df.write.parquet(f"{folder}/{name}")
    return Answers(**{name: spark.read.schema(shape).parquet(f"{folder}/{name}") for name, shape in shapes.items()})

"""Nested results and report lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import decimal_text, preview
from topicloom.operators.ranking import ranked_in_groups
from topicloom.session import stage

PAGE_SPAN = 1000


def nested_results(queries: DataFrame, posts: DataFrame, arrival: str = "post_id", span: int = PAGE_SPAN) -> DataFrame:
    """(ord, query, page, results): the results of each query as arrays, in arrival order;
    a query without results has one empty array.

    A query's results are cut into pages of ``span`` consecutive arrival numbers, so no
    array grows beyond ``span`` elements however many results one query has.
    """
    item = F.struct(
        F.col(arrival).alias("arrival"),
        "source",
        "url",
        preview(F.col("content"), 240).alias("content_preview"),
        "collected_at",
        "sentiment",
        F.struct("likes", "comments", "shares").alias("metadata"),
    )
    pages = (
        posts.groupBy("query", F.floor(F.col(arrival) / span).alias("page"))
        .agg(F.array_sort(F.collect_list(item)).alias("results"))
    )
    empty = F.array().cast(pages.schema["results"].dataType)
    return queries.join(pages, "query", "left").select(
        "ord", "query", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("results", empty).alias("results")
    )


def ranked_results(queries: DataFrame, posts: DataFrame, arrival: str = "post_id") -> DataFrame:
    """(ord, query, rank, arrival, source, url, content_preview, collected_at, sentiment, metadata): one row per result of a
    query, ranked by arrival; a query without results has one row without a rank. ``queries`` may carry a topic, by which
    results are then kept apart. The shape doesn't depend on how arrival numbers are dealt."""
    keys = [c for c in ("topic", "query") if c in queries.columns]
    made = posts.select(
        *keys,
        F.col(arrival).alias("arrival"),
        "source",
        "url",
        preview(F.col("content"), 240).alias("content_preview"),
        "collected_at",
        "sentiment",
        F.struct("likes", "comments", "shares").alias("metadata"),
    )
    results = stage(made, "results")  # the sort reads its input twice
    ranked = ranked_in_groups(results, keys, [F.col("arrival")])
    return queries.select(*keys, "ord").join(ranked, keys, "left").select(*keys, "ord", "rank", *results.columns[len(keys):])


def _keywords(trend: Column) -> Column:
    few = F.slice(trend["keywords"], 1, 5)
    return F.when(F.size(few) > 0, F.concat_ws(", ", few)).otherwise(F.lit("—"))


def report_line(trend: Column) -> Column:
    return F.concat(
        trend["label"], F.lit("  (score: "), decimal_text(trend["score"]), F.lit(")  —  "), _keywords(trend)
    )


def digest_line(trend: Column) -> Column:
    return F.concat(trend["label"], F.lit(" "), decimal_text(trend["score"]))


def alert_line(trend: Column) -> Column:
    return F.concat(F.lit("• *"), trend["label"], F.lit("* (score "), decimal_text(trend["score"]), F.lit(")"))


SECTIONS = {"report": (8, report_line), "digest": (5, digest_line), "alert": (3, alert_line)}


def report_rows(runs: DataFrame) -> DataFrame:
    """(topic, section, rank, line) from runs with a ranked ``trends`` array."""
    def section(name: str, n: int, line: Callable[[Column], Column]) -> Column:
        return F.transform(
            F.slice("trends", 1, n),
            lambda t, i: F.struct(F.lit(name).alias("section"), (i + 1).alias("rank"), line(t).alias("line")),
        )

    lines = F.concat(*[section(name, n, line) for name, (n, line) in SECTIONS.items()])
    return runs.select("topic", F.inline(lines))


def headline(trends: Column) -> Column:
    """First four labels in one line."""
    labels = F.transform(F.slice(trends, 1, 4), lambda t: t["label"])
    return F.when(F.size(labels) > 0, F.concat_ws(" · ", labels)).otherwise(F.lit("N/A"))

"""Rule-based insights and the structured summary, one row per topic.

Inputs are per-topic rows of bounded size: at most twelve ranked trends and the three
documents of highest engagement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import decimal_text, let
from topicloom.operators.ranking import ordered_list, top_per_group

TOP_DOCS = 3
LEAD_TRENDS = 3
TAKEAWAYS = 4
OPPORTUNITIES = 3

# Fixed sentences.
TEXTS = {
    "summary": "Analysis of %d filtered sources for '%s' shows the strongest trend clusters around %s. "
    "High-engagement documents reinforce these clusters through repeated keyword overlap and concentrated scoring.",
    "no_trends": "Analysis of %d filtered sources for '%s' found limited cluster separation, "
    "with only sparse supporting signals in the structured data.",
    "supported": "'%s' is a leading trend because its cluster score is %s and it overlaps with high-engagement "
    "content scored at %s, especially around %s.",
    "unsupported": "'%s' stands out through a cluster score of %s and repeated keywords such as %s.",
    "few_takeaways": "Structured signals are limited beyond the highest-scoring clusters.",
    "opportunity": "A focused offering or content strategy around '%s' is supported by its cluster score of %s "
    "and recurring keywords like %s.",
    "few_opportunities": "Additional data collection is needed before identifying further opportunities.",
}


def top_documents(documents: DataFrame, fields: list[str], n: int = TOP_DOCS) -> DataFrame:
    """(topic, top_docs): the ``n`` documents of highest engagement; equals by arrival."""
    order = [F.desc("engagement_score"), F.asc("post_id")]
    top = top_per_group(documents, ["topic"], order, n)
    return top.groupBy("topic").agg(ordered_list(F.col("rank"), F.struct(*fields)).alias("top_docs"))


def supporting_document(trend: Column, top_docs: Column) -> Column:
    """The first top document that shares a keyword with the trend, or null."""
    return F.get(F.filter(top_docs, lambda d: F.arrays_overlap(d["keywords"], trend["keywords"])), 0)


def _some(keywords: Column, n: int = 3) -> Column:
    return F.concat_ws(", ", F.slice(keywords, 1, n))


def _takeaway(trend: Column, top_docs: Column) -> Column:
    def text(doc: Column) -> Column:
        return F.when(
            doc.isNotNull(),
            F.format_string(
                TEXTS["supported"],
                trend["label"],
                decimal_text(trend["score"]),
                decimal_text(doc["engagement_score"]),
                _some(doc["keywords"]),
            ),
        ).otherwise(
            F.format_string(
                TEXTS["unsupported"], trend["label"], decimal_text(trend["score"]), _some(trend["keywords"])
            )
        )

    return let(F.struct(supporting_document(trend, top_docs).alias("d")), lambda s: text(s["d"]))


def _padded(items: Column, filler: str, n: int) -> Column:
    return F.slice(F.concat(items, F.array_repeat(F.lit(filler), n)), 1, n)


def rule_insights(topics: DataFrame) -> DataFrame:
    """Rows (topic, n_docs, trends, top_docs, confidence) gain summary, key_takeaways and
    opportunities."""
    lead = F.slice("trends", 1, LEAD_TRENDS)
    named = F.transform(lead, lambda t: F.concat(t["label"], F.lit(" ("), decimal_text(t["score"]), F.lit(")")))
    summary = F.when(
        F.size(lead) > 0,
        F.format_string(TEXTS["summary"], F.col("n_docs"), F.col("topic"), F.concat_ws(", ", named)),
    ).otherwise(F.format_string(TEXTS["no_trends"], F.col("n_docs"), F.col("topic")))
    takeaways = F.transform(lead, lambda t: _takeaway(t, F.col("top_docs")))
    chances = F.transform(
        lead,
        lambda t: F.format_string(TEXTS["opportunity"], t["label"], decimal_text(t["score"]), _some(t["keywords"])),
    )
    return topics.select(
        "topic",
        summary.alias("summary"),
        _padded(takeaways, TEXTS["few_takeaways"], TAKEAWAYS).alias("key_takeaways"),
        _padded(chances, TEXTS["few_opportunities"], OPPORTUNITIES).alias("opportunities"),
        "confidence",
    )


def confidence(n_docs: Column, consistency: Column, trends: Column) -> Column:
    """0-1 from document count, keyword consistency and the three best trend scores."""
    strength = F.aggregate(
        F.transform(F.slice(trends, 1, 3), lambda t: t["score"]), F.lit(0.0), lambda acc, s: acc + s
    )
    value = (
        0.35 * F.least(n_docs / 12.0, F.lit(1.0))
        + 0.3 * consistency
        + 0.35 * F.least(strength / 9.0, F.lit(1.0))
    )
    return F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), 2)


def structured_summary(topics: DataFrame) -> DataFrame:
    """Rows (topic, n_docs, top_keywords, trends, top_docs) cut to the compact summary."""
    return topics.select(
        "topic",
        F.col("n_docs").alias("total_sources"),
        F.slice("top_keywords", 1, 8).alias("top_keywords"),
        F.transform(
            F.slice("trends", 1, 6),
            lambda t: F.struct(
                t["label"].alias("label"),
                F.slice(t["keywords"], 1, 4).alias("keywords"),
                F.round(t["score"], 3).alias("score"),
            ),
        ).alias("trends"),
        F.transform(
            "top_docs",
            lambda d: F.struct(
                d["source"].alias("source"),
                d["engagement_score"].alias("engagement"),
                F.substring(d["content_preview"], 1, 100).alias("preview"),
            ),
        ).alias("top_docs"),
    )

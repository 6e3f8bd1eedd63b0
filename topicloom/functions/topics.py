"""Topic classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.functions.text import counted_words, squeeze
from topicloom.functions.wordlists import GENERIC_SUGGESTIONS, GENERIC_TOPICS, VAGUE_TERMS

# Fixed text.
REASONS = {
    "broad": "The query is very broad and could span multiple industries or use cases.",
    "vague": "The query uses generic language without enough domain context.",
    "modifiers": "Specific topic with meaningful modifiers.",
    "context": "The query already contains enough context to support focused collection.",
}


def _dictionary() -> Column:
    pairs = []
    for topic, suggestions in GENERIC_TOPICS.items():
        pairs += [F.lit(topic), F.array(*[F.lit(s) for s in suggestions])]
    return F.create_map(*pairs)


def dictionary_suggestions(topic: Column) -> Column:
    """The dictionary's suggestions for a topic, or three templated ones."""
    cleaned = squeeze(topic)
    templated = F.array(*[F.concat(cleaned, F.lit(f" {s}")) for s in GENERIC_SUGGESTIONS])
    return F.coalesce(F.try_element_at(_dictionary(), F.lower(cleaned)), templated)


def classify_topic(topic: Column) -> list[Column]:
    """Columns original_query, query_type, reason, effective_topic, suggestions."""
    cleaned = squeeze(topic)
    tokens = counted_words(cleaned)
    count = F.size(tokens)
    broad = (count <= 1) | F.lower(cleaned).isin(list(GENERIC_TOPICS))
    vague = F.exists(tokens, lambda t: t.isin(VAGUE_TERMS)) & (count <= 2)
    suggestions = dictionary_suggestions(topic)
    return [
        cleaned.alias("original_query"),
        F.when(broad, "broad").when(vague, "vague").otherwise("niche").alias("query_type"),
        F.when(broad, REASONS["broad"])
        .when(vague, REASONS["vague"])
        .when(count >= 4, REASONS["context"])
        .otherwise(REASONS["modifiers"])
        .alias("reason"),
        cleaned.alias("effective_topic"),
        F.when(broad | vague, F.slice(suggestions, 1, 3))
        .otherwise(F.array().cast("array<string>"))
        .alias("suggestions"),
    ]


def invalid_request(topic: Column, post_count: Column) -> Column:
    """Null for a valid request, else what is wrong with it."""
    return F.when(
        topic.isNull() | ~F.length(topic).between(2, 200), "topic length must be 2 to 200"
    ).when(~F.coalesce(post_count, F.lit(25)).between(5, 200), "post count must be 5 to 200")

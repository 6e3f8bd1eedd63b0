"""Vocabulary, TF-IDF weights, literal frequencies and keyword ranking, per topic.

Texts are cut in narrow passes, which add up their counts before the shuffle. The vocabulary, at most ``max_terms`` rows per topic, is
staged, so Catalyst knows its size and decides between broadcasting it and shuffling.
Counts of all vocabulary terms come from one pass over a document, whose row stays one
row; weights and document keywords are then arithmetic inside that row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.labels import is_low_signal
from topicloom.functions.patterns import joined, pair_totals, term_counts, token_totals
from topicloom.functions.text import let
from topicloom.functions.wordlists import stop_words as default_stop_words
from topicloom.operators.ranking import top_per_group
from topicloom.session import stage

MAX_TERMS = 250
MAX_KEYWORDS = 40
DOC_KEYWORDS = 8
# Ranks compare weights at this precision, so that the order of a distributed sum
# cannot swap two equal terms.
RANK_PLACES = 10



def lowered(posts: DataFrame, *keys: str) -> DataFrame:
    """(topic, keys, low): the lower-cased text, from which all counts of terms come."""
    return posts.select("topic", *keys, F.lower("content").alias("low"))


def _leaders(words: DataFrame, max_terms: int) -> DataFrame:
    """(topic, words, firsts, any_second): what a pair of the vocabulary can be made of.

    A pair is never more frequent than its words, and behind its first word in the order of the vocabulary. So its
    first word is one of the ``max_terms`` best words, and its second as frequent as the last of them. If too many words
    are exactly that frequent, any word may be the second.
    """
    listed = words.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "total"))).alias("w"))
    least = F.coalesce(F.try_element_at("w", F.lit(max_terms))["total"], F.lit(0))
    open_ended = (F.size("w") == 2 * max_terms) & (F.element_at("w", -1)["total"] >= least)
    kept = F.filter("w", lambda x: (x["rank"] <= max_terms) | (~F.col("any_second") & (x["total"] >= F.col("least"))))
    return listed.select("topic", "w", least.alias("least"), open_ended.alias("any_second")).select(
        "topic",
        joined(F.transform(kept, lambda x: x["term"])).alias("words"),
        F.least(F.size("w"), F.lit(max_terms)).alias("firsts"),
        "any_second",
    )


def vocabulary_of(texts: DataFrame, max_terms: int = MAX_TERMS, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``vocabulary`` from (topic, low). Words are counted first, then the pairs that the best words can form, so that
    neither rows of tokens nor the counts of all pairs are shuffled."""
    stops = stop_words or default_stop_words()
    schema = f"topic {texts.schema['topic'].dataType.simpleString()}, term string, total long"
    best = [F.desc("total"), F.asc("term")]

    def added(parts: DataFrame) -> DataFrame:
        return parts.groupBy("topic", "term").agg(F.sum("total").alias("total"))

    singles = added(texts.select("topic", "low").mapInArrow(token_totals(stops), schema))
    words = stage(top_per_group(singles, ["topic"], best, 2 * max_terms), "words")
    leaders = _leaders(words, max_terms).withColumnRenamed("topic", "_topic")
    named = texts.join(leaders, F.col("topic").eqNullSafe(F.col("_topic")))
    pairs = added(named.select("topic", "low", "words", "firsts", "any_second").mapInArrow(pair_totals(stops), schema))
    counts = words.where(F.col("rank") <= max_terms).select("topic", "term", "total").unionByName(pairs)
    terms = top_per_group(counts, ["topic"], best, max_terms)
    return terms.select("topic", "term", "total", (F.col("rank") - 1).alias("idx"))


def vocabulary(posts: DataFrame, max_terms: int = MAX_TERMS, stop_words: Sequence[str] | None = None) -> DataFrame:
    """(topic, term, total, idx): the ``max_terms`` most frequent terms of each topic,
    numbered from 0."""
    return vocabulary_of(lowered(posts), max_terms, stop_words)


def counts_of(texts: DataFrame, vocab: DataFrame, key: str = "post_id", stop_words: Sequence[str] | None = None) -> DataFrame:
    """``document_counts`` from (topic, key, low).

    A topic's vocabulary, at most ``max_terms`` terms, travels as one array. Both counts of
    all its terms come from one pass over the text, in the row: nothing is exploded, and
    texts are shuffled only where the vocabularies are too large to be broadcast.
    """
    listed = vocab.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("idx", "term"))).alias("t"))
    rows = texts.join(listed.select("topic", joined(F.transform("t", lambda t: t["term"])).alias("terms")), "topic")
    types = [f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in ("topic", key)]
    return rows.select("topic", key, "low", "terms").mapInArrow(
        term_counts(stop_words or default_stop_words()), ", ".join([*types, "items array<struct<idx:int,tf:int,literal:int>>"])
    )


def document_counts(posts: DataFrame, vocab: DataFrame, key: str = "post_id",
                    stop_words: Sequence[str] | None = None) -> DataFrame:
    """(topic, key, items): per document the vectoriser count ``tf`` and the whole-word
    ``literal`` count of each vocabulary term, as ARRAY<STRUCT<idx, tf, literal>>."""
    return counts_of(lowered(posts, key), vocab, key, stop_words)


def term_statistics(documents: DataFrame, vocab: DataFrame, sizes: DataFrame) -> DataFrame:
    """(topic, idx, term, df, frequency, idf, n_docs)."""
    return (
        documents.select("topic", F.inline("items"))
        .groupBy("topic", "idx")
        .agg(F.count_if(F.col("tf") > 0).alias("df"), F.sum("literal").alias("frequency"))
        .join(vocab.select("topic", "idx", "term"), ["topic", "idx"])
        .join(sizes, "topic")
        .withColumn("idf", F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)
    )


def topic_arrays(statistics: DataFrame) -> DataFrame:
    """One row per topic: its terms by number, as an array of (idx, term, idf, low)."""
    item = F.struct("idx", "term", "idf", is_low_signal("term").alias("low"))
    return statistics.groupBy("topic").agg(F.array_sort(F.collect_list(item)).alias("_terms"))


def weighted_documents(documents: DataFrame, statistics: DataFrame, key: str = "post_id") -> DataFrame:
    """(topic, key, items): the counts with ``term``, ``low`` and ``weight``: tf x idf,
    scaled to unit length per document."""

    def named(terms: Column, items: Column) -> Column:
        # Terms are sorted by idx, and every number of the vocabulary has its entry.
        return F.transform(
            items,
            lambda i: F.struct(
                i["idx"].alias("idx"),
                F.get(terms, i["idx"])["term"].alias("term"),
                F.get(terms, i["idx"])["low"].alias("low"),
                i["tf"].alias("tf"),
                i["literal"].alias("literal"),
                (i["tf"] * F.get(terms, i["idx"])["idf"]).alias("raw"),
            ),
        )

    def scaled(items: Column) -> Column:
        norm = F.sqrt(F.aggregate(items, F.lit(0.0), lambda acc, i: acc + i["raw"] * i["raw"]))
        return let(
            norm,
            lambda n: F.transform(
                items,
                lambda i: F.struct(
                    i["idx"], i["term"], i["low"], i["tf"], i["literal"],
                    F.when(n > 0, i["raw"] / n).otherwise(0.0).alias("weight"),
                ),
            ),
        )

    both = documents.join(topic_arrays(statistics), "topic")
    return both.select("topic", key, let(named(F.col("_terms"), F.col("items")), scaled).alias("items"))


class TermModel:
    """The term tables of one set of posts (topic, key, content).

    ``sizes``: topic, n_docs; ``vocabulary``: topic, term, total, idx; ``statistics``:
    topic, idx, term, df, frequency, idf, n_docs; ``documents``: topic, key, items with
    idx, term, low, tf, literal and weight. Documents without vocabulary terms are absent
    from ``documents``.
    """

    def __init__(self, posts: DataFrame, key: str = "post_id", max_terms: int = MAX_TERMS,
                 stop_words: Sequence[str] | None = None):
        self.key = key
        self.posts = posts
        # cutting a text again costs less than writing and reading its tokens
        texts = lowered(posts, key)
        self.sizes = stage(posts.groupBy("topic").agg(F.count("*").alias("n_docs")), "sizes")
        self.vocabulary = stage(vocabulary_of(texts, max_terms, stop_words), "vocabulary")
        counts = stage(counts_of(texts, self.vocabulary, key, stop_words), "document-counts")
        self.statistics = stage(term_statistics(counts, self.vocabulary, self.sizes), "term-statistics")
        self.documents = weighted_documents(counts, self.statistics, key)

    def weights(self) -> DataFrame:
        """The long form: topic, key, term, tf, literal, weight."""
        # no document is empty, and the inner form would compute the weights a second time to find out
        rows = self.documents.select("topic", self.key, F.inline_outer("items"))
        return rows.select("topic", self.key, "term", "tf", "literal", "weight")

    def keywords(self, max_keywords: int = MAX_KEYWORDS) -> DataFrame:
        return rank_keywords(self.documents, self.statistics, max_keywords)

    def document_keywords(self, n: int = DOC_KEYWORDS) -> DataFrame:
        return document_keywords(self.documents, self.key, n)


def mean_weights(documents: DataFrame, statistics: DataFrame) -> DataFrame:
    """Mean weight of each term over all documents of its topic, zeros included."""
    sums = (
        documents.select("topic", F.inline_outer("items"))
        .groupBy("topic", "idx")
        .agg(F.sum("weight").alias("weight_sum"))
    )
    return statistics.join(sums, ["topic", "idx"]).withColumn("mean_weight", F.col("weight_sum") / F.col("n_docs"))


def score_keywords(documents: DataFrame, statistics: DataFrame) -> DataFrame:
    """Combined score of every vocabulary term (a group is one topic's vocabulary)."""
    topic = Window.partitionBy("topic")
    mean_part = F.col("mean_weight") / F.greatest(F.max("mean_weight").over(topic), F.lit(1e-9))
    frequency_part = F.col("frequency") / F.greatest(F.max("frequency").over(topic).cast("double"), F.lit(1.0))
    return mean_weights(documents, statistics).withColumn("combined", 0.65 * mean_part + 0.35 * frequency_part)


def rank_keywords(documents: DataFrame, statistics: DataFrame, max_keywords: int = MAX_KEYWORDS) -> DataFrame:
    """The best keywords of each topic: topic, rank, keyword, tfidf_score, frequency, score."""
    useful = score_keywords(documents, statistics).where(~is_low_signal("term"))
    order = [F.desc(F.round("combined", RANK_PLACES)), F.asc("term")]
    return top_per_group(useful, ["topic"], order, max_keywords).select(
        "topic",
        "rank",
        F.col("term").alias("keyword"),
        F.round("mean_weight", 5).alias("tfidf_score"),
        "frequency",
        F.round("combined", 5).alias("score"),
    )


def document_keywords(documents: DataFrame, key: str = "post_id", n: int = DOC_KEYWORDS) -> DataFrame:
    """(topic, key, keywords): the ``n`` heaviest terms, of which low-signal ones are then
    dropped, so a document may be left with none."""
    ordered = F.array_sort(
        F.transform(
            F.filter("items", lambda i: i["weight"] > 0),
            lambda i: F.struct((-F.round(i["weight"], RANK_PLACES)).alias("o"), i["term"].alias("term"), i["low"].alias("low")),
        )
    )
    best = F.filter(F.slice(ordered, 1, n), lambda i: ~i["low"])
    return documents.select("topic", key, F.transform(best, lambda i: i["term"]).alias("keywords"))

"""Sentiment, terms, engagement and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import labels, scoring, text
from topicloom.operators import engagement, sentiments, terms, trends
from topicloom.operators.ranking import ordered_list
from topicloom.registry.base import query
from topicloom.registry.sqltext import label_tokens
from topicloom.session import stage
from topicloom.sources.tables import Tables

# ---- sentiment ---------------------------------------------------------------


def _sentiments(t: Tables, urls: bool = False):
    return sentiments.with_sentiment(t.posts(urls=urls, engagement=False))


@query("ag7_sentiment", "SELECT post_id, positive, negative, score, label FROM sentiment_v")
def ag7(t):
    s = _sentiments(t)
    return s.select("post_id", "sentiment.positive", "sentiment.negative", "sentiment.score", "sentiment.label")


SUMMARY_SQL = """
SELECT *, CASE WHEN overall_score > 0.08 THEN 'positive' WHEN overall_score < -0.08 THEN 'negative' ELSE 'neutral' END AS overall_label
FROM (SELECT {keys}, count(*) AS count, round(CAST(sum(CAST(round(score * 1000) AS BIGINT)) AS DOUBLE) / count(*) / 1000, 3) AS overall_score,
  round(count(*) FILTER (label = 'positive') / count(*) * 100, 1) AS positive_pct,
  round(count(*) FILTER (label = 'negative') / count(*) * 100, 1) AS negative_pct,
  round(count(*) FILTER (label = 'neutral') / count(*) * 100, 1) AS neutral_pct
FROM posts_v JOIN sentiment_v USING (post_id) GROUP BY {group}) s
"""


@query("ag8_sentiment_summary", SUMMARY_SQL.format(keys="topic", group="topic"))
def ag8(t):
    return sentiments.sentiment_summary(_sentiments(t), ["topic"])


@query(
    "ag8_neutral_summary",
    f"""SELECT topic, coalesce(overall_label, 'neutral') AS overall_label, coalesce(overall_score, 0.0) AS overall_score, coalesce(positive_pct, 0.0) AS positive_pct,
      coalesce(negative_pct, 0.0) AS negative_pct, coalesce(neutral_pct, 100.0) AS neutral_pct, coalesce("count", 0) AS "count"
    FROM (SELECT DISTINCT lang AS topic FROM documents UNION SELECT n_name FROM nation) n LEFT JOIN ({SUMMARY_SQL.format(keys="topic", group="topic")}) s USING (topic)""",
)
def ag8_neutral(t):
    """The languages of the posts and the nations as topics; nations have no posts."""
    topics = t.read("documents").select(F.col("lang").alias("topic")).union(t.read("nation").select("n_name")).distinct()
    return sentiments.summary_or_neutral(topics, sentiments.sentiment_summary(_sentiments(t), ["topic"]))


@query(
    "ag9_sentiment_by_source",
    SUMMARY_SQL.format(
        keys="topic, CASE WHEN grouping(source) = 1 THEN '(all)' ELSE source END AS source",
        group="GROUPING SETS ((topic), (topic, source))",
    ),
)
def ag9(t):
    return sentiments.sentiment_by_source(_sentiments(t))


@query(
    "jn7_lexicon_match",
    "SELECT tok AS token, count(*) AS n, any_value(p) % 10 AS positive, any_value(n) % 10 AS negative FROM tok_v JOIN tokcode_v USING (tok) GROUP BY tok",
)
def jn7(t):
    from topicloom.functions.sentiment import lexicon_weights

    tokens = t.posts(False, False).select(F.explode(text.sentiment_tokens(F.col("content"))).alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    return counts.withColumn("w", lexicon_weights(F.col("token"))).where("w IS NOT NULL").select(
        "token", "n", "w.positive", "w.negative"
    )


@query(
    "wn9_context_lookback",
    "SELECT post_id, pos, tok AS token, flipped AS negated, factor FROM around_v WHERE flipped OR factor = 2",
)
def wn9(t):
    from topicloom.functions.sentiment import token_contexts

    return t.posts(False, False).select("post_id", F.inline(token_contexts(F.col("content"))))


@query("wn10_scored_positions", "SELECT post_id, pos, tok AS token FROM visit_v JOIN tok_v USING (post_id, pos) WHERE off % 2 = 0")
def wn10(t):
    from topicloom.functions.sentiment import scored_positions

    return t.posts(False, False).select("post_id", F.inline(scored_positions(F.col("content"))))


# ---- terms -------------------------------------------------------------------


def _model(t: Tables) -> terms.TermModel:
    return terms.TermModel(t.posts(urls=False, engagement=False))


@query(
    "sc19_term_tokens",
    r"""SELECT tok AS token, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(
      regexp_extract_all(lower(content), '[\p{L}\p{M}\p{N}_\-]+'), lambda x: trim(x, '-')),
      lambda x: regexp_matches(x, '^[a-z][a-z0-9\-]{2,}$'))) AS tok FROM posts_v) GROUP BY 1""",
)
def sc19(t):
    tokens = t.posts(False, False).select(F.explode(text.term_tokens(F.col("content"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


@query(
    "sc20_word_counts",
    r"""SELECT post_id, len(regexp_extract_all(lower(content), '[a-z0-9\-]+')) AS words,
      len(regexp_extract_all(lower(content), '[a-z][a-z0-9\-'']*')) AS sentiment_tokens FROM posts_v""",
)
def sc20(t):
    c = F.col("content")
    return t.posts(False, False).select(
        "post_id",
        F.size(text.counted_words(c)).alias("words"),
        F.size(text.sentiment_tokens(c)).alias("sentiment_tokens"),
    )


@query("ag1_vocabulary", "SELECT topic, term, total FROM vocab_v")
def ag1(t):
    return terms.vocabulary(t.posts(False, False)).drop("idx")


@query("ag2_term_weights", "SELECT topic, post_id, term, tf, round(weight, 8) AS weight FROM weights_v WHERE tf > 0")
def ag2(t):
    counts = _model(t).weights().where("tf > 0")
    return counts.select("topic", "post_id", "term", "tf", F.round("weight", 8).alias("weight"))


@query("ag3_mean_weights", "SELECT topic, term, df, round(idf, 8) AS idf, round(mean_weight, 8) AS mean_weight FROM scored_v")
def ag3(t):
    m = _model(t)
    means = terms.mean_weights(m.documents, m.statistics)
    return means.select("topic", "term", "df", F.round("idf", 8).alias("idf"), F.round("mean_weight", 8).alias("mean_weight"))


@query("ag4_keyword_scores", "SELECT topic, term, frequency, round(combined, 6) AS combined FROM scored_v")
def ag4(t):
    m = _model(t)
    return terms.score_keywords(m.documents, m.statistics).select(
        "topic", "term", "frequency", F.round("combined", 6).alias("combined")
    )


@query("tk1_top_keywords", "SELECT topic, rank, keyword, tfidf_score, frequency, score FROM keywords_v")
def tk1(t):
    return _model(t).keywords()


@query("tk2_document_keywords", "SELECT topic, post_id, array_to_string(keywords, ', ') AS keywords FROM dockw_v")
def tk2(t):
    d = _model(t).document_keywords()
    return d.where(F.size("keywords") > 0).withColumn("keywords", F.concat_ws(", ", "keywords"))


@query("jn9_literal_counts", "SELECT topic, post_id, term, literal FROM counts_v WHERE literal > 0")
def jn9(t):
    posts = t.posts(False, False)
    vocab = stage(terms.vocabulary(posts), "vocabulary")
    counts = terms.document_counts(posts, vocab).select("topic", "post_id", F.inline("items"))
    return counts.where("literal > 0").join(vocab, ["topic", "idx"]).select("topic", "post_id", "term", "literal")


@query(
    "sc21_low_signal",
    "SELECT topic, term, low AS low_signal FROM vocab_v JOIN lowsignal_v USING (term)",
)
def sc21(t):
    v = terms.vocabulary(t.posts(False, False))
    return v.select("topic", "term", labels.is_low_signal("term").alias("low_signal"))


@query(
    "fl11_keyword_candidates",
    "SELECT topic, term, frequency FROM scored_v JOIN lowsignal_v USING (term) WHERE NOT low AND frequency > 0",
)
def fl11(t):
    stats = _model(t).statistics
    return stats.where(~labels.is_low_signal("term") & (F.col("frequency") > 0)).select("topic", "term", "frequency")


# ---- engagement --------------------------------------------------------------


@query("sc9_total_engagement", "SELECT post_id, likes + comments + shares AS total FROM posts_v")
def sc9(t):
    total = scoring.total_engagement(F.col("likes"), F.col("comments"), F.col("shares"))
    return t.posts(urls=False).select("post_id", total.alias("total"))


@query(
    "sc10_baseline_engagement",
    "SELECT post_id, least((likes + comments + shares) / 10.0::DOUBLE, 100.0::DOUBLE) AS baseline FROM posts_v",
)
def sc10(t):
    total = scoring.total_engagement(F.col("likes"), F.col("comments"), F.col("shares"))
    return t.posts(urls=False).select("post_id", scoring.baseline_engagement(F.lit(None).cast("double"), total).alias("baseline"))


@query("sc11_source_types", "SELECT post_id, kind AS source_type, source_weight FROM kind_v")
def sc11(t):
    kind = scoring.source_type(F.col("source"), F.col("url"))
    return t.posts(engagement=False).select(
        "post_id", kind.alias("source_type"), scoring.source_weight(kind).alias("source_weight")
    )


@query("jn8_keyword_occurrences", "SELECT topic, post_id, keyword, CAST(hits AS BIGINT) AS hits, important FROM hits_v")
def jn8(t):
    posts = t.posts(False, False)
    lists = engagement.keyword_lists(_model(t).keywords())
    hits = engagement.keyword_hits(F.col("content"), F.col("topic_keywords"))
    return posts.join(lists, "topic").select("topic", "post_id", F.inline(hits)).select(
        "topic", "post_id", "keyword", "hits", "important"
    )


@query("ag5_text_engagement", "SELECT topic, post_id, round(text_score, 6) AS text_score FROM textscore_v")
def ag5(t):
    lists = engagement.keyword_lists(_model(t).keywords())
    score = engagement.text_engagement(F.col("content"), F.col("topic_keywords"))
    return t.posts(False, False).join(lists, "topic").select("topic", "post_id", F.round(score, 6).alias("text_score"))


@query("ag6_post_scores", "SELECT topic, post_id, engagement_score FROM postscore_v")
def ag6(t):
    return engagement.score_posts(t.posts(), _model(t).keywords())


GATED = "postscore_v WHERE engagement_score >= 5.0 OR (source = 'linkedin' AND likes + comments + shares > 0)"


@query("fl5_engagement_gate", f"SELECT topic, post_id, source, engagement_score FROM {GATED}")
def fl5(t):
    posts = t.posts()
    scores = engagement.score_posts(posts, _model(t).keywords())
    slim = posts.select("topic", "post_id", "source", "likes", "comments", "shares")
    return engagement.gate_posts(slim, scores).select("topic", "post_id", "source", "engagement_score")


# ---- trends ------------------------------------------------------------------


@query("sc22_clean_labels", f"SELECT topic, term, array_to_string({label_tokens('term')}, ' ') AS label FROM vocab_v")
def sc22(t):
    v = terms.vocabulary(t.posts(False, False))
    return v.select("topic", "term", labels.clean_label("term").alias("label"))


@query("sc23_cluster_labels", "SELECT topic, cluster, label FROM clustertrend_v")
def sc23(t):
    k = _cluster_keywords(t)
    lists = k.groupBy("topic", "cluster").agg(ordered_list(F.col("rank"), F.col("term")).alias("keywords"))
    return lists.select("topic", "cluster", labels.cluster_label("keywords").alias("label"))


def _cluster_keywords(t: Tables):
    m = _model(t)
    by_source = m.posts.select("topic", "post_id", F.col("source").alias("cluster"))
    return trends.cluster_keywords(trends.cluster_terms(m.documents, by_source))


@query("tk3_cluster_keywords", "SELECT topic, cluster, rank, term, round(mean_weight, 8) AS mean_weight, frequency FROM clusterkw_v")
def tk3(t):
    return _cluster_keywords(t).select(
        "topic", "cluster", "rank", "term", F.round("mean_weight", 8).alias("mean_weight"), "frequency"
    )


@query(
    "ag15_cluster_trends",
    "SELECT topic, cluster, label, array_to_string(keywords, ', ') AS keywords, score FROM clustertrend_v",
)
def ag15(t):
    k = trends.cluster_trends(_cluster_keywords(t))
    return k.select("topic", "cluster", "label", F.concat_ws(", ", "keywords").alias("keywords"), "score")


@query("tk4_ranked_trends", "SELECT topic, trend_rank, cluster, label FROM clustertrend_v WHERE trend_rank <= 12")
def tk4(t):
    ranked = trends.rank_trends(trends.cluster_trends(_cluster_keywords(t)))
    return ranked.select("topic", "trend_rank", "cluster", "label")


@query(
    "tk5_top_keywords_of_trends",
    """SELECT topic, rank, keyword FROM (
      SELECT topic, keyword, row_number() OVER (PARTITION BY topic ORDER BY place) AS rank FROM (
        SELECT topic, keyword, min(trend_rank * 1000 + pos) AS place FROM (
          SELECT topic, trend_rank, unnest(keywords) AS keyword, generate_subscripts(keywords, 1) AS pos FROM clustertrend_v) u
        GROUP BY 1, 2) g) r WHERE rank <= 10""",
)
def tk5(t):
    return trends.top_keywords(trends.rank_trends(trends.cluster_trends(_cluster_keywords(t))))

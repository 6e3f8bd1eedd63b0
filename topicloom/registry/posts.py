"""Text functions, validation, filters, de-duplication, explore and nested results."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import scoring, text
from topicloom.functions.chunking import chunk_rows
from topicloom.operators import explore, reports, validation
from topicloom.operators.sentiments import with_sentiment
from topicloom.registry.base import query
from topicloom.session import stage

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def as_of():
    return F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))


_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(12288)"


def strip_sql(x: str) -> str:
    return f"trim({x}, {_WS})"


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# ---- text --------------------------------------------------------------------


@query(
    "sc1_previews",
    """SELECT post_id, CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END AS preview,
      CASE WHEN length(content) > 240 THEN substring(content, 1, 240) || '...' ELSE content END AS result_preview,
      substring(content, 1, 100) AS summary_preview,
      CASE WHEN length(content) > 1990 THEN substring(content, 1, 1987) || '...' ELSE content END AS block FROM posts_v""",
)
def sc1(t):
    c = F.col("content")
    return t.posts(False, False).select(
        "post_id",
        text.preview(c).alias("preview"),
        text.preview(c, 240).alias("result_preview"),
        text.preview(c, 100, ellipsis=False).alias("summary_preview"),
        text.block_text(c).alias("block"),
    )


@query("sc2_content_cap", "SELECT post_id, substring(content, 1, 2000) AS content FROM posts_v")
def sc2(t):
    return t.posts(False, False).select("post_id", text.cap_content(F.col("content")).alias("content"))


@query("sc14_content_hashes", "SELECT post_id, sha256(content) AS content_hash, sha256(content || url) AS record_hash FROM posts_v")
def sc14(t):
    return t.posts(engagement=False).select(
        "post_id",
        text.content_hash(F.col("content")).alias("content_hash"),
        text.content_hash(F.col("content"), F.col("url")).alias("record_hash"),
    )


@query(
    "sc26_chunks",
    r"""WITH RECURSIVE c AS (
      SELECT post_id, 0 AS n, content AS rest, NULL::VARCHAR AS piece, FALSE AS done FROM posts_v
      UNION ALL
      SELECT post_id, n + 1,
        CASE WHEN length(rest) <= 1990 THEN '' ELSE """ + strip_sql("substring(rest, cut + 1)") + r""" END,
        CASE WHEN length(rest) <= 1990 THEN rest ELSE """ + strip_sql("substring(rest, 1, cut)") + r""" END,
        length(rest) <= 1990
      FROM (SELECT *, CASE WHEN contains(substring(rest, 1, 1990), '. ')
              THEN 1990 - position(' .' IN reverse(substring(rest, 1, 1990))) ELSE 1990 END AS cut
            FROM c WHERE NOT done) s)
    SELECT post_id, n AS chunk, piece FROM c WHERE n > 0 AND (n = 1 OR piece <> '')""",
)
def sc26(t):
    found = chunk_rows(t.posts(False, False), "post_id", "content")
    return found.select("post_id", F.col("chunk").cast("int").alias("chunk"), "piece")


@query(
    "sc27_breakdown",
    """SELECT post_id, CAST(round_even(likes * 100.0::DOUBLE / m, 0) AS BIGINT) AS likes_pct,
      CAST(round_even(comments * 100.0::DOUBLE / m, 0) AS BIGINT) AS comments_pct,
      CAST(round_even(shares * 100.0::DOUBLE / m, 0) AS BIGINT) AS shares_pct
    FROM (SELECT *, greatest(likes, comments, shares, 1) AS m FROM posts_v) p""",
)
def sc27(t):
    parts = scoring.shares_of_largest(F.col("likes"), F.col("comments"), F.col("shares"))
    return t.posts(urls=False).select("post_id", *parts)


# ---- validation and filters --------------------------------------------------

# Some records lose their content or URL, so that every rejection occurs.
DAMAGED = """(SELECT post_id, source, topic, likes, comments, shares,
  CASE WHEN post_id % 13 = 0 THEN ' ' || chr(10) WHEN post_id % 29 = 0 THEN NULL ELSE content END AS content,
  CASE WHEN post_id % 11 = 0 THEN '' WHEN post_id % 31 = 0 THEN NULL ELSE url END AS url FROM posts_v) d"""


def damaged(t, engagement: bool = True):
    i = F.col("post_id")
    content = F.when(i % 13 == 0, " \n").when(i % 29 == 0, None).otherwise(F.col("content"))
    url = F.when(i % 11 == 0, "").when(i % 31 == 0, None).otherwise(F.col("url"))
    return t.posts(engagement=engagement).withColumn("content", content).withColumn("url", url)


_BLANK = strip_sql("coalesce(content, '')") + " = ''"
_NO_URL = strip_sql("coalesce(url, '')") + " = ''"


@query("fl1_blank_content", f"SELECT post_id, 'empty content' AS reason FROM {DAMAGED} WHERE {_BLANK}")
def fl1(t):
    return validation.rejected_posts(damaged(t, False)).where("reason = 'empty content'").select("post_id", "reason")


@query("fl2_missing_url", f"SELECT post_id, 'missing url' AS reason FROM {DAMAGED} WHERE NOT ({_BLANK}) AND {_NO_URL}")
def fl2(t):
    return validation.rejected_posts(damaged(t, False)).where("reason = 'missing url'").select("post_id", "reason")


@query("fl3_minimum_length", "SELECT post_id, length(" + strip_sql("content") + ") AS chars FROM posts_v WHERE length(" + strip_sql("content") + ") >= 20")
def fl3(t):
    chars = F.length(text.strip(F.col("content")))
    return t.posts(False, False).select("post_id", chars.alias("chars")).where("chars >= 20")


@query(
    "fl4_timeline_cutoff",
    "\nUNION ALL ".join(
        f"SELECT '{name}' AS timeline, event_id FROM events WHERE ts >= {AS_OF} - INTERVAL {hours} HOURS"
        for name, hours in [*scoring.TIMELINES.items(), ("other", 720)]
    ),
)
def fl4(t):
    from topicloom.operators.collect import since

    rows = t.read("events").select("event_id", F.col("ts").alias("collected_at"))
    union = None
    for name in [*scoring.TIMELINES, "other"]:
        part = since(rows, name, as_of()).select(F.lit(name).alias("timeline"), "event_id")
        union = part if union is None else union.unionByName(part)
    return union


@query(
    "wn3_deduplicate",
    f"""SELECT post_id, sha256(c || u) AS content_hash, engagement_score FROM (
      SELECT *, row_number() OVER (PARTITION BY sha256(c || u) ORDER BY post_id) AS r,
        least((likes + comments + shares) / 10.0::DOUBLE, 100.0::DOUBLE) AS engagement_score
      FROM (SELECT *, {strip_sql('content')} AS c, {strip_sql('url')} AS u FROM {DAMAGED}
            WHERE NOT ({_BLANK}) AND NOT ({_NO_URL})) v) q WHERE r = 1""",
)
def wn3(t):
    return validation.validate_posts(damaged(t), "post_id").select("post_id", "content_hash", "engagement_score")


@query(
    "wn3_deduplicate_per_query",
    """SELECT post_id, query FROM (SELECT post_id, query,
      row_number() OVER (PARTITION BY query, sha256(content) ORDER BY post_id) AS r FROM posts_v) q WHERE r = 1""",
)
def wn3_query(t):
    posts = t.posts(False, False).select("post_id", "query", "content")
    return validation.deduplicate(posts, ["content"], "post_id", within=["query"]).select("post_id", "query")


# ---- explore -----------------------------------------------------------------


@query("fl6_source_and_sentiment", "SELECT post_id, source, label FROM posts_v JOIN sentiment_v USING (post_id) WHERE source = 'linkedin' AND label = 'positive'")
def fl6(t):
    hits = explore.by_sentiment(with_sentiment(explore.by_source(t.posts(False, False), "linkedin")), "positive")
    return hits.select("post_id", "source", "sentiment.label")


@query(
    "fl7_date_range",
    f"SELECT post_id, strftime(collected_at, '%Y-%m-%d %H:%M:%S') AS collected_at FROM posts_v WHERE coalesce(collected_at, TIMESTAMP '1970-01-01') >= {AS_OF} - INTERVAL 7 DAYS",
)
def fl7(t):
    hits = explore.by_date_range(t.posts(urls=False), "7d", as_of())
    return hits.select("post_id", stamp("collected_at").alias("collected_at"))


@query("fl8_minimum_likes", "SELECT post_id, source, likes FROM posts_v WHERE source <> 'linkedin' OR likes >= 10")
def fl8(t):
    return explore.by_likes(t.posts(urls=False), 10).select("post_id", "source", "likes")


@query(
    "tk9_explore_sort",
    """SELECT 'relevance' AS sort, post_id, row_number() OVER (ORDER BY post_id) AS position FROM posts_v
    UNION ALL SELECT 'date', post_id, row_number() OVER (ORDER BY collected_at DESC NULLS LAST, post_id) FROM posts_v
    UNION ALL SELECT 'sentiment', post_id, row_number() OVER (ORDER BY coalesce(score, 0.0) DESC, post_id) FROM posts_v LEFT JOIN sentiment_v USING (post_id)""",
)
def tk9(t):
    """The place of every row in each of the three orders."""
    scored = stage(with_sentiment(t.posts(urls=False)).select("post_id", "collected_at", "sentiment"), "scored")
    union = None
    for order in ("relevance", "date", "sentiment"):
        rows = explore.ranked_results(scored, order, "post_id").select(F.lit(order).alias("sort"), "post_id", "position")
        union = rows if union is None else union.unionByName(rows)
    return union


QUERIES_SQL = "(SELECT i AS ord, 'q' || i AS query FROM range(7) r(i)) qs"


def _queries(t):
    """The query list: those the posts carry, and two that found nothing."""
    return t.spark.range(7).select(F.col("id").alias("ord"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("query"))


@query("ag13_results_per_query", f"SELECT query, count(post_id) AS results FROM {QUERIES_SQL} LEFT JOIN posts_v USING (query) GROUP BY 1")
def ag13(t):
    return explore.results_per_query(_queries(t), t.posts(False, False)).select("query", "results")


@query("ag13_documents_per_topic", "SELECT topic, count(*) AS sources_analysed FROM posts_v GROUP BY 1")
def ag13_topics(t):
    return t.posts(False, False).groupBy("topic").agg(F.count("*").alias("sources_analysed"))


@query(
    "snk4_nested_results",
    f"""SELECT query, coalesce(page, 0) AS page, count(post_id) AS n,
      coalesce(string_agg(source || '|' || url || '|' || preview || '|' || label || '|' || likes, chr(10) ORDER BY post_id), '') AS results
    FROM {QUERIES_SQL} LEFT JOIN (SELECT p.*, s.label, p.post_id // 1000 AS page,
      CASE WHEN length(content) > 240 THEN substring(content, 1, 240) || '...' ELSE content END AS preview
      FROM posts_v p JOIN sentiment_v s USING (post_id)) x USING (query) GROUP BY 1, 2""",
)
def snk4(t):
    nested = reports.nested_results(_queries(t), with_sentiment(t.posts()))
    line = F.transform(
        "results",
        lambda r: F.concat_ws(
            "|", r["source"], r["url"], r["content_preview"], r["sentiment"]["label"], r["metadata"]["likes"].cast("string")
        ),
    )
    return nested.select("query", "page", F.size("results").alias("n"), F.concat_ws("\n", line).alias("results"))


@query(
    "cq5_explore",
    f"""SELECT post_id, source, label, strftime(collected_at, '%Y-%m-%d %H:%M:%S') AS collected_at FROM posts_v JOIN sentiment_v USING (post_id)
    WHERE label = 'neutral' AND collected_at >= {AS_OF} - INTERVAL 30 DAYS AND (source <> 'linkedin' OR likes >= 10)""",
)
def cq5(t):
    hits = explore.explore(
        with_sentiment(t.posts(urls=False)), as_of(), "post_id", show="neutral", date_range="30d", likes=10, order="date"
    )
    return hits.select("post_id", "source", "sentiment.label", stamp("collected_at").alias("collected_at"))

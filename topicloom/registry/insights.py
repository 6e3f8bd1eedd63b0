"""Similarity, confidence, insights and the structured summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.operators import engagement, insights, similarity, terms, trends
from topicloom.operators.ranking import ordered_list
from topicloom.registry.base import query
from topicloom.registry.sqltext import block
from topicloom.session import stage

# Documents here are all posts with their score and keywords; clusters are their sources.

block("doc_v", """
SELECT p.topic, p.post_id, p.source, p.content, s.engagement_score, coalesce(k.keywords, []) AS keywords
FROM posts_v p JOIN postscore_v s USING (post_id) LEFT JOIN dockw_v k USING (post_id)""")
block("top3_v", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY engagement_score DESC, post_id) AS rank FROM doc_v) q WHERE rank <= 3""")
block("jac_v", """
SELECT topic, sets, CASE WHEN sets < 2 THEN 0.0 ELSE coalesce(s, 0.0) / (sets * (sets - 1) / 2.0) END AS consistency FROM (
  SELECT topic, count(*) AS sets FROM dockw_v WHERE len(keywords) > 0 GROUP BY 1) n LEFT JOIN (
  SELECT topic, sum(i / (la + lb - i)) AS s FROM (
    SELECT a.topic, len(list_intersect(a.keywords, b.keywords)) AS i, CAST(len(a.keywords) AS DOUBLE) AS la, len(b.keywords) AS lb
    FROM dockw_v a JOIN dockw_v b ON a.topic = b.topic AND a.post_id < b.post_id) p GROUP BY 1) t USING (topic)""")
block("support_v", """
SELECT t.topic, t.trend_rank, t.label, t.score, t.keywords, arg_min(d.post_id, d.rank) AS post_id, arg_min(d.engagement_score, d.rank) AS engagement_score,
  arg_min(d.keywords, d.rank) AS doc_keywords
FROM clustertrend_v t LEFT JOIN top3_v d ON d.topic = t.topic AND list_has_any(d.keywords, t.keywords)
GROUP BY t.topic, t.trend_rank, t.label, t.score, t.keywords""")
block("confidence_v", """
SELECT topic, n_docs, round(least(greatest(0.35 * least(n_docs / 12.0::DOUBLE, 1.0) + 0.3 * consistency + 0.35 * least(strength / 9.0, 1.0), 0.0), 1.0), 2) AS confidence
FROM sizes_v JOIN jac_v USING (topic) JOIN (SELECT topic, sum(score) AS strength FROM clustertrend_v WHERE trend_rank <= 3 GROUP BY 1) s USING (topic)""")


def _fmt(template: str, *values: str) -> str:
    """The template as a SQL expression."""
    parts = template.replace("%d", "%s").split("%s")
    sql = "'" + parts[0].replace("'", "''") + "'"
    for value, text in zip(values, parts[1:]):
        sql += f" || {value} || '" + text.replace("'", "''") + "'"
    return sql


def _dec(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(18, 6)), 2) AS DECIMAL(18, 2))"


def _three(x: str) -> str:
    return f"array_to_string(list_slice({x}, 1, 3), ', ')"


T = insights.TEXTS
block("lines_of_trend_v", f"""
SELECT topic, trend_rank, label || ' (' || {_dec('score')} || ')' AS named,
  CASE WHEN post_id IS NOT NULL THEN {_fmt(T['supported'], 'label', _dec('score'), _dec('engagement_score'), _three('doc_keywords'))}
    ELSE {_fmt(T['unsupported'], 'label', _dec('score'), _three('keywords'))} END AS takeaway,
  {_fmt(T['opportunity'], 'label', _dec('score'), _three('keywords'))} AS opportunity
FROM support_v WHERE trend_rank <= 3""")
block("insight_v", f"""
SELECT topic, {_fmt(T['summary'], 'any_value(n_docs)', 'topic', "string_agg(named, ', ' ORDER BY trend_rank)")} AS summary,
  array_to_string(list_slice(list_concat(list(takeaway ORDER BY trend_rank), ['{T['few_takeaways']}', '{T['few_takeaways']}', '{T['few_takeaways']}', '{T['few_takeaways']}']), 1, 4), chr(10)) AS key_takeaways,
  array_to_string(list_slice(list_concat(list(opportunity ORDER BY trend_rank), ['{T['few_opportunities']}', '{T['few_opportunities']}', '{T['few_opportunities']}']), 1, 3), chr(10)) AS opportunities,
  any_value(confidence) AS confidence
FROM lines_of_trend_v JOIN confidence_v USING (topic) GROUP BY topic""")


class Parts:
    """Documents and by-source trends of all posts."""

    def __init__(self, t):
        # read by every part; staged, so that the texts are joined with their pages and events once
        self.posts = stage(t.posts(), "posts")
        self.model = terms.TermModel(self.posts.select("topic", "post_id", "content", "source"))

    def trends(self):
        by_source = self.posts.select("topic", "post_id", F.col("source").alias("cluster"))
        return trends.trends_of(self.model.documents, by_source)

    def documents(self):
        scores = engagement.score_posts(self.posts, self.model.keywords())
        rows = self.posts.select("topic", "post_id", "source", F.substring("content", 1, 200).alias("content_preview"))
        empty = F.array().cast("array<string>")
        return (
            rows.join(scores, ["topic", "post_id"])
            .join(self.model.document_keywords(), ["topic", "post_id"], "left")
            .withColumn("keywords", F.coalesce("keywords", empty))
        )

    def topics(self, documents, fields):
        return (
            self.model.sizes.join(trends.trend_lists(self.trends()), "topic")
            .join(insights.top_documents(documents, fields), "topic")
        )


@query("jn5_consistency", "SELECT topic, sets, round(consistency, 8) AS consistency FROM jac_v")
def jn5(t):
    docs = terms.TermModel(t.posts(False, False)).document_keywords()
    return similarity.consistency(docs).select("topic", "sets", F.round("consistency", 8).alias("consistency"))


@query("tk7_top_documents", "SELECT topic, rank, post_id, engagement_score FROM top3_v")
def tk7(t):
    p = Parts(t)
    scores = engagement.score_posts(p.posts, p.model.keywords())
    top = insights.top_documents(scores, ["post_id", "engagement_score"])
    rows = top.select("topic", F.posexplode("top_docs").alias("pos", "d"))
    return rows.select("topic", (F.col("pos") + 1).alias("rank"), "d.post_id", "d.engagement_score")


@query("jn6_supporting_document", "SELECT topic, trend_rank, label, post_id FROM support_v")
def jn6(t):
    p = Parts(t)
    rows = p.topics(p.documents(), ["post_id", "engagement_score", "keywords"])
    found = rows.select("topic", "top_docs", F.posexplode("trends").alias("pos", "trend"))
    return found.select(
        "topic",
        (F.col("pos") + 1).alias("trend_rank"),
        "trend.label",
        insights.supporting_document(F.col("trend"), F.col("top_docs"))["post_id"].alias("post_id"),
    )


@query("ag16_confidence", "SELECT topic, n_docs, confidence FROM confidence_v")
def ag16(t):
    p = Parts(t)
    rows = (
        p.model.sizes.join(trends.trend_lists(p.trends()), "topic")
        .join(similarity.consistency(p.model.document_keywords()), "topic")
    )
    value = insights.confidence(F.col("n_docs"), F.col("consistency"), F.col("trends"))
    return rows.select("topic", "n_docs", value.alias("confidence"))


@query("ag20_rule_insights", "SELECT topic, summary, key_takeaways, opportunities, confidence FROM insight_v")
def ag20(t):
    p = Parts(t)
    documents = p.documents()
    rows = p.topics(documents, ["post_id", "engagement_score", "keywords"]).join(
        similarity.consistency(p.model.document_keywords()), "topic"
    )
    value = insights.confidence(F.col("n_docs"), F.col("consistency"), F.col("trends"))
    out = insights.rule_insights(rows.withColumn("confidence", value))
    return out.withColumn("key_takeaways", F.concat_ws("\n", "key_takeaways")).withColumn(
        "opportunities", F.concat_ws("\n", "opportunities")
    )


@query(
    "sc29_structured_summary",
    """SELECT topic, n_docs AS total_sources, kw AS top_keywords, tr AS trends, docs AS top_docs FROM sizes_v
    JOIN (SELECT topic, string_agg(keyword, ', ' ORDER BY place) AS kw FROM (
        SELECT *, row_number() OVER (PARTITION BY topic ORDER BY place) AS r FROM (SELECT topic, keyword, min(trend_rank * 1000 + pos) AS place FROM (
          SELECT topic, trend_rank, unnest(keywords) AS keyword, generate_subscripts(keywords, 1) AS pos FROM clustertrend_v) u GROUP BY 1, 2) g) q WHERE r <= 8 GROUP BY 1) k USING (topic)
    JOIN (SELECT topic, string_agg(label || ':' || array_to_string(list_slice(keywords, 1, 4), '/') || ':' || CAST(round(CAST(score AS DECIMAL(18, 6)), 3) AS DECIMAL(18, 3)), '; ' ORDER BY trend_rank) AS tr
      FROM clustertrend_v WHERE trend_rank <= 6 GROUP BY 1) t USING (topic)
    JOIN (SELECT topic, string_agg(source || ':' || printf('%.2f', engagement_score) || ':' || substring(content, 1, 100), '; ' ORDER BY rank) AS docs FROM top3_v GROUP BY 1) d USING (topic)""",
)
def sc29(t):
    p = Parts(t)
    top = trends.top_keywords(p.trends()).groupBy("topic").agg(ordered_list(F.col("rank"), F.col("keyword")).alias("top_keywords"))
    rows = p.topics(p.documents(), ["source", "engagement_score", "content_preview"]).join(top, "topic")
    out = insights.structured_summary(rows)
    trend_text = F.transform(
        "trends", lambda x: F.concat_ws(":", x["label"], F.concat_ws("/", x["keywords"]), F.format_string("%.3f", x["score"]))
    )
    doc_text = F.transform(
        "top_docs", lambda d: F.concat_ws(":", d["source"], F.format_string("%.2f", d["engagement"]), d["preview"])
    )
    return out.select(
        "topic",
        "total_sources",
        F.concat_ws(", ", "top_keywords").alias("top_keywords"),
        F.concat_ws("; ", trend_text).alias("trends"),
        F.concat_ws("; ", doc_text).alias("top_docs"),
    )

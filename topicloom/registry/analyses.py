"""Clustering and the end-to-end analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import text
from topicloom.functions import wordlists as w
from topicloom.functions.lenient import expand_topic
from topicloom.operators import cluster, terms, trends
from topicloom.operators.history import latest_trends
from topicloom.operators.ranking import ordered_list
from topicloom.operators.collect import expand_queries
from topicloom.plans import analysis, answers
from topicloom.plans.collect import Collected, collect
from topicloom.operators.evolution import TREND_TYPE
from topicloom.registry.base import query
from topicloom.registry import history as _history, insights as _insights  # noqa: F401  (their SQL blocks)
from topicloom.registry.posts import as_of, strip_sql
from topicloom.registry.sqltext import BLOCKS, block, two_pass
from topicloom.session import stage



def _blocks(t):
    posts = t.posts(urls=False, engagement=False)
    m = terms.TermModel(posts)
    return posts, m, stage(cluster.blocks_of(posts, m.documents, m.sizes), "blocks")


@query("ml1_kmeans")
def ml1(t):
    """Members, squared error and rank of every run: each restart of each k."""
    _, _, blocks = _blocks(t)
    width = cluster.width_of(blocks)
    totals = cluster._totals(blocks, cluster.fit(blocks, width), width)
    return totals.groupBy("topic", "run").agg(
        F.count("*").alias("clusters"), F.sum("n").alias("members"), F.round(F.sum("sse"), 6).alias("sse")
    )


def passes_sql(passes: int, k: int) -> str:
    """K-means from given centroids, pass by pass: nearest centroid of every document, then means of the members."""
    steps = [
        "w AS (SELECT topic, post_id, term, weight AS v FROM weights_v WHERE weight > 0)",
        "d AS (SELECT topic, post_id, coalesce(own, 0.0) AS own FROM posts_v LEFT JOIN (SELECT topic, post_id, sum(v * v) AS own FROM w GROUP BY 1, 2) o USING (topic, post_id))",
        f"""s AS (SELECT topic, post_id, r - 1 AS c FROM (SELECT topic, post_id, row_number() OVER (PARTITION BY topic ORDER BY post_id) AS r
          FROM (SELECT DISTINCT topic, post_id FROM w) x) y WHERE r <= {k})""",
        "k0 AS (SELECT topic, c FROM s)",
        "c0 AS (SELECT topic, c, term, v FROM s JOIN w USING (topic, post_id))",
    ]
    for i in range(passes + 1):
        steps.append(f"q{i} AS (SELECT topic, c, coalesce(sq, 0.0) AS sq FROM k0 LEFT JOIN (SELECT topic, c, sum(v * v) AS sq FROM c{i} GROUP BY 1, 2) x USING (topic, c))")
        steps.append(f"p{i} AS (SELECT w.topic, w.post_id, c.c, sum(w.v * c.v) AS dot FROM w JOIN c{i} c ON c.topic = w.topic AND c.term = w.term GROUP BY 1, 2, 3)")
        steps.append(f"""a{i} AS (SELECT * FROM (SELECT d.topic, d.post_id, q.c, d.own + q.sq - 2 * coalesce(p.dot, 0.0) AS gap,
          row_number() OVER (PARTITION BY d.topic, d.post_id ORDER BY round(q.sq - 2 * coalesce(p.dot, 0.0), 10), q.c) AS r
          FROM d JOIN q{i} q ON q.topic = d.topic LEFT JOIN p{i} p ON p.topic = d.topic AND p.post_id = d.post_id AND p.c = q.c) x WHERE r = 1)""")
        steps.append(f"n{i} AS (SELECT topic, c, count(*) AS n FROM a{i} GROUP BY 1, 2)")
        steps.append(f"""c{i + 1} AS (SELECT a.topic, a.c, w.term, sum(w.v) / min(n.n) AS v FROM a{i} a JOIN w ON w.topic = a.topic AND w.post_id = a.post_id
          JOIN n{i} n ON n.topic = a.topic AND n.c = a.c GROUP BY 1, 2, 3
          UNION ALL SELECT topic, c, term, v FROM c{i} WHERE NOT EXISTS (SELECT 1 FROM n{i} n WHERE n.topic = c{i}.topic AND n.c = c{i}.c))""")
    return ", ".join(f"{x.strip()}" for x in steps)


GIVEN_K, GIVEN_PASSES = 4, 3
GIVEN_SQL = f"""SELECT * FROM (WITH {passes_sql(GIVEN_PASSES, GIVEN_K)}
SELECT topic, CAST(c AS INTEGER) AS c, count(*) AS members, round(sum(greatest(gap, 0.0)), 6) AS sse FROM a{GIVEN_PASSES} GROUP BY 1, 2) g"""


@query("ml1_given_centroids", GIVEN_SQL)
def ml1_given(t):
    """Three passes of k-means from the first four documents of each topic: members and squared error per cluster."""
    _, m, blocks = _blocks(t)
    width = cluster.width_of(blocks)
    start = cluster.given_centroids(m.documents, width, GIVEN_K)
    model = cluster.fit(blocks, width, max_iterations=GIVEN_PASSES, tolerance=-1.0, start=start)
    totals = cluster._totals(blocks, model, width)
    return totals.select("topic", "c", F.col("n").alias("members"), F.round("sse", 6).alias("sse"))


@query("ml2_choose_k")
def ml2(t):
    _, _, blocks = _blocks(t)
    scores = stage(cluster.silhouettes(cluster.labelled(blocks)), "silhouettes")
    best = cluster.choose_k(scores).withColumn("chosen", F.lit(True))
    return scores.join(best, ["topic", "k"], "left").select(
        "topic", "k", F.round("silhouette", 6).alias("silhouette"), F.coalesce("chosen", F.lit(False)).alias("chosen")
    )


# Topics of one to a few documents: the language and the length to the nearest 50.
FINE_POSTS = """
SELECT doc_id AS post_id, lang || '-' || (length(text) // 50) AS topic, 'x' AS source, text AS content FROM documents"""


@query(
    "ml3_single_document_trends",
    """SELECT t.topic, post_id, label, array_to_string(keywords, ', ') AS keywords, score
    FROM clustertrend_v t JOIN (SELECT topic, min(post_id) AS post_id FROM posts_v GROUP BY 1 HAVING count(*) = 1) o ON o.topic = t.topic""",
    blocks={"posts_v": FINE_POSTS},
)
def ml3(t):
    topic = F.concat("topic", F.lit("-"), F.floor(F.length("content") / 50).cast("string"))
    posts = t.posts(False, False).withColumn("topic", topic).select("topic", "post_id", "content")
    m = terms.TermModel(posts)
    alone = stage(trends.single_cluster(posts, m.sizes), "alone")
    rows = trends.trends_of(m.documents, alone)
    return rows.join(alone.select("topic", "post_id"), "topic").select(
        "topic", "post_id", "label", F.concat_ws(", ", "keywords").alias("keywords"), "score"
    )


def _staged_posts(t):
    """The posts, whose texts are joined with their pages and events once for all that reads them."""
    return stage(t.posts(), "posts")


@query("ml4_process")
def ml4(t):
    """Documents and trends of the full processing, with k-means clusters."""
    p = analysis.process(_staged_posts(t))
    found = p.trends.groupBy("topic").agg(
        F.count("*").alias("trends"), ordered_list(F.col("trend_rank"), F.col("label")).alias("labels")
    )
    docs = p.documents.groupBy("topic").agg(F.count("*").alias("documents"))
    return docs.join(found, "topic", "left").select("topic", "documents", "trends", F.concat_ws("; ", "labels").alias("labels"))


DOCUMENTS_SQL = two_pass("""
SELECT p.topic, p.post_id, p.source, k.kind AS source_type, p.engagement_score, array_to_string(coalesce(d.keywords, []), ', ') AS keywords, s.label AS sentiment
FROM posts_v p JOIN kind_v k USING (post_id) JOIN sentiment_v s USING (post_id) LEFT JOIN dockw_v d USING (post_id)""")


@query("ml4_documents_by_source", DOCUMENTS_SQL)
def ml4_documents(t):
    """The documents of the full processing (clusters play no part in them)."""
    p = analysis.process(_staged_posts(t), analysis.column_clusters("source"))
    return p.documents.select(
        "topic", "post_id", "source", "source_type", "engagement_score", F.concat_ws(", ", "keywords").alias("keywords"),
        F.col("sentiment.label").alias("sentiment"),
    )


@query(
    "ml4_trends_by_source",
    two_pass("SELECT topic, trend_rank, cluster, label, array_to_string(keywords, ', ') AS keywords, score FROM clustertrend_v"),
)
def ml4_trends(t):
    """The trends of the full processing, with the posts' source as the cluster."""
    p = analysis.process(_staged_posts(t), analysis.column_clusters("source"))
    return p.trends.select("topic", "trend_rank", "cluster", "label", F.concat_ws(", ", "keywords").alias("keywords"), "score")


def _no_history(t):
    return t.spark.createDataFrame([], f"topic_key string, trends array<{TREND_TYPE}>")


@query("cq1_analyse")
def cq1(t):
    """The full analysis per topic, with k-means clusters."""
    return _flat(analysis.analyse(t.posts(), _no_history(t), as_of()))


VALIDATED = f"""SELECT * EXCLUDE (r) FROM (SELECT * REPLACE ({strip_sql('content')} AS content, coalesce(collected_at, TIMESTAMP '2024-01-31') AS collected_at),
  row_number() OVER (PARTITION BY sha256({strip_sql('content')} || url) ORDER BY post_id) AS r
  FROM ({BLOCKS['posts_v']}) a WHERE {strip_sql('content')} <> '') b WHERE r = 1"""

block("cq1opp_v", """
SELECT topic, string_agg(label || ':' || opportunity_score || ':' || reason, '; ' ORDER BY opportunity_score DESC, trend_rank) AS opportunity_scores FROM (
  SELECT *, CASE WHEN top > 0 THEN round(raw / top * 10.0, 2) ELSE 0.0 END AS opportunity_score,
    CASE WHEN u >= 1.1 THEN 'high growth + low competition' ELSE 'strong growth signal' END AS reason
  FROM (SELECT *, max(raw) OVER (PARTITION BY topic) AS top FROM (SELECT topic, label, trend_rank, u, score * 1.35 * u AS raw FROM (
    SELECT c.topic, c.label, c.trend_rank, c.score, greatest(0.6, 1.4 - coalesce(avg(len(list_intersect(c.keywords, o.keywords))
      / CAST(len(list_distinct(list_concat(c.keywords, o.keywords))) AS DOUBLE)), 0)) AS u
    FROM clustertrend_v c LEFT JOIN clustertrend_v o ON o.topic = c.topic AND o.label <> c.label GROUP BY 1, 2, 3, 4) a) b) d) e GROUP BY 1""")


def analysis_sql(evolution: str, opportunities: str) -> str:
    """One row per topic; the arguments give (topic, trend_evolution) and (topic, opportunity_scores)."""
    return f"""
SELECT topic, n_docs AS sources_analysed, top_keywords, trends, trend_evolution, opportunity_scores, summary, key_takeaways, confidence,
  CASE WHEN overall_score > 0.08 THEN 'positive' WHEN overall_score < -0.08 THEN 'negative' ELSE 'neutral' END AS overall_label, overall_score, sources
FROM sizes_v
JOIN (SELECT topic, string_agg(keyword, ', ' ORDER BY place) AS top_keywords FROM (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY place) AS r FROM (SELECT topic, keyword, min(trend_rank * 1000 + pos) AS place FROM (
      SELECT topic, trend_rank, unnest(keywords) AS keyword, generate_subscripts(keywords, 1) AS pos FROM clustertrend_v) u GROUP BY 1, 2) g) q WHERE r <= 10 GROUP BY 1) k USING (topic)
JOIN (SELECT topic, string_agg(label || ':' || score, '; ' ORDER BY trend_rank) AS trends FROM clustertrend_v GROUP BY 1) t USING (topic)
JOIN ({evolution}) e USING (topic)
JOIN ({opportunities}) o USING (topic) JOIN (SELECT topic, summary, key_takeaways, confidence FROM insight_v) i USING (topic)
JOIN (SELECT topic, round(CAST(sum(CAST(round(score * 1000) AS BIGINT)) AS DOUBLE) / count(*) / 1000, 3) AS overall_score, count(DISTINCT source) AS sources
  FROM posts_v JOIN sentiment_v USING (post_id) GROUP BY 1) s USING (topic)"""


CQ1_SQL = two_pass(
    analysis_sql("SELECT topic, string_agg(label || ':+100%:new', '; ' ORDER BY trend_rank) AS trend_evolution FROM clustertrend_v GROUP BY 1", "SELECT * FROM cq1opp_v"),
    VALIDATED,
)

# The analysis against trends that were found the same way on half of the posts.
WITH_HISTORY = analysis_sql(
    "SELECT topic, string_agg(label || ':' || change || ':' || status, '; ' ORDER BY trend_rank) AS trend_evolution FROM evolution_v GROUP BY 1",
    "SELECT topic, string_agg(label || ':' || opportunity_score || ':' || reason, '; ' ORDER BY opportunity_score DESC, trend_rank) AS opportunity_scores FROM opportunity_v GROUP BY 1",
)
HISTORY_BLOCKS = {
    "half_v": two_pass("SELECT topic, label, keywords, score, trend_rank FROM clustertrend_v", f"SELECT * FROM ({BLOCKS['posts_v']}) whole WHERE post_id % 2 = 0"),
    "trends_v": """SELECT topic, label, keywords, score, trend_rank, 1 AS snapshot FROM clustertrend_v
      UNION ALL SELECT topic, label, keywords, score, trend_rank, 0 AS snapshot FROM half_v""",
    # Trends of one topic may share a label here, so they are told apart by rank; growth is that of a label's last trend.
    "match_v": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic, trend_rank ORDER BY overlap DESC, p_rank) AS r FROM pair_v) q
      WHERE r = 1 AND overlap >= 0.2""",
    "evolution_v": BLOCKS["evolution_v"].replace("m.label = c.label", "m.trend_rank = c.trend_rank"),
    "unique_v": BLOCKS["unique_v"].replace("SELECT c.topic, c.label,", "SELECT c.topic, c.label, c.trend_rank,").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3"),
    "grown_v": """SELECT e.* REPLACE (g.status AS status, g.pct0 AS pct0) FROM evolution_v e
      JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic, label ORDER BY trend_rank DESC) AS r FROM evolution_v) x WHERE r = 1) g
      ON g.topic = e.topic AND g.label = e.label""",
    "opportunity_v": BLOCKS["opportunity_v"].replace("FROM evolution_v e JOIN unique_v u ON u.topic = e.topic AND u.label = e.label", "FROM grown_v e JOIN unique_v u ON u.topic = e.topic AND u.trend_rank = e.trend_rank"),
}


@query("cq1_analyse_by_source", CQ1_SQL)
def cq1_by_source(t):
    """The full analysis with the posts' source as the cluster."""
    return _flat(analysis.analyse(t.posts(), _no_history(t), as_of(), clustering=analysis.column_clusters("source")))


def stored_runs(t):
    """Runs whose trends were found on half of the posts, with their source as the cluster."""
    earlier = analysis.process(stage(t.posts().where("post_id % 2 = 0"), "posts"), analysis.column_clusters("source"))
    return trends.trend_lists(earlier.trends).select(F.lit(1).alias("id"), "topic", as_of().alias("captured_at"), "trends")


@query("cq1_analyse_with_history", two_pass(WITH_HISTORY, VALIDATED, HISTORY_BLOCKS))
def cq1_history(t):
    """As above, against stored runs whose trends were found the same way on half of the posts."""
    rows = analysis.analyse(t.posts(), latest_trends(stored_runs(t)), as_of(), clustering=analysis.column_clusters("source"))
    return _flat(rows)


def _requests(t):
    """Every language and every region; one language asks for a refresh. No post belongs to a region."""
    languages = t.read("documents").select(F.col("lang").alias("topic")).distinct()
    regions = t.read("region").select(F.trim("r_name").alias("topic"))
    return languages.unionByName(regions).where("topic IS NOT NULL").withColumn("refresh", F.col("topic") == "en")


def _inputs(t):
    """Requests, what was collected, and stored answers: fresh ones for two languages and every other region, old ones for the other regions."""
    requests = _requests(t)
    topics = requests.select("topic")
    numbers = t.read("region").select(F.trim("r_name").alias("topic"), "r_regionkey")
    age = F.when((F.col("r_regionkey") % 2 == 0) | F.col("topic").isin("de", "en"), F.expr("INTERVAL 1 HOUR")).when(
        F.col("r_regionkey") % 2 == 1, F.expr("INTERVAL 72 HOURS")
    )
    snapshots = topics.join(numbers, "topic", "left").select(
        F.lit(1).alias("id"),
        text.fingerprint(F.col("topic")).alias("key"),
        (as_of() - age).alias("captured_at"),
        F.to_json(F.struct("topic", F.lit(7).alias("sources_analysed"))).alias("result"),
    )
    queries = expand_queries(topics)
    place = (F.col("post_id") % 3).cast("int")  # the fourth query finds nothing
    groups = t.posts().withColumn("query", F.get(expand_topic(F.col("topic")), place))
    found = Collected(queries, t.posts(), groups, topics.limit(0))
    return requests, found, snapshots.where("captured_at IS NOT NULL")


def _answers(t):
    requests, found, snapshots = _inputs(t)
    clusters = analysis.column_clusters("source")
    return answers.write_answers(t.spark, lambda: answers.answer(requests, found, stored_runs(t), snapshots, as_of(), clustering=clusters))


REQUESTS_SQL = f"""(SELECT topic, coalesce(topic <> 'en' AND (topic = 'de' OR r_regionkey % 2 = 0), FALSE) AS cached, r_regionkey IS NOT NULL AS region FROM (
    SELECT DISTINCT lang AS topic, NULL AS r_regionkey FROM documents WHERE lang IS NOT NULL UNION ALL SELECT trim(r_name), r_regionkey FROM region) q) r"""
QUERY_LIST = " || '; ' || ".join(f"topic || ' {s}'" for s in w.QUERY_SUFFIXES)


@query(
    "cq1_answers",
    two_pass(
        f"""SELECT r.topic, cached, CASE WHEN region AND NOT cached THEN '{answers.NO_DATA}' END AS error, CASE WHEN NOT region AND NOT cached THEN 'broad' END AS query_type,
      CASE WHEN NOT region AND NOT cached THEN {QUERY_LIST.replace('topic', 'r.topic')} ELSE '' END AS queries, CASE WHEN cached THEN 7 ELSE sources_analysed END AS sources_analysed,
      CASE WHEN cached OR region THEN '' ELSE top_keywords END AS top_keywords, CASE WHEN cached OR region THEN '' ELSE trend_evolution END AS trend_evolution,
      CASE WHEN cached OR region THEN '' ELSE opportunity_scores END AS opportunity_scores, CASE WHEN NOT cached THEN summary END AS summary,
      CASE WHEN NOT cached THEN overall_score END AS overall_score, NOT cached AND NOT region AS stored
    FROM {REQUESTS_SQL} LEFT JOIN ({WITH_HISTORY}) a ON a.topic = r.topic""",
        VALIDATED,
        HISTORY_BLOCKS,
    ),
)
def cq1_answers(t):
    """Requests answered from the store or by analysis, with errors, and whether the answer reads back from the snapshots."""
    made = _answers(t)
    shape = made.answers.schema["answer"].dataType
    again = made.snapshots.join(made.answers.select("key", "topic", "answer"), "key").where(F.from_json("result", shape)["trends"] == F.col("answer.trends"))
    stored = made.runs.select("topic").join(again.select("topic"), "topic").withColumn("stored", F.lit(True))
    got = made.answers.join(stored, "topic", "left")

    def joined(column: str, *fields: str):
        return F.concat_ws("; ", F.transform(F.col("answer")[column], lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])))

    return got.select(
        "topic", "cached", "error", F.col("answer.query_intelligence.query_type").alias("query_type"),
        F.concat_ws("; ", "answer.queries").alias("queries"), "answer.sources_analysed", F.concat_ws(", ", "answer.top_keywords").alias("top_keywords"),
        joined("trend_evolution", "trend", "change", "status").alias("trend_evolution"),
        joined("opportunity_scores", "trend", "opportunity_score", "reason").alias("opportunity_scores"),
        F.col("answer.insights.summary").alias("summary"), F.col("answer.sentiment_summary.overall_score").alias("overall_score"),
        F.coalesce("stored", F.lit(False)).alias("stored"),
    )


@query(
    "cq1_query_results",
    f"""SELECT r.topic, ord, r.topic || ' ' || suffix AS query, rank, post_id AS arrival, source, url, preview AS content_preview, label AS sentiment, likes
    FROM {REQUESTS_SQL} CROSS JOIN (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(w.QUERY_SUFFIXES))}) s(ord, suffix)
    LEFT JOIN (SELECT p.*, s.label, p.post_id % 3 AS place, row_number() OVER (PARTITION BY topic, p.post_id % 3 ORDER BY p.post_id) AS rank,
      CASE WHEN length(content) > 240 THEN substring(content, 1, 240) || '...' ELSE content END AS preview
      FROM posts_v p JOIN sentiment_v s USING (post_id)) x ON x.topic = r.topic AND x.place = ord WHERE NOT cached""",
)
def cq1_query_results(t):
    """Results of every query of the topics that were analysed, ranked by arrival."""
    requests, found, snapshots = _inputs(t)
    todo = answers.open_requests(requests, snapshots, as_of()).where("result IS NULL").select("topic").distinct()
    return answers.query_results(found, todo).select(
        "topic", "ord", "query", F.col("rank").cast("bigint").alias("rank"), "arrival", "source", "url", "content_preview",
        F.col("sentiment.label").alias("sentiment"), F.col("metadata.likes").alias("likes"),
    )


def _flat(rows):
    def joined(column: str, *fields: str):
        return F.concat_ws("; ", F.transform(column, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])))

    return rows.select(
        "topic",
        "sources_analysed",
        F.concat_ws(", ", "top_keywords").alias("top_keywords"),
        joined("trends", "label", "score").alias("trends"),
        joined("trend_evolution", "trend", "change", "status").alias("trend_evolution"),
        joined("opportunity_scores", "trend", "opportunity_score", "reason").alias("opportunity_scores"),
        F.col("insights.summary").alias("summary"),
        F.concat_ws("\n", "insights.key_takeaways").alias("key_takeaways"),
        F.col("insights.confidence").alias("confidence"),
        F.col("sentiment_summary.overall_label").alias("overall_label"),
        F.col("sentiment_summary.overall_score").alias("overall_score"),
        F.size("by_source").alias("sources"),
    )


# ---- collection ------------------------------------------------------------------


_SUFFIX = "[" + ", ".join(f"' {s}'" for s in w.QUERY_SUFFIXES) + "]"
# Languages as topics, and small topics of a few posts each, half of which answer the broadened query only. Every row
# is a candidate. One language's first provider has nothing recent, and one query has the second provider only.
block("offered_v", f"""
SELECT *, tp || {_SUFFIX}[CASE WHEN small THEN 1 ELSE k + 1 END] || CASE WHEN small AND post_id % 2 = 1 THEN '{w.RETRY_SUFFIX}' ELSE '' END AS q,
  CASE WHEN post_id // 8 % 3 = 1 THEN 1 ELSE post_id // 4 % 2 END AS provider, post_id // 8 % 3 AS lead,
  {strip_sql('content')} AS c, {strip_sql('url')} AS u
FROM (SELECT *, post_id % 97 = 0 AS small, CASE WHEN post_id % 97 = 0 THEN 'small' || (post_id // 640) ELSE topic END AS tp,
  CASE WHEN post_id % 3 = 0 THEN post_id // 4 % 4 ELSE post_id % 4 END AS k FROM posts_v) p""")
block("tiered_v", """
SELECT a.* FROM offered_v a JOIN (SELECT q, count(*) FILTER (source = 'serpapi') AS n, count(*) FILTER (source = 'newsapi') AS m
  FROM offered_v GROUP BY 1) x USING (q) WHERE source = 'serpapi' OR (source = 'newsapi' AND n < 10) OR (source = 'mock' AND n = 0 AND m = 0)""")
block("usable_v", f"SELECT *, ends_with(q, '{w.RETRY_SUFFIX}') AS broad FROM tiered_v WHERE c <> '' AND u <> ''")
block("thin_v", """
SELECT t.tp, coalesce(docs, 0) < 3 AS thin FROM (SELECT DISTINCT tp FROM offered_v) t
LEFT JOIN (SELECT tp, count(DISTINCT c) AS docs FROM usable_v WHERE NOT broad GROUP BY 1) d USING (tp)""")
block("base_v", "SELECT b.* FROM usable_v b JOIN thin_v t USING (tp) WHERE b.broad = t.thin")
block("routed4_v", f"""
SELECT s.tp, s.tp || {_SUFFIX}[lead + 1] || CASE WHEN thin THEN '{w.RETRY_SUFFIX}' ELSE '' END AS q, lead, post_id, c, u, provider,
  CASE WHEN s.tp = 'fr' AND provider = 0 THEN collected_at - INTERVAL 400 DAYS ELSE collected_at END AS seen_at
FROM offered_v s JOIN thin_v t USING (tp) WHERE source = 'linkedin'""")
block("extra_v", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tp ORDER BY lead, n) AS total FROM (
  SELECT *, row_number() OVER (PARTITION BY tp, q ORDER BY post_id) AS n FROM (
    SELECT *, min(provider) OVER (PARTITION BY q) AS best FROM routed4_v) a
  WHERE provider = best AND seen_at >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAYS) b WHERE n <= ceil(25 / 3.0)) d WHERE total <= 25""")
block("groups_v", """
SELECT q, count(DISTINCT sha256(c || u)) AS posts FROM (
  SELECT q, c, u FROM (SELECT q, c, u, row_number() OVER (PARTITION BY q, c ORDER BY post_id) AS r FROM base_v) x WHERE r = 1
  UNION ALL
  SELECT q, c, u FROM (SELECT q, c, u, row_number() OVER (PARTITION BY q, c ORDER BY post_id) AS r FROM extra_v WHERE c <> '' AND u <> '') y WHERE r = 1) z GROUP BY 1""")
block("docs_v", """
SELECT tp, count(DISTINCT sha256(c || u)) AS docs FROM (
  SELECT tp, c, u FROM (SELECT tp, c, u, row_number() OVER (PARTITION BY tp, c ORDER BY post_id) AS r FROM base_v) x WHERE r = 1
  UNION ALL SELECT tp, c, u FROM extra_v WHERE c <> '' AND u <> '') z GROUP BY 1""")
CQ4_SQL = f"""
SELECT t.tp AS topic, t.tp || s || CASE WHEN thin THEN '{w.RETRY_SUFFIX}' ELSE '' END AS query, coalesce(posts, 0) AS posts,
  coalesce(docs, 0) AS docs, thin AS retried
FROM thin_v t CROSS JOIN (SELECT unnest({_SUFFIX}) AS s, unnest(range(4)) AS ord) x
LEFT JOIN groups_v g ON g.q = t.tp || s || CASE WHEN thin THEN '{w.RETRY_SUFFIX}' ELSE '' END
LEFT JOIN docs_v d ON d.tp = t.tp WHERE ord < 3 OR NOT thin"""


@query("cq4_collect", CQ4_SQL)
def cq4(t):
    """Every row is offered: web, news and stand-in rows answer a query, social rows carry a tag."""
    i = F.col("post_id")
    small = i % 97 == 0
    posts = t.posts().withColumn("topic", F.when(small, F.concat(F.lit("small"), F.floor(i / 640).cast("string"))).otherwise(F.col("topic")))
    expanded = expand_topic(F.col("topic"))
    k = F.when(small, 0).when(i % 3 == 0, F.floor(i / 4) % 4).otherwise(i % 4).cast("int")
    suffix = F.when(small & (i % 2 == 1), w.RETRY_SUFFIX).otherwise("")
    answered = posts.withColumn("query", F.concat(F.get(expanded, k), suffix))
    lead = (F.floor(i / 8) % 3).cast("int")
    provider = F.when(lead == 1, 1).otherwise((F.floor(i / 4) % 2).cast("int"))
    old = (F.col("topic") == "fr") & (F.col("provider_rank") == 0)
    social = (
        posts.where("source = 'linkedin'")
        .drop("query")
        .withColumn("tag", F.get(expanded, lead))
        .withColumn("provider_rank", provider)
        .withColumn("collected_at", F.when(old, F.col("collected_at") - F.expr("INTERVAL 400 DAYS")).otherwise(F.col("collected_at")))
    )
    result = collect(
        posts.select("topic").distinct(),
        answered.where("source = 'serpapi'"),
        answered.where("source = 'newsapi'"),
        answered.where("source = 'mock'"),
        social,
        as_of(),
    )
    per_query = result.groups.groupBy("query").agg(F.count("*").alias("posts"))
    per_topic = result.posts.groupBy("topic").agg(F.count("*").alias("docs"))
    retried = result.retried.withColumn("retried", F.lit(True))
    nothing = F.lit(0).cast("bigint")
    return (
        result.queries.join(per_query, "query", "left")
        .join(per_topic, "topic", "left")
        .join(retried, "topic", "left")
        .select("topic", "query", F.coalesce("posts", nothing).alias("posts"), F.coalesce("docs", nothing).alias("docs"),
                F.coalesce("retried", F.lit(False)).alias("retried"))
    )

"""Landed records and payloads, social fields, routing, fallbacks and caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import lenient, payload
from topicloom.functions import wordlists as w
from topicloom.operators import collect
from topicloom.registry.base import query
from topicloom.registry.posts import stamp, strip_sql
from topicloom.registry.sqltext import block
from topicloom.session import new_folder
from topicloom.sources import landed
from topicloom.streaming import jobs

# ---- raw records ---------------------------------------------------------------


LINES_SQL = f"""SELECT query || '#' || post_id AS query, CASE WHEN post_id % 19 = 0 THEN 'malformed' WHEN post_id % 17 = 0 THEN 'missing url'
    WHEN post_id % 13 = 0 OR {strip_sql('content')} = '' THEN 'empty content' ELSE '' END AS reason, post_id, source, {strip_sql('content')} AS content, likes FROM posts_v"""
FILES_SQL = f"""SELECT CASE WHEN reason = '' THEN query ELSE '' END AS query, reason, CASE WHEN reason = '' THEN content ELSE '' END AS content,
  CASE WHEN reason = '' THEN likes END AS likes, CASE WHEN reason = 'malformed' THEN '{{"query": "' || query WHEN reason = '' THEN '' ELSE 'kept' END AS line
FROM ({LINES_SQL}) l"""


def _landed_lines(t):
    """The posts as JSON lines with an unknown field; some cut short, without URL, or with blank content."""
    i = F.col("post_id")
    at = F.coalesce(F.col("collected_at"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    name = F.concat("query", F.lit("#"), i.cast("string"))
    record = F.to_json(
        F.struct(
            name.alias("query"), "source", F.when(i % 13 == 0, "  ").otherwise(F.col("content")).alias("content"),
            F.when(i % 17 != 0, F.col("url")).alias("url"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("collected_at"),
            F.struct("likes", "comments", "shares").alias("metadata"), F.lit("x").alias("unknown"),
        )
    )
    return t.posts().select(F.when(i % 19 == 0, F.concat(F.lit('{"query": "'), name)).otherwise(record).alias("value"))


def _both_outputs(records, rejected):
    """Usable records and the quarantine in one table; of parsed lines only whether they were kept."""
    line = F.when(F.col("reason") == "malformed", F.col("line")).when(F.length("line") > 0, "kept")
    usable = records.select("query", F.lit("").alias("reason"), "content", F.col("metadata.likes").alias("likes"), F.lit("").alias("line"))
    nothing = [F.lit("").alias("content"), F.lit(None).cast("bigint").alias("likes")]
    return usable.unionByName(rejected.select(F.lit("").alias("query"), "reason", *nothing, line.alias("line")))


@query("src1_files", FILES_SQL)
def src1_files(t):
    """Landed line files through the file reader: records and quarantine."""
    path = new_folder(t.spark, "landed")
    _landed_lines(t).write.text(path)
    judged = landed.read_landed(t.spark, path)
    return _both_outputs(landed.accepted(judged), landed.quarantined(judged))


@query("src1_file_stream", FILES_SQL)
def src1_stream(t):
    """The same from a stream of files."""
    path, out = new_folder(t.spark, "landed"), new_folder(t.spark, "landed-out")
    _landed_lines(t).repartition(4).write.text(path)
    lines = t.spark.readStream.option("maxFilesPerTrigger", 2).text(path)
    jobs.run_landed(lines, out, new_folder(t.spark, "landed-state")).awaitTermination()
    return _both_outputs(t.spark.read.parquet(f"{out}/records"), t.spark.read.parquet(f"{out}/quarantine"))


@query(
    "src1_raw_records",
    f"""SELECT post_id, query, source, {strip_sql('content')} AS content, url, strftime(coalesce(collected_at, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS collected_at, likes
    FROM posts_v WHERE post_id % 13 <> 0 AND post_id % 17 <> 0 AND post_id % 19 <> 0 AND {strip_sql('content')} <> ''""",
)
def src1(t):
    """JSON lines with an unknown field; some with blank content, no URL, or cut short."""
    i = F.col("post_id")
    at = F.coalesce(F.col("collected_at"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    record = F.to_json(
        F.struct(
            "query",
            "source",
            F.when(i % 13 == 0, "  ").otherwise(F.col("content")).alias("content"),
            F.when(i % 17 != 0, F.col("url")).alias("url"),
            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("collected_at"),
            F.struct("likes", "comments", "shares").alias("metadata"),
            F.lit("x").alias("unknown"),
        )
    )
    lines = t.posts().select(i, F.when(i % 19 == 0, F.expr("substring('{\"query\": \"q', 1, 9)")).otherwise(record).alias("value"))
    rows = landed.raw_records(lines)
    return rows.select(
        "post_id", "query", "source", "content", "url", stamp("collected_at").alias("collected_at"), F.col("metadata.likes").alias("likes")
    )


# ---- web and news payloads: the lines of a document as results ------------------


def line_payloads(t, shape: str):
    def web(x, i):
        return F.struct(
            F.when(i % 3 != 2, F.split_part(x, F.lit(". "), F.lit(1))).alias("title"),
            F.when(i % 4 != 3, x).alias("snippet"),
            F.when(i % 2 == 0, F.concat(F.lit("https://example.org/"), i.cast("string"))).alias("link"),
        )

    def news(x, i):
        return F.struct(
            F.when(i % 5 != 4, F.split_part(x, F.lit(". "), F.lit(1))).alias("title"),
            F.when(i % 3 == 0, x).when(i % 3 == 1, F.lit("")).alias("description"),
            F.when(i % 2 == 0, F.concat(F.lit("https://example.org/"), i.cast("string"))).alias("url"),
        )

    lines = F.transform(F.split("content", "\n"), web if shape == "web" else news)
    body = F.to_json(F.struct(lines.alias("organic_results" if shape == "web" else "articles")))
    return t.posts(False, False).select("post_id", "query", body.alias("payload"))


LINES = """(SELECT post_id, query, x, i - 1 AS i FROM (SELECT post_id, query, unnest(xs) AS x, generate_subscripts(xs, 1) AS i
  FROM (SELECT post_id, query, string_split(content, chr(10)) AS xs FROM posts_v) s) u WHERE i <= 5) ln"""
_URL = "CASE WHEN i % 2 = 0 THEN 'https://example.org/' || i ELSE 'https://example.com' END"


@query(
    "src2_web_results",
    f"""SELECT post_id, query, i AS pos, 'serpapi' AS source, {_URL} AS url,
      CASE WHEN i % 3 <> 2 THEN split_part(x, '. ', 1) ELSE '' END || '. ' || CASE WHEN i % 4 <> 3 THEN x ELSE '' END AS content FROM {LINES}""",
)
def src2(t):
    return landed.web_results(line_payloads(t, "web"))


_TITLE = "CASE WHEN i % 5 <> 4 THEN split_part(x, '. ', 1) ELSE '' END"
_BODY = strip_sql(f"coalesce(nullif(CASE WHEN i % 3 = 0 THEN x ELSE '' END, ''), {_TITLE})")


@query(
    "src3_news_results",
    f"SELECT post_id, query, i AS pos, 'newsapi' AS source, {_URL} AS url, {_TITLE} || '. ' || {_BODY} AS content FROM {LINES} WHERE {_BODY} <> ''",
)
def src3(t):
    return landed.news_results(line_payloads(t, "news"))


# ---- social payloads -------------------------------------------------------------

KEYS = payload.TEXT_KEYS


def social_payloads(t):
    """Posts as objects whose keys differ from row to row."""
    i, text = F.col("post_id"), F.col("content")
    epoch = F.lit(1_700_000_000) + i * 60
    fields = [F.when(i % 6 == n, text).alias(k) for n, k in enumerate(KEYS)]
    fields += [
        F.when(i % 5 == n, F.concat(F.lit(f"https://s{n}.example.com/"), i.cast("string"))).alias(k)
        for n, k in enumerate(payload.URL_KEYS)
    ]
    fields += [
        F.when(i % 7 == 0, epoch).when(i % 7 == 1, epoch * 1000).alias("postedAt"),
        F.when(i % 7 == 2, epoch.cast("string")).alias("postDate"),
        F.when(i % 7 == 3, F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i % 7 == 4, "junk").alias("publishedAt"),
        F.when(i % 7 == 4, F.struct(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'+02:00'").alias("createdAt"))).alias("post"),
        F.when(i % 4 == 0, F.concat(F.lit("author-"), i.cast("string"))).alias("authorName"),
        F.when(i % 4 == 1, F.struct(F.concat(F.lit("name-"), i.cast("string")).alias("name"))).alias("author"),
        F.when(i % 4 == 2, F.struct(F.lit("actor").alias("name"))).alias("actor"),
        F.when(i % 3 == 0, F.struct((i % 50).alias("numLikes"), (i % 9 - 3).alias("commentCount"))).alias("socialActivity"),
        F.when(i % 3 == 1, F.struct((i % 40).cast("string").alias("reactionTotal"), (i % 8).alias("reshares"))).alias("stats"),
        F.when(i % 2 == 0, i % 11).alias("comments"),
        F.when(i % 5 == 1, F.struct((i % 4).alias("LIKE"), (i % 6).cast("string").alias("LOVE"))).alias("reactions"),
        F.when(i % 2 == 1, (i % 13).cast("string")).alias("repostCount"),
        F.when(i % 10 == 0, F.array(F.lit("a"), F.lit("b"))).alias("hashtags"),
        F.when(i % 15 == 2, F.struct(F.lit(True).alias("liked"), F.lit("3.7").alias("commentText"), F.lit(3.7).alias("shareRate"))).alias("engagement"),
        F.when(i % 15 == 8, True).alias("likeFlag"),
        F.when(i % 15 == 8, "2.5").alias("commentRatio"),
        F.when(i % 15 == 8, F.struct(F.lit(True).alias("a"), F.lit("2").alias("b"), F.lit(2.9).alias("c"), F.lit("x").alias("d"), F.lit("2.5").alias("e"))).alias("shareMap"),
    ]
    return t.posts(False, False).select(i, "query", F.to_json(F.struct(*fields)).alias("payload"))


_EPOCH = "1700000000 + post_id * 60"
block("social_v", f"""
SELECT post_id, query, {strip_sql('content')} AS text,
  CASE post_id % 5 WHEN 4 THEN 'https://linkedin.com' ELSE 'https://s' || (post_id % 5) || '.example.com/' || post_id END AS url,
  CASE post_id % 4 WHEN 0 THEN 'author-' || post_id WHEN 1 THEN 'name-' || post_id WHEN 2 THEN 'actor' ELSE '' END AS author,
  strftime(CASE WHEN post_id % 7 <= 3 THEN make_timestamp(({_EPOCH}) * 1000000) WHEN post_id % 7 = 4 THEN make_timestamp(({_EPOCH} - 7200) * 1000000)
    ELSE TIMESTAMP '2024-02-01' END, '%Y-%m-%d %H:%M:%S') AS collected_at,
  CASE WHEN post_id % 3 = 0 AND post_id % 50 > 0 THEN post_id % 50 WHEN post_id % 3 = 1 AND post_id % 40 > 0 THEN post_id % 40
    WHEN post_id % 5 = 1 THEN post_id % 4 + post_id % 6 WHEN post_id % 15 IN (2, 8) THEN 1 ELSE 0 END AS likes,
  CASE WHEN post_id % 3 = 0 AND post_id % 9 - 3 > 0 THEN post_id % 9 - 3 WHEN post_id % 2 = 0 THEN post_id % 11 ELSE 0 END AS comments,
  CASE WHEN post_id % 3 = 1 AND post_id % 8 > 0 THEN post_id % 8 WHEN post_id % 15 = 2 THEN 3
    WHEN post_id % 2 = 1 AND post_id % 13 > 0 THEN post_id % 13 WHEN post_id % 15 = 8 THEN 5 ELSE 0 END AS shares,
  CASE WHEN post_id % 10 = 0 THEN 'a, b' ELSE '' END AS hashtags FROM posts_v""")


def _payload_maps(t):
    return social_payloads(t).select("post_id", payload.as_map(F.col("payload")).alias("p"))


@query(
    "src4_social_posts",
    """SELECT post_id, query, 'linkedin' AS source, substring(text, 1, 2000) AS content, url, collected_at, author, likes, comments, shares, hashtags
    FROM social_v WHERE length(text) >= 20""",
)
def src4(t):
    rows = landed.social_posts(social_payloads(t), F.lit("2024-02-01").cast("timestamp"))
    return rows.select(
        "post_id", "query", "source", "content", "url", stamp("collected_at").alias("collected_at"), "metadata.author",
        "metadata.likes", "metadata.comments", "metadata.shares", F.concat_ws(", ", "metadata.hashtags").alias("hashtags"),
    )


@query("sc4_first_text", "SELECT post_id, text FROM social_v")
def sc4(t):
    return _payload_maps(t).select("post_id", payload.post_text(F.col("p")).alias("text"))


@query("sc5_first_url", "SELECT post_id, url FROM social_v")
def sc5(t):
    return _payload_maps(t).select("post_id", payload.post_url(F.col("p")).alias("url"))


@query("sc6_author", "SELECT post_id, author FROM social_v")
def sc6(t):
    return _payload_maps(t).select("post_id", payload.post_author(F.col("p")).alias("author"))


@query("sc7_post_time", "SELECT post_id, collected_at FROM social_v")
def sc7(t):
    at = payload.post_time(F.col("p"), F.lit("2024-02-01").cast("timestamp"))
    return _payload_maps(t).select("post_id", stamp(at).alias("collected_at"))


@query("sc8_engagement_counts", "SELECT post_id, likes, comments, shares FROM social_v")
def sc8(t):
    counts = payload.typed_engagement_counts(payload.as_map(F.col("payload")), F.col("payload"))
    return social_payloads(t).select("post_id", counts.alias("e")).select("post_id", "e.*")


# ---- lenient parsing --------------------------------------------------------------


def responses(t):
    """Free-form responses made of conversation turns: fenced lists, quoted text, prose."""
    plain = F.regexp_replace("text", r"[^\p{L}\p{N} ]", "")
    turn = F.col("turn")
    listed = F.concat(F.lit('```json\n["'), plain, F.lit('", "'), F.col("role"), F.lit('"]\n```'))
    spoken = F.concat(F.lit('Try "'), F.col("role"), F.lit(' queries" or "abc" and "'), plain, F.lit('".'))
    raw = F.when(turn % 3 == 0, listed).when(turn % 3 == 1, spoken).otherwise(plain)
    return t.read("conversations").select("conv_id", "turn", "role", plain.alias("plain"), raw.alias("raw"))


_PLAIN = r"regexp_replace(text, '[^\p{L}\p{N} ]', '', 'g')"


@query(
    "sc24_string_lists",
    f"""SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN p || ' ; ' || role
      WHEN 1 THEN array_to_string(list_slice(regexp_extract_all('Try "' || role || ' queries" or "abc" and "' || p || '".', '"([^"]{{5,}})"', 1), 1, 8), ' ; ')
      ELSE {" || ' ; ' || ".join(f"role || ' {s}'" for s in w.QUERY_SUFFIXES)} END AS items
    FROM (SELECT *, {_PLAIN} AS p FROM conversations) c""",
)
def sc24(t):
    items = lenient.string_list(F.col("raw"), F.col("role"))
    return responses(t).select("conv_id", "turn", "role", F.concat_ws(" ; ", items).alias("items"))


@query(
    "sc25_insight_objects",
    f"""SELECT conv_id, turn, role, CASE WHEN turn % 3 = 2 THEN 'Intelligence analysis complete for topic: ' || role || '.' ELSE p END AS summary,
      CASE WHEN turn % 3 = 2 THEN 2 ELSE 1 END AS takeaways, CASE turn % 3 WHEN 0 THEN 0.75 WHEN 1 THEN 0.0 ELSE 0.4 END::DOUBLE AS confidence
    FROM (SELECT *, {_PLAIN} AS p FROM conversations) c""",
)
def sc25(t):
    turn, plain = F.col("turn"), F.col("plain")
    complete = F.struct(
        plain.alias("summary"),
        F.array(plain).alias("key_takeaways"),
        F.array(F.lit("one"), F.lit("two")).alias("opportunities"),
        F.when(turn % 3 == 0, 0.75).alias("confidence"),
    )
    raw = F.when(turn % 3 == 2, F.to_json(F.struct(plain.alias("summary")))).otherwise(
        F.concat(F.lit("```json\n"), F.to_json(complete), F.lit("\n```"))
    )
    rows = responses(t).select("conv_id", "turn", "role", lenient.insight(raw, F.col("role")).alias("i"))
    return rows.select(
        "conv_id", "turn", "role", "i.summary", F.size("i.key_takeaways").alias("takeaways"), "i.confidence"
    )


# ---- routing, fallbacks, caps ------------------------------------------------------


def _topic_queries(t):
    langs = t.posts(False, False).select("topic").distinct()
    return collect.expand_queries(langs)


def tagged(t):
    """Posts with an exact tag, a shorter one, a longer one, or one that fits nothing."""
    i, topic = F.col("post_id"), F.col("topic")
    tag = (
        F.when(i % 4 == 0, F.concat(topic, F.lit(" market growth and key players")))
        .when(i % 4 == 1, F.concat(topic, F.lit(" industry news")))
        .when(i % 4 == 2, F.concat(F.lit("about "), topic, F.lit(" technology innovations now")))
        .otherwise(F.lit("nothing like it"))
    )
    return t.posts(False, False).select(i, topic, tag.alias("tag"))


block("routed_v", """
SELECT post_id, topic, topic || CASE post_id % 4 WHEN 0 THEN ' market growth and key players' WHEN 1 THEN ' industry news and developments'
  WHEN 2 THEN ' technology innovations' ELSE ' latest trends 2026' END AS query, content, url, source,
  CASE post_id % 4 WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 3 END AS ord FROM posts_v""")


@query("jn2_route_items", "SELECT post_id, topic, query FROM routed_v")
def jn2(t):
    return collect.route_items(tagged(t), _topic_queries(t)).select("post_id", "topic", "query")


def candidates(t, engagement: bool = False):
    """Posts in groups of 64 as queries; English web rows are primary, news rows
    secondary, the rest stand in."""
    posts = t.posts(urls=True, engagement=engagement)
    return posts.withColumn("query", F.concat(F.lit("g"), F.floor(F.col("post_id") / 64).cast("string")))


block("cand64_v", "SELECT post_id, topic, source, content, url, 'g' || (post_id // 64) AS query FROM posts_v")
# Every row is in a tier. A run of three queries has twelve primary rows (enough), four (too few), and none.
block("tier_v", """
SELECT post_id, source, 'g' || CASE source WHEN 'serpapi' THEN post_id // 64 * 3 + CASE WHEN post_id % 16 = 0 THEN 1 ELSE 0 END
  WHEN 'newsapi' THEN post_id // 32 ELSE post_id // 10 END AS query FROM posts_v""")
block("primary_n_v", "SELECT query, count(*) FILTER (source = 'serpapi') AS n, count(*) FILTER (source = 'newsapi') AS m FROM tier_v GROUP BY 1")
block("fallback_v", """
SELECT c.* FROM tier_v c JOIN primary_n_v USING (query) WHERE source = 'serpapi'
  OR (source = 'newsapi' AND n < 10) OR (source IN ('mock', 'linkedin') AND n = 0 AND m = 0)""")


def _with_fallbacks(t):
    i = F.col("post_id")
    few = F.when(i % 16 == 0, 1).otherwise(0)
    group = (
        F.when(F.col("source") == "serpapi", F.floor(i / 64) * 3 + few)
        .when(F.col("source") == "newsapi", F.floor(i / 32))
        .otherwise(F.floor(i / 10))
    )
    rows = t.posts(urls=False, engagement=False).select(i, "source", F.concat(F.lit("g"), group.cast("string")).alias("query"))
    return collect.with_fallbacks(
        rows.select("query").distinct(),
        rows.where("source = 'serpapi'"),
        rows.where("source = 'newsapi'"),
        rows.where("source IN ('mock', 'linkedin')"),
    )


@query("jn12_source_fallback", "SELECT post_id, query, source FROM fallback_v")
def jn12(t):
    return _with_fallbacks(t).select("post_id", "query", "source")


block("cand3_v", "SELECT post_id, source, 'g' || (post_id // 3) AS query FROM posts_v")


@query(
    "jn13_first_provider",
    """SELECT post_id, query, provider_rank FROM (SELECT post_id, query, CASE source WHEN 'serpapi' THEN 0 WHEN 'newsapi' THEN 1 ELSE 2 END AS provider_rank,
        min(CASE source WHEN 'serpapi' THEN 0 WHEN 'newsapi' THEN 1 ELSE 2 END) OVER (PARTITION BY query) AS best
      FROM cand3_v) q WHERE provider_rank = best""",
)
def jn13(t):
    rank = F.when(F.col("source") == "serpapi", 0).when(F.col("source") == "newsapi", 1).otherwise(2)
    query = F.concat(F.lit("g"), F.floor(F.col("post_id") / 3).cast("string"))
    rows = t.posts(urls=False, engagement=False).select("post_id", query.alias("query"), rank.alias("provider_rank"))
    return collect.first_provider(rows).select("post_id", "query", "provider_rank")


@query(
    "wn4_query_caps",
    """SELECT post_id, topic, query FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY ord, n) AS total FROM (
      SELECT *, row_number() OVER (PARTITION BY topic, query ORDER BY post_id) AS n FROM routed_v) a WHERE n <= ceil(25 / 4.0)) b WHERE total <= 25""",
)
def wn4(t):
    queries = _topic_queries(t)
    routed = collect.route_items(tagged(t), queries).select("post_id", "topic", "query")
    return collect.cap_per_query(routed, queries, 25, "post_id").select("post_id", "topic", "query")


@query(
    "jn10_merge_enrichment",
    """SELECT post_id, query, source FROM (SELECT *, row_number() OVER (PARTITION BY query, sha256(content || url) ORDER BY source = 'linkedin', post_id) AS r
      FROM cand64_v) q WHERE r = 1""",
)
def jn10(t):
    rows = candidates(t).select("post_id", "query", "source", "content", "url")
    merged = collect.merge_enrichment(rows.where("source <> 'linkedin'"), rows.where("source = 'linkedin'"), "post_id")
    return merged.select("post_id", "query", "source")


@query("so1_union_sources", "SELECT source, count(*) AS n, count(likes) AS with_likes FROM (SELECT source, CASE WHEN source = 'linkedin' THEN likes END AS likes FROM posts_v) u GROUP BY 1")
def so1(t):
    """Bag union of sources; only one of them carries engagement."""
    posts = t.posts(urls=False)
    social = posts.where("source = 'linkedin'").select("source", "likes")
    others = posts.where("source <> 'linkedin'").select("source")
    both = others.unionByName(social, allowMissingColumns=True)
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("likes").alias("with_likes"))


@query(
    "fl13_region",
    """SELECT region, count(*) AS n FROM (SELECT ['india', 'asia_pacific', 'southeast_asia', 'north_america', 'europe', 'middle_east'][c_nationkey % 6 + 1] AS region FROM customer) c
    WHERE region = 'europe' GROUP BY 1 UNION ALL SELECT 'global', count(*) FROM customer""",
)
def fl13(t):
    regions = F.array(*[F.lit(r) for r in w.REGIONS])
    rows = t.read("customer").select(F.element_at(regions, (F.col("c_nationkey") % 6 + 1).cast("int")).alias("region"))
    one = collect.in_region(rows, "europe").groupBy("region").agg(F.count("*").alias("n"))
    all_rows = collect.in_region(rows, "global").agg(F.count("*").alias("n"))
    return one.unionByName(all_rows.select(F.lit("global").alias("region"), "n"))

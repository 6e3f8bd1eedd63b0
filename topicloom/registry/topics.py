"""Topic strings: keys, classification, expansion, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import text, topics
from topicloom.functions import wordlists as w
from topicloom.operators import collect
from topicloom.registry.base import query
from topicloom.registry.sqltext import quoted

_KEY = r"lower(trim(regexp_replace(topic, '\s+', ' ', 'g')))"
_CLEAN = r"trim(regexp_replace(topic, '\s+', ' ', 'g'))"


@query("sc3_topic_key", f"SELECT topic, {_KEY} AS topic_key FROM topics_v")
def sc3(t):
    return t.topics().select("topic", text.topic_key(F.col("topic")).alias("topic_key"))


@query("sc12_fingerprint", f"SELECT topic, 'tl:v1:' || substring(sha256({_KEY}), 1, 24) AS fingerprint FROM topics_v")
def sc12(t):
    return t.topics().select("topic", text.fingerprint(F.col("topic")).alias("fingerprint"))


@query(
    "sc13_analysis_key",
    r"""SELECT topic, 'tl:v1:' || substring(sha256(lower(trim(regexp_replace(
      topic || '|web_news|' || (length(topic) + 5) || '|30d|global', '\s+', ' ', 'g')))), 1, 24) AS analysis_key FROM topics_v""",
)
def sc13(t):
    key = text.analysis_key(
        F.col("topic"), F.lit("web_news"), F.length("topic") + 5, F.lit("30d"), F.lit("global")
    )
    return t.topics().select("topic", key.alias("analysis_key"))


DICTIONARY = ", ".join(f"('{k}', '{'; '.join(v)}')" for k, v in w.GENERIC_TOPICS.items())
TOKENS = rf"regexp_extract_all(lower({_CLEAN}), '[a-zA-Z0-9\-]+')"
CLASSIFIED = rf"""(SELECT *, CASE WHEN n <= 1 OR hints IS NOT NULL THEN 'broad'
      WHEN n <= 2 AND list_has_any(toks, [{quoted(w.VAGUE_TERMS)}]) THEN 'vague' ELSE 'niche' END AS query_type
    FROM (SELECT topic, {_CLEAN} AS cleaned, {TOKENS} AS toks, len({TOKENS}) AS n, hints FROM topics_v
      LEFT JOIN (VALUES {DICTIONARY}) d(k, hints) ON k = lower({_CLEAN})) a) c"""
TEMPLATED = " || '; ' || ".join(f"cleaned || ' {s}'" for s in w.GENERIC_SUGGESTIONS)


@query(
    "sc15_classify_topic",
    f"""SELECT topic, cleaned AS original_query, query_type, cleaned AS effective_topic,
      CASE query_type WHEN 'broad' THEN '{topics.REASONS['broad']}' WHEN 'vague' THEN '{topics.REASONS['vague']}'
        ELSE CASE WHEN n >= 4 THEN '{topics.REASONS['context']}' ELSE '{topics.REASONS['modifiers']}' END END AS reason,
      CASE WHEN query_type = 'niche' THEN '' ELSE coalesce(hints, {TEMPLATED}) END AS suggestions FROM {CLASSIFIED}""",
)
def sc15(t):
    rows = t.topics().select("topic", *topics.classify_topic(F.col("topic")))
    return rows.withColumn("suggestions", F.concat_ws("; ", "suggestions"))


@query(
    "jn11_dictionary_lookup",
    f"SELECT topic, coalesce(hints, {TEMPLATED}) AS suggestions FROM {CLASSIFIED}",
)
def jn11(t):
    return t.topics().select("topic", F.concat_ws("; ", topics.dictionary_suggestions(F.col("topic"))).alias("suggestions"))


EXPANDED = "(SELECT topic, ord, topic || suffix AS query FROM topics_v, (VALUES {}) s(ord, suffix)) e".format(
    ", ".join(f"({i}, ' {s}')" for i, s in enumerate(w.QUERY_SUFFIXES))
)


@query("sc16_expand_topic", f"SELECT topic, ord, query FROM {EXPANDED}")
def sc16(t):
    return collect.expand_queries(t.topics())


@query("sc17_broaden_queries", f"SELECT topic, ord, query || '{w.RETRY_SUFFIX}' AS query FROM {EXPANDED} WHERE ord < 3")
def sc17(t):
    return collect.broaden_queries(collect.expand_queries(t.topics()))


@query(
    "sc18_short_keyword",
    r"""SELECT topic, CASE WHEN len(ws) > 0 THEN array_to_string(list_slice(ws, 1, 3), ' ') ELSE substring(topic, 1, 50) END AS keyword
    FROM (SELECT topic, list_filter(regexp_split_to_array(trim(topic), '\s+'), lambda x: length(x) > 2) AS ws FROM topics_v) s""",
)
def sc18(t):
    return t.topics().select("topic", text.short_keyword(F.col("topic")).alias("keyword"))


@query(
    "fl12_request_validity",
    """SELECT topic, posts, CASE WHEN length(topic) NOT BETWEEN 2 AND 200 THEN 'topic length must be 2 to 200'
      WHEN posts NOT BETWEEN 5 AND 200 THEN 'post count must be 5 to 200' END AS problem
    FROM (SELECT CASE WHEN p_partkey % 17 = 0 THEN 'x' WHEN p_partkey % 19 = 0 THEN repeat(p_name, 40) ELSE p_name END AS topic,
      p_size * 6 AS posts FROM part) r""",
)
def fl12(t):
    k, name = F.col("p_partkey"), F.col("p_name")
    topic = F.when(k % 17 == 0, "x").when(k % 19 == 0, F.repeat(name, 40)).otherwise(name)
    requests = t.read("part").select(topic.alias("topic"), (F.col("p_size") * 6).alias("posts"))
    return requests.withColumn("problem", topics.invalid_request(F.col("topic"), F.col("posts")))


@query(
    "fl10_retry_topics",
    """SELECT topic, count(post_id) AS docs FROM topics_v LEFT JOIN (
      SELECT l_orderkey AS post_id, p_name AS t FROM lineitem JOIN part ON p_partkey = l_partkey) d ON t = topic
    GROUP BY 1 HAVING count(post_id) < 3""",
)
def fl10(t):
    lines = t.read("lineitem").select("l_partkey")
    part = t.read("part").select("p_partkey", F.col("p_name").alias("topic"))
    docs = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("topic")
    return collect.retry_topics(t.topics(), docs)

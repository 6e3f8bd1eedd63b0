"""SQL building blocks for the comparison queries.

``oracle(body)`` puts the named blocks a body mentions, and those they mention, in front
of it as common table expressions.
"""

from __future__ import annotations

import re

from topicloom.functions import wordlists as w
from topicloom.functions.sentiment import _ranked, two_word_entries


def quoted(words) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in words)


RECURSIVE = "WITH RECURSIVE "
BLOCKS: dict[str, str] = {}


def block(name: str, sql: str) -> None:
    BLOCKS[name] = sql


def complete(sql: str) -> str:
    """Fill in the stop words, which come from the running session's MLlib."""
    stops = w.stop_words()
    dropped = sorted(set(stops) | set(w.LOW_SIGNAL_TERMS) | set(w.GENERIC_LABEL_TERMS))
    return sql.replace("@STOP_WORDS@", quoted(stops)).replace("@LABEL_DROPPED@", quoted(dropped))


def oracle(body: str, replace: dict[str, str] | None = None) -> str:
    texts = {**BLOCKS, **(replace or {})}
    found: list[str] = []

    def visit(sql: str) -> None:
        for name in texts:
            if name not in found and re.search(rf"\b{name}\b", sql):
                visit(texts[name])
                if name not in found:
                    found.append(name)

    visit(body)
    if not found:
        return body
    blocks = ",\n".join(f"{n} AS ({texts[n]})" for n in found)
    if body.startswith(RECURSIVE):
        return f"{RECURSIVE}{blocks},\n{body.removeprefix(RECURSIVE)}"
    return f"WITH {blocks}\n{body}"


block("posts_v", """
SELECT d.doc_id AS post_id, d.lang AS topic, 'q' || CAST(d.doc_id % 5 AS VARCHAR) AS query,
  CASE d.doc_id % 4 WHEN 0 THEN 'serpapi' WHEN 1 THEN 'newsapi' WHEN 2 THEN 'linkedin' ELSE 'mock' END AS source,
  d.text AS content, coalesce(p.url, 'https://example.com') AS url, e.last_ts AS collected_at,
  coalesce(e.likes, 0) AS likes, coalesce(e.comments, 0) AS comments, coalesce(e.shares, 0) AS shares
FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id
LEFT JOIN (SELECT user_id, max(ts) AS last_ts,
    count(*) FILTER (event_type = 'click') AS likes,
    count(*) FILTER (event_type = 'view') AS comments,
    count(*) FILTER (event_type = 'signup') AS shares
  FROM events GROUP BY user_id) e ON e.user_id = d.doc_id""")

block("api_usage_v", """
SELECT event_id AS id, ts AS logged_at, event_type AS source,
  CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) >= 80 THEN 500 ELSE 200 END AS status_code,
  value AS response_ms, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS record_count FROM events""")

block("runs_v", """
SELECT o.o_orderkey AS id, 'topic-' || CAST(o.o_custkey AS VARCHAR) AS topic, o.o_orderdate AS captured_at,
  o.o_totalprice AS elapsed_secs, coalesce(l.n, 0) AS sources_count
FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey""")

block("trends_v", """
SELECT * FROM (SELECT t.*, row_number() OVER (PARTITION BY topic, snapshot ORDER BY score DESC, label) AS trend_rank,
  (SELECT list_sort(list(DISTINCT kw)) FROM
     (SELECT split_part(p_name, ' ', 1) AS kw, p_brand, p_size, p_type FROM part
      UNION ALL SELECT split_part(p_name, ' ', 2), p_brand, p_size, p_type FROM part) k
   WHERE k.p_brand = t.topic AND k.p_size % 2 = t.snapshot AND k.p_type = t.label) AS keywords
FROM (SELECT p_brand AS topic, p_size % 2 AS snapshot, p_type AS label, CAST(sum(p_size) AS DOUBLE) / 10 AS score
      FROM part GROUP BY 1, 2, 3) t) r""")

block("lines_v", """
SELECT * FROM (SELECT id, topic, captured_at, l_linenumber AS n, l_partkey AS part,
  row_number() OVER (PARTITION BY id ORDER BY l_linenumber, l_partkey, 'supplier-' || l_suppkey) AS trend_rank,
  'supplier-' || CAST(l_suppkey AS VARCHAR) AS label,
  ['s' || CAST(l_suppkey % 7 AS VARCHAR), 'd' || CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR), 'f-' || l_returnflag] AS keywords,
  round(l_extendedprice) / 1000 AS score
FROM (SELECT o_orderkey AS id, 'topic-' || CAST(o_custkey AS VARCHAR) AS topic, o_orderdate AS captured_at FROM orders) r
JOIN lineitem ON l_orderkey = id) q""")

block("timeline_v", """
SELECT topic, dt, CAST(floor(100.0::DOUBLE * n / max(n) OVER (PARTITION BY topic)) AS INT) AS value
FROM (SELECT o_orderpriority AS topic, CAST(date_trunc('week', o_orderdate) AS DATE) AS dt, count(*) AS n
      FROM orders GROUP BY 1, 2) w""")

block("jobs_v", """
SELECT c_custkey AS pos, c_mktsegment AS topic, c_name AS title,
  'company-' || CAST(c_custkey % 37 AS VARCHAR) AS company,
  CASE WHEN c_custkey % 11 = 0 THEN '' ELSE n_name END AS location,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'band-' || CAST(c_custkey % 10 AS VARCHAR) END AS salary
FROM customer JOIN nation ON n_nationkey = c_nationkey""")

block("topics_v", """
SELECT p_name AS topic FROM part UNION SELECT r_name FROM region UNION SELECT r_name || ' market' FROM region
UNION SELECT p_name || ' ' || lower(p_type) || ' tools' FROM part UNION SELECT 'robotics' FROM region
UNION SELECT ' AI   startups ' FROM region UNION SELECT 'future ' || split_part(p_name, ' ', 1) FROM part""")

# ---- sentiment: gaps and islands over token positions ------------------------


def _lexicon_values() -> str:
    rows = [("p", c, e) for c, e in _ranked(w.POSITIVE_LEXICON)] + [("n", c, e) for c, e in _ranked(w.NEGATIVE_LEXICON)]
    return ", ".join(f"('{k}', {c}, '{e}')" for k, c, e in rows if " " not in e)


def _two_word_case() -> str:
    whens = " ".join(
        f"WHEN suffix(tok, '{a}') AND prefix(nxt, '{b}') THEN {code}" for code, a, b in two_word_entries()
    )
    return f"CASE {whens} END"


block("tok_v", r"""
SELECT post_id, unnest(t) AS tok, generate_subscripts(t, 1) AS pos
FROM (SELECT post_id, regexp_extract_all(lower(content), '[a-z][a-z0-9\-'']*') AS t FROM posts_v) s""")
block("lexicon_v", f"SELECT * FROM (VALUES {_lexicon_values()}) x(kind, code, entry)")
block("tokcode_v", """
SELECT tok, min(code) FILTER (kind = 'p') AS p, min(code) FILTER (kind = 'n') AS n
FROM (SELECT DISTINCT tok FROM tok_v) d JOIN lexicon_v ON contains(tok, entry) GROUP BY tok""")
block("around_v", f"""
SELECT t.post_id, t.pos, t.tok, c.p, c.n,
  lead(t.tok) OVER d AS nxt, lead(c.p) OVER d AS np, lead(c.n) OVER d AS nn,
  coalesce(lag(t.tok, 1) OVER d IN ({quoted(w.NEGATORS)}), FALSE)
    OR coalesce(lag(t.tok, 2) OVER d IN ({quoted(w.NEGATORS)}), FALSE) AS flipped,
  CASE WHEN coalesce(lag(t.tok, 1) OVER d IN ({quoted(w.INTENSIFIERS)}), FALSE)
    OR coalesce(lag(t.tok, 2) OVER d IN ({quoted(w.INTENSIFIERS)}), FALSE) THEN 2 ELSE 1 END AS factor
FROM tok_v t LEFT JOIN tokcode_v c USING (tok) WINDOW d AS (PARTITION BY t.post_id ORDER BY t.pos)""")
block("cand_v", f"""
SELECT *, pos - row_number() OVER (PARTITION BY post_id ORDER BY pos) AS island FROM (
  SELECT post_id, pos, flipped, factor, least(p, np) % 10 AS wp, least(n, nn, {_two_word_case()}) % 10 AS wn
  FROM around_v) c WHERE wp IS NOT NULL OR wn IS NOT NULL""")
block("visit_v", """
SELECT *, pos - min(pos) OVER (PARTITION BY post_id, island) AS off FROM cand_v""")
block("sentiment_v", """
SELECT post_id, positive, negative, score,
  CASE WHEN score > 0.08 THEN 'positive' WHEN score < -0.08 THEN 'negative' ELSE 'neutral' END AS label
FROM (SELECT post_id, positive, negative,
    CASE WHEN positive + negative = 0 THEN 0.0::DOUBLE
         ELSE round(CAST(positive - negative AS DOUBLE) / (positive + negative), 3) END AS score
  FROM (SELECT p.post_id, CAST(coalesce(sum(CASE WHEN v.flipped THEN coalesce(v.wn, 0) ELSE coalesce(v.wp, 0) END * v.factor), 0) AS BIGINT) AS positive,
        CAST(coalesce(sum(CASE WHEN v.flipped THEN coalesce(v.wp, 0) ELSE coalesce(v.wn, 0) END * v.factor), 0) AS BIGINT) AS negative
      FROM posts_v p LEFT JOIN (SELECT * FROM visit_v WHERE off % 2 = 0) v ON v.post_id = p.post_id GROUP BY p.post_id) a) b""")

# ---- terms -------------------------------------------------------------------

block("kept_v", rf"""
SELECT post_id, topic, list_filter(list_transform(
    regexp_extract_all(lower(content), '[\p{{L}}\p{{M}}\p{{N}}_\-]+'), lambda x: trim(x, '-')),
  lambda x: regexp_matches(x, '^[a-z][a-z0-9\-]{{2,}}$') AND x NOT IN (@STOP_WORDS@)) AS toks
FROM posts_v""")
block("kept_tok_v", """
SELECT post_id, topic, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM kept_v""")
block("termocc_v", """
SELECT post_id, topic, tok AS term FROM kept_tok_v
UNION ALL SELECT post_id, topic, term FROM (
  SELECT post_id, topic, tok || ' ' || lead(tok) OVER (PARTITION BY post_id ORDER BY pos) AS term FROM kept_tok_v) b
  WHERE term IS NOT NULL""")
block("vocab_v", """
SELECT topic, term, total FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY total DESC, term) AS r
  FROM (SELECT topic, term, count(*) AS total FROM termocc_v GROUP BY 1, 2) c) q WHERE r <= 250""")
block("vocabkind_v", r"""
SELECT topic, term, NOT regexp_matches(term, '^[a-z0-9]+( [a-z0-9]+)?$')
    OR split_part(term, ' ', 1) = split_part(term, ' ', 2) AS irregular FROM vocab_v""")
block("run_v", r"""
SELECT post_id, topic, pos, regexp_extract(piece, '^[\p{L}\p{N}_]+') AS run, piece
FROM (SELECT post_id, topic, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pos
  FROM (SELECT post_id, topic, regexp_extract_all(lower(content), '[\p{L}\p{N}_]+[^\p{L}\p{N}_]*') AS ps FROM posts_v) s) u""")
block("literal_v", r"""
SELECT post_id, topic, term, count(*) AS literal FROM (
  SELECT post_id, topic, run AS term FROM run_v
  UNION ALL SELECT post_id, topic, term FROM (
    SELECT post_id, topic, CASE WHEN piece = run || ' ' THEN run || ' ' || lead(run) OVER (PARTITION BY post_id ORDER BY pos) END AS term
    FROM run_v) b WHERE term IS NOT NULL) o
JOIN vocabkind_v USING (topic, term) WHERE NOT irregular GROUP BY 1, 2, 3
UNION ALL
SELECT post_id, topic, term, len(regexp_extract_all(
    '  ' || regexp_replace(lower(content), '([^\p{L}\p{N}_])', '\1\1', 'g') || '  ',
    '[^\p{L}\p{N}_]' || regexp_replace(term, '([^\p{L}\p{N}_])', '\1\1', 'g') || '[^\p{L}\p{N}_]')) AS literal
FROM posts_v JOIN vocabkind_v USING (topic) WHERE irregular AND contains(lower(content), term)""")
block("counts_v", """
SELECT topic, post_id, term, CAST(sum(tf) AS BIGINT) AS tf, CAST(sum(literal) AS BIGINT) AS literal FROM (
  SELECT topic, post_id, term, count(*) AS tf, 0 AS literal FROM termocc_v JOIN vocab_v USING (topic, term) GROUP BY 1, 2, 3
  UNION ALL SELECT topic, post_id, term, 0, literal FROM literal_v WHERE literal > 0) u GROUP BY 1, 2, 3""")
block("sizes_v", "SELECT topic, count(*) AS n_docs FROM posts_v GROUP BY 1")
block("stats_v", """
SELECT *, ln(CAST(1 + n_docs AS DOUBLE) / (1 + df)) + 1 AS idf FROM (
  SELECT topic, term, count(*) FILTER (tf > 0) AS df, CAST(sum(literal) AS BIGINT) AS frequency FROM counts_v GROUP BY 1, 2) a
JOIN sizes_v USING (topic)""")
block("weights_v", """
SELECT topic, post_id, term, tf, literal, CASE WHEN norm > 0 THEN raw / norm ELSE 0.0 END AS weight FROM (
  SELECT *, sqrt(sum(raw * raw) OVER (PARTITION BY topic, post_id)) AS norm FROM (
    SELECT c.*, tf * idf AS raw FROM counts_v c JOIN stats_v USING (topic, term)) r) n""")


def low_signal(term: str) -> str:
    parts = f"string_split({term}, ' ')"
    return (
        f"(length({term}) < 3 OR regexp_matches({term}, '^[0-9]+$')"
        f" OR len(list_filter({parts}, lambda t: t IN ({quoted(w.LOW_SIGNAL_TERMS)}) OR length(t) < 3)) > 0"
        f" OR len(list_filter({parts}, lambda t: t NOT IN (@STOP_WORDS@))) = 0)"
    )


block("lowsignal_v", f"SELECT DISTINCT term, {low_signal('term')} AS low FROM vocab_v")
block("scored_v", """
SELECT *, 0.65 * (mean_weight / greatest(max(mean_weight) OVER (PARTITION BY topic), 1e-9))
   + 0.35 * (frequency / greatest(CAST(max(frequency) OVER (PARTITION BY topic) AS DOUBLE), 1.0)) AS combined
FROM (SELECT s.topic, s.term, s.frequency, s.n_docs, s.df, s.idf, ws / n_docs AS mean_weight FROM stats_v s
  JOIN (SELECT topic, term, sum(weight) AS ws FROM weights_v GROUP BY 1, 2) w USING (topic, term)) m""")
block("keywords_v", """
SELECT topic, rank, term AS keyword, round(mean_weight, 5) AS tfidf_score, frequency, round(combined, 5) AS score FROM (
  SELECT s.*, row_number() OVER (PARTITION BY topic ORDER BY round(combined, 10) DESC, s.term) AS rank
  FROM scored_v s JOIN lowsignal_v USING (term) WHERE NOT low) k WHERE rank <= 40""")
block("dockw_rank_v", """
SELECT topic, post_id, term, weight, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY topic, post_id ORDER BY round(weight, 10) DESC, term) AS rank
  FROM weights_v WHERE weight > 0) k WHERE rank <= 8""")
block("dockw_v", """
SELECT topic, post_id, list(term ORDER BY rank) AS keywords
FROM dockw_rank_v JOIN lowsignal_v USING (term) WHERE NOT low GROUP BY 1, 2""")

# ---- engagement --------------------------------------------------------------

block("kind_v", """
SELECT *, CASE WHEN kind = 'news' THEN 0.8 WHEN kind = 'blog' THEN 0.5 ELSE 0.3 END::DOUBLE AS source_weight FROM (
  SELECT *, CASE WHEN source = 'newsapi' OR regexp_matches(host, 'news|reuters|techcrunch|forbes|wsj|bbc|cnn') THEN 'news'
    WHEN regexp_matches(host, 'blog|medium|substack|wordpress') THEN 'blog' ELSE 'unknown' END AS kind
  FROM (SELECT *, lower(regexp_extract(url, '^[a-zA-Z][^:]*://([^/?#]*)', 1)) AS host FROM posts_v) h) k""")
block("hits_v", """
SELECT post_id, topic, keyword, score, rank <= 10 AND score >= 0.3 AS important,
  (length(lower(content)) - length(replace(lower(content), keyword, ''))) // length(keyword) AS hits
FROM posts_v JOIN keywords_v USING (topic) WHERE contains(lower(content), keyword)""")
block("textscore_v", r"""
SELECT post_id, topic, CASE WHEN words = 0 THEN 0.0::DOUBLE ELSE 100.0 * (0.5 * (least(words, 400) / 400.0::DOUBLE)
  + 0.3 * (least(weighted / words, 0.12::DOUBLE) / 0.12) + 0.2 * least(important / CAST(greatest(n_important, 1) AS DOUBLE), 1.0)) END AS text_score
FROM (SELECT p.post_id, p.topic, len(regexp_extract_all(lower(p.content), '[a-z0-9\-]+')) AS words,
    coalesce(h.weighted, 0.0::DOUBLE) AS weighted, coalesce(h.important, 0) AS important, coalesce(i.n_important, 0) AS n_important
  FROM posts_v p LEFT JOIN (SELECT post_id, sum(hits * score) AS weighted, count(*) FILTER (important) AS important
      FROM hits_v GROUP BY 1) h ON h.post_id = p.post_id
  LEFT JOIN (SELECT topic, count(*) AS n_important FROM keywords_v WHERE rank <= 10 AND score >= 0.3 GROUP BY 1) i ON i.topic = p.topic) s""")
block("rawscore_v", """
SELECT k.*, text_score * (0.7 + source_weight) + least((likes + comments + shares) / 500.0::DOUBLE, 1.0) * 30.0 AS raw_score
FROM kind_v k JOIN (SELECT post_id, text_score FROM textscore_v) t USING (post_id)""")
block("postscore_v", """
SELECT *, round(CASE WHEN high - low < 1e-9 THEN CASE WHEN raw_score > 0 THEN 100.0 ELSE 0.0 END
   ELSE (raw_score - low) / (high - low) * 100.0 END, 2) AS engagement_score
FROM (SELECT *, min(raw_score) OVER (PARTITION BY topic) AS low, max(raw_score) OVER (PARTITION BY topic) AS high FROM rawscore_v) r""")

# ---- trends over an assignment of posts to clusters (here: their source) ------

block("assign_v", "SELECT topic, post_id, source AS cluster FROM posts_v")
block("clusterkw_v", """
SELECT topic, cluster, term, mean_weight, frequency, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY topic, cluster ORDER BY round(mean_weight, 10) DESC, term) AS rank FROM (
    SELECT w.topic, cluster, w.term, sum(weight) / any_value(members) AS mean_weight, CAST(sum(literal) AS BIGINT) AS frequency
    FROM weights_v w JOIN assign_v USING (topic, post_id)
    JOIN (SELECT topic, cluster, count(*) AS members FROM assign_v GROUP BY 1, 2) s USING (topic, cluster)
    GROUP BY 1, 2, 3) m JOIN lowsignal_v USING (term) WHERE NOT low AND frequency > 0) r WHERE rank <= 8""")


def label_tokens(keyword: str) -> str:
    return (
        f"list_slice(list_filter(string_split(lower({keyword}), ' '), lambda t: t NOT IN (@LABEL_DROPPED@)"
        " AND length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$')), 1, 3)"
    )


def cluster_label(tokens: str) -> str:
    title = (
        f"lambda t: CASE WHEN t IN ({quoted(w.LABEL_ACRONYMS)}) THEN upper(t)"
        " ELSE upper(substring(t, 1, 1)) || substring(t, 2) END"
    )
    return f"coalesce(nullif(array_to_string(list_transform({tokens}, {title}), ' '), ''), 'Emerging Topic')"


def label_block(source: str, keys: str, order: str) -> str:
    """Labels per group: the first four distinct label tokens in keyword order."""
    return f"""
SELECT {keys}, {cluster_label('list(tok ORDER BY place)')} AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY place) AS r FROM (
    SELECT {keys}, tok, min({order} * 100 + pos) AS place FROM (
      SELECT {keys}, {order}, unnest(lt) AS tok, generate_subscripts(lt, 1) AS pos
      FROM (SELECT *, {label_tokens('term')} AS lt FROM {source}) s) u GROUP BY {keys}, tok) g) q WHERE r <= 4 GROUP BY {keys}"""


block("clusterlabel_v", label_block("clusterkw_v", "topic, cluster", "rank"))
block("clustertrend_v", """
SELECT t.topic, t.cluster, coalesce(label, 'Emerging Topic') AS label, keywords, score,
  row_number() OVER (PARTITION BY t.topic ORDER BY score DESC, t.cluster) AS trend_rank FROM (
  SELECT topic, cluster, list(term ORDER BY rank) AS keywords, round(avg(mean_weight) * sum(frequency), 5) AS score
  FROM clusterkw_v GROUP BY 1, 2) t LEFT JOIN clusterlabel_v l ON l.topic = t.topic AND l.cluster = t.cluster""")


# ---- the full analysis: gate in a first pass, everything else over the survivors -----


def two_pass(body: str, posts: str | None = None, blocks: dict[str, str] | None = None) -> str:
    """``body`` over the posts that survive the engagement gate; ``blocks`` replaces blocks of the second pass.

    The blocks of the first pass get a suffix; the second pass reads its posts and their
    scores from the first.
    """
    first = dict(BLOCKS)
    if posts:
        first["posts_v"] = posts
    names = sorted(first, key=len, reverse=True)
    pattern = re.compile(r"\b(" + "|".join(names) + r")\b")
    earlier = {f"{n}_1": pattern.sub(lambda m: m.group(1) + "_1", sql) for n, sql in first.items()}
    later = {
        "posts_v": "SELECT post_id, topic, query, source, content, url, collected_at, likes, comments, shares, engagement_score"
        " FROM postscore_v_1 WHERE engagement_score >= 5.0 OR (source = 'linkedin' AND likes + comments + shares > 0)",
        "postscore_v": "SELECT * FROM posts_v",
        **(blocks or {}),
    }
    return oracle(body, {**earlier, **later})

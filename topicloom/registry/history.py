"""Run history, usage logs, caches, trend evolution and opportunities."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import text
from topicloom.operators import evolution, explore, history, reports
from topicloom.operators.ranking import in_order
from topicloom.registry.base import query
from topicloom.registry.posts import as_of, stamp
from topicloom.session import new_folder, stage
from topicloom.sources import store

def cache_as_of():
    return F.to_timestamp_ntz(F.lit("1998-06-30 00:00:00"))


def _ts(c: str = "captured_at") -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


# ---- runs --------------------------------------------------------------------

LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY captured_at DESC, id) AS r FROM runs_v) q WHERE r = 1) latest"


@query("wn1_latest_runs", f"SELECT topic, id, {_ts()}, sources_count FROM {LATEST}")
def wn1(t):
    return history.latest_runs(t.runs()).select("topic", "id", stamp("captured_at").alias("captured_at"), "sources_count")


@query("wn1_recent_topics", f"SELECT topic, {_ts()}, sources_count FROM (SELECT * FROM {LATEST} ORDER BY captured_at DESC, topic LIMIT 25) x")
def wn1_recent(t):
    return history.recent_topics(t.runs()).select("topic", stamp("captured_at").alias("captured_at"), "sources_count")


@query("wn1_recent_topics_by_name", f"SELECT topic, {_ts()}, sources_count FROM (SELECT * FROM {LATEST} ORDER BY topic LIMIT 25) x")
def wn1_name(t):
    rows = history.recent_topics(t.runs(), by_name=True)
    return rows.select("topic", stamp("captured_at").alias("captured_at"), "sources_count")


@query(
    "wn2_previous_snapshot",
    """SELECT id, topic, lag(first_label) OVER (PARTITION BY topic ORDER BY captured_at, id) AS previous_label,
      lag(n) OVER (PARTITION BY topic ORDER BY captured_at, id) AS previous_trends
    FROM (SELECT id, topic, captured_at, min_by(label, trend_rank) AS first_label, count(*) AS n FROM lines_v GROUP BY 1, 2, 3) r""",
)
def wn2(t):
    runs = evolution.previous_snapshot(stage(t.run_history(), "runs"))  # read twice
    return runs.select(
        "id",
        "topic",
        F.get("previous", F.lit(0))["label"].alias("previous_label"),
        F.when(F.col("previous").isNotNull(), F.size("previous")).alias("previous_trends"),
    )


@query("wn8_last_runs", "SELECT topic, id, back FROM (SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY captured_at DESC, id DESC) AS back FROM runs_v) q WHERE back <= 10")
def wn8(t):
    return history.last_runs(t.runs(counts=False)).select("topic", "id", "back")


@query("tk8_runs_of_topic", f"SELECT id, {_ts()}, sources_count FROM (SELECT * FROM runs_v WHERE topic = 'topic-7' ORDER BY captured_at DESC, id LIMIT 10) q")
def tk8(t):
    return history.runs_of_topic(t.runs(), "topic-7").select("id", stamp("captured_at").alias("captured_at"), "sources_count")


@query(
    "fl9_topic_and_window",
    "SELECT 'run' AS kind, id FROM runs_v WHERE topic = 'topic-7' UNION ALL SELECT 'call', id FROM api_usage_v WHERE logged_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS",
)
def fl9(t):
    """From the stores: runs by a pushed topic, calls by their month's folder."""
    runs, calls = new_folder(t.spark, "runs"), new_folder(t.spark, "usage")
    store.append_runs(t.runs(counts=False), runs)
    store.append_usage(t.api_usage(), calls)
    of_topic = store.read_runs(t.spark, runs).where("topic = 'topic-7'").select(F.lit("run").alias("kind"), "id")
    recent = store.since(store.read_usage(t.spark, calls), "logged_at", as_of() - F.expr("INTERVAL 7 DAYS"))
    return of_topic.unionByName(recent.select(F.lit("call").alias("kind"), "id"))


@query(
    "fl9_runs_in_windows",
    """SELECT id, topic FROM runs_v JOIN (SELECT 'topic-' || c_custkey AS topic, TIMESTAMP '1996-01-15' + to_days(CAST(c_custkey % 40 AS INTEGER)) AS since
      FROM customer WHERE c_custkey % 3 = 0) w USING (topic) WHERE captured_at >= since AND captured_at <= since + INTERVAL 60 DAYS""",
)
def fl9_windows(t):
    """Runs of a third of the customers' topics, each in sixty days of its own."""
    path = new_folder(t.spark, "runs")
    store.append_runs(t.runs(counts=False), path)
    start = F.to_timestamp_ntz(F.lit("1996-01-15 00:00:00")) + F.expr("make_dt_interval(cast(c_custkey % 40 as int))")
    windows = t.read("customer").where("c_custkey % 3 = 0").select(
        F.concat(F.lit("topic-"), F.col("c_custkey").cast("string")).alias("topic"), start.alias("since")
    )
    windows = windows.withColumn("until", F.col("since") + F.expr("INTERVAL 60 DAYS"))
    return store.runs_in_windows(store.read_runs(t.spark, path), windows).select("id", "topic")


@query(
    "ag11_topic_history",
    f"SELECT topic, strftime(max(captured_at), '%Y-%m-%d %H:%M:%S') AS last_run_at, count(*) AS total_runs, round(avg(elapsed_secs), 6) AS avg_elapsed FROM runs_v GROUP BY 1",
)
def ag11(t):
    """History of earlier runs merged with that of later ones."""
    runs = t.runs(counts=False)
    old = history.topic_totals(runs.where("captured_at < timestamp_ntz'1998-01-01'"))
    new = history.topic_totals(runs.where("captured_at >= timestamp_ntz'1998-01-01'"))
    rows = history.topic_history(history.merge_totals(old, new))
    return rows.select(
        "topic", stamp("last_run_at").alias("last_run_at"), "total_runs", F.round("avg_elapsed", 6).alias("avg_elapsed")
    )


@query("ag12_total_runs", "SELECT count(*) AS total_runs FROM runs_v")
def ag12(t):
    return t.runs(counts=False).agg(F.count("*").alias("total_runs"))


@query(
    "ag19_score_history",
    """SELECT topic, back, trend_rank - 1 AS pos, least(100, CAST(round_even(score / max(score) OVER (PARTITION BY topic) * 90, 0) AS INT)) AS value
    FROM (SELECT * FROM (SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY captured_at DESC, id DESC) AS back
        FROM (SELECT DISTINCT topic, id, captured_at FROM lines_v) d) b WHERE back <= 10) r JOIN (SELECT id, trend_rank, score FROM lines_v) l USING (id)""",
)
def ag19(t):
    return history.score_history(t.run_history())


@query(
    "so2_merge_histories",
    f"""SELECT topic FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(topic)) ORDER BY side, ord, topic) AS r FROM (
      SELECT 0 AS side, topic, -epoch(captured_at) AS ord FROM {LATEST}
      UNION ALL SELECT 1, CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE ' Topic-' || c_custkey END, c_custkey FROM customer) u
      WHERE trim(topic) <> '') q WHERE r = 1 ORDER BY side, ord, topic LIMIT 25""",
)
def so2(t):
    server = history.latest_runs(t.runs(counts=False)).select(
        "topic", (-F.unix_timestamp(F.col("captured_at").cast("timestamp"))).alias("ord")
    )
    key = F.col("c_custkey")
    name = F.when(key % 5 == 0, "  ").otherwise(F.concat(F.lit(" Topic-"), key.cast("string")))
    local = t.read("customer").select(name.alias("topic"), key.alias("ord"))
    return history.merge_histories(server, local).select("topic")


LATEST_TRENDS_SQL = """SELECT lower(trim(topic)) AS topic_key, arg_max(n, (captured_at, id)) AS trends, arg_max(first_label, (captured_at, id)) AS first_label
    FROM (SELECT id, topic, captured_at, min_by(label, trend_rank) AS first_label, count(*) AS n FROM lines_v GROUP BY 1, 2, 3) r GROUP BY 1"""


def _flat_trends(latest):
    return latest.select("topic_key", F.size("trends").alias("trends"), F.get("trends", F.lit(0))["label"].alias("first_label"))


@query("src7_latest_history", LATEST_TRENDS_SQL)
def src7(t):
    return _flat_trends(history.latest_trends(t.run_history()))


def _bucketed(t, rows, name: str, key: str, *conditions: str):
    """(table, folder) of a bucketed table of its own, filled by one append per condition."""
    path = new_folder(t.spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    for condition in conditions:
        store.append_bucketed(rows.where(condition), table, path, key, "captured_at", buckets=8)
    return table, path


@query("src7_bucketed_history", LATEST_TRENDS_SQL)
def src7_bucketed(t):
    """Two appends to a store bucketed by topic, whose latest trends are read without an exchange."""
    runs = stage(t.run_history().withColumn("topic_key", text.topic_key(F.col("topic"))), "runs")
    early = "captured_at < timestamp_ntz'1998-01-01'"
    table, _ = _bucketed(t, runs, "runs", "topic_key", early, f"NOT {early}")
    return _flat_trends(history.latest_trends(t.spark.table(table)))


@query("snk1_append_runs", "SELECT strftime(captured_at, '%Y-%m') AS captured_month, count(DISTINCT id) AS runs, count(*) AS trends FROM lines_v GROUP BY 1")
def snk1(t):
    """Two appends, read back."""
    path = new_folder(t.spark, "runs")
    runs = t.run_history()
    store.append_runs(runs.where("captured_at < timestamp_ntz'1998-01-01'"), path)
    store.append_runs(runs.where("captured_at >= timestamp_ntz'1998-01-01'"), path)
    stored = store.read_runs(t.spark, path)
    return stored.groupBy(F.col("captured_month").cast("string").alias("captured_month")).agg(
        F.count("*").alias("runs"), F.sum(F.size("trends")).alias("trends")
    )


USAGE_SQL = """SELECT source, count(*) AS total_calls, round(avg(response_ms), 1) AS avg_response_ms,
  CAST(sum(record_count) AS BIGINT) AS total_records, count(*) FILTER (status_code >= 400) AS error_count
  FROM api_usage_v WHERE logged_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS GROUP BY 1"""


@query("snk2_append_usage", USAGE_SQL)
def snk2(t):
    """The log appended in two parts; the summary then reads the stored table."""
    path = new_folder(t.spark, "usage")
    log = t.api_usage()
    for part in (0, 1):
        store.append_usage(log.where(F.col("id") % 2 == part), path)
    return history.usage_summary(store.read_usage(t.spark, path), as_of())


@query("ag10_usage_summary", USAGE_SQL)
def ag10(t):
    return history.usage_summary(t.api_usage(), as_of())


@query(
    "tk10_usage_order",
    f"SELECT source, total_calls, row_number() OVER (ORDER BY total_calls DESC, source) AS position FROM ({USAGE_SQL}) u",
)
def tk10(t):
    usage = history.usage_summary(t.api_usage(), as_of()).select("source", "total_calls")
    return in_order(usage, history.usage_order())


SNAPSHOT_SQL = f"""SELECT key, {_ts()}, result FROM (SELECT s.*, row_number() OVER (PARTITION BY s.key ORDER BY captured_at DESC, id DESC) AS r
      FROM (SELECT 'tl:v1:' || substring(sha256(topic), 1, 24) AS key, id, captured_at, 'sources=' || sources_count AS result FROM runs_v) s
      LEFT JOIN (SELECT 'tl:v1:' || substring(sha256('topic-' || o_custkey), 1, 24) AS key, max(o_orderdate) AS deleted_at FROM orders
        WHERE o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1998-06-30' GROUP BY 1) x ON x.key = s.key
      WHERE captured_at > TIMESTAMP '1998-06-30' - INTERVAL 90 DAYS AND captured_at <= TIMESTAMP '1998-06-30'
        AND (deleted_at IS NULL OR captured_at > deleted_at)) q WHERE r = 1"""


@query("snk3_snapshot_cache", SNAPSHOT_SQL)
def snk3(t):
    path = new_folder(t.spark, "snapshots")
    store.append_snapshots(_snapshots(t), path)
    fresh = store.fresh_snapshots(t.spark.read.parquet(path), cache_as_of(), 90 * store.SNAPSHOT_TTL_SECONDS, _deleted(t))
    return fresh.select("key", stamp("captured_at").alias("captured_at"), "result")


def _snapshots(t):
    result = F.concat(F.lit("sources="), F.col("sources_count").cast("string"))
    return t.runs().select(text.fingerprint(F.col("topic")).alias("key"), "id", "captured_at", result.alias("result"))


def _deleted(t):
    name = F.concat(F.lit("topic-"), F.col("o_custkey").cast("string"))
    return t.read("orders").where("o_orderstatus = 'P'").select(text.fingerprint(name).alias("key"), F.col("o_orderdate").alias("deleted_at"))


@query("snk3_compacted", SNAPSHOT_SQL)
def snk3_compacted(t):
    """A bucketed snapshot store after two compactions holds what the cache would serve, and nothing else."""
    table, path = _bucketed(t, _snapshots(t), "snapshots", "key", "true")
    for _ in range(2):
        held = store.compact_snapshots(t.spark, table, path, cache_as_of(), 90 * store.SNAPSHOT_TTL_SECONDS, _deleted(t), buckets=8)
    return held.select("key", stamp("captured_at").alias("captured_at"), "result")


FRESH_SQL = """SELECT key, result FROM (SELECT 'tl:v1:' || substring(sha256(topic), 1, 24) AS key, 'sources=' || sources_count AS result,
    row_number() OVER (PARTITION BY topic ORDER BY captured_at DESC, id DESC) AS r FROM runs_v
    WHERE captured_at > TIMESTAMP '1998-06-30' - INTERVAL 90 DAYS AND captured_at <= TIMESTAMP '1998-06-30') s WHERE r = 1"""


@query(
    "snk3_lookup",
    f"""SELECT request, key, refresh, CASE WHEN refresh THEN NULL ELSE result END AS result, refresh OR result IS NULL AS compute FROM (
      SELECT 'topic-' || c_custkey AS request, 'tl:v1:' || substring(sha256('topic-' || c_custkey), 1, 24) AS key, c_custkey % 5 = 0 AS refresh FROM customer) q
    LEFT JOIN ({FRESH_SQL}) f USING (key)""",
)
def snk3_lookup(t):
    """Requests for every customer's topic against the cache; one in five asks for a refresh."""
    path = new_folder(t.spark, "snapshots")
    result = F.concat(F.lit("sources="), F.col("sources_count").cast("string"))
    store.append_snapshots(t.runs().select(text.fingerprint(F.col("topic")).alias("key"), "id", "captured_at", result.alias("result")), path)
    fresh = store.fresh_snapshots(t.spark.read.parquet(path), cache_as_of(), 90 * store.SNAPSHOT_TTL_SECONDS)
    name = F.concat(F.lit("topic-"), F.col("c_custkey").cast("string"))
    requests = t.read("customer").select(name.alias("request"), text.fingerprint(name).alias("key"), (F.col("c_custkey") % 5 == 0).alias("refresh"))
    found = store.lookup(requests, fresh)
    return found.select("request", "key", "refresh", "result", F.col("result").isNull().alias("compute"))


@query("cq3_history", f"""SELECT 'runs' AS report, topic AS name, sources_count AS n FROM (SELECT * FROM {LATEST} ORDER BY captured_at DESC, topic LIMIT 25) a
  UNION ALL SELECT 'usage', source, total_calls FROM ({USAGE_SQL}) b UNION ALL SELECT 'total', 'runs', count(*) FROM runs_v""")
def cq3(t):
    from topicloom.plans.reports import history_report

    return history_report(t.runs(), t.api_usage(), as_of())


# ---- evolution and opportunities ----------------------------------------------

from topicloom.registry.sqltext import block  # noqa: E402

block("pair_v", """
SELECT c.topic, c.label, c.trend_rank, c.score, p.label AS p_label, p.score AS p_score, p.trend_rank AS p_rank,
  len(list_intersect(c.keywords, p.keywords)) / CAST(len(list_distinct(list_concat(c.keywords, p.keywords))) AS DOUBLE) AS overlap
FROM trends_v c JOIN trends_v p ON p.topic = c.topic AND p.snapshot = 0 WHERE c.snapshot = 1""")
block("match_v", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic, label ORDER BY overlap DESC, p_rank) AS r FROM pair_v) q
WHERE r = 1 AND overlap >= 0.2""")
block("evolution_v", """
SELECT *, CASE WHEN p_label IS NULL THEN 'new' WHEN pct > 10 THEN 'rising' WHEN pct < -10 THEN 'falling' ELSE 'stable' END AS status,
  printf('%+.0f%%', pct) AS change, round_even(pct, 0) AS pct0 FROM (
  SELECT *, CASE WHEN before > 0 THEN (score - before) / before * 100.0 WHEN score > 0 THEN 100.0 ELSE 0.0 END AS pct FROM (
    SELECT c.topic, c.label, c.trend_rank, c.score, c.keywords, m.p_label, coalesce(m.p_score, 0.0) AS before
    FROM trends_v c LEFT JOIN match_v m ON m.topic = c.topic AND m.label = c.label WHERE c.snapshot = 1) a) b""")
block("unique_v", """
SELECT c.topic, c.label, CASE WHEN len(any_value(c.keywords)) = 0 THEN 1.0 ELSE greatest(0.6, 1.4 - coalesce(avg(
  len(list_intersect(c.keywords, o.keywords)) / CAST(len(list_distinct(list_concat(c.keywords, o.keywords))) AS DOUBLE)), 0)) END AS uniqueness
FROM trends_v c LEFT JOIN trends_v o ON o.topic = c.topic AND o.snapshot = 1 AND o.label <> c.label WHERE c.snapshot = 1 GROUP BY 1, 2""")
block("opportunity_v", """
SELECT *, CASE WHEN top > 0 THEN round(raw / top * 10.0, 2) ELSE 0.0 END AS opportunity_score,
  CASE WHEN growth >= 1.3 AND uniqueness >= 1.1 THEN 'high growth + low competition' WHEN growth >= 1.2 THEN 'strong growth signal'
    WHEN uniqueness >= 1.15 THEN 'distinct cluster with limited overlap' ELSE 'solid trend strength with moderate competition' END AS reason
FROM (SELECT *, max(raw) OVER (PARTITION BY topic) AS top FROM (
  SELECT *, score * growth * uniqueness AS raw FROM (
    SELECT e.*, u.uniqueness, CASE status WHEN 'new' THEN 1.35 WHEN 'rising' THEN 1.0 + greatest(pct0, 0) / 100.0
      WHEN 'falling' THEN greatest(0.5, 1.0 + pct0 / 100.0) ELSE 1.0 END::DOUBLE AS growth
    FROM evolution_v e JOIN unique_v u ON u.topic = e.topic AND u.label = e.label) g) r) s""")


def _scored(t):
    return evolution.score_opportunities(evolution.trend_evolution(t.trend_pairs()))


@query("jn3_best_previous", "SELECT c.topic, c.label, m.p_score AS previous_score, round(m.overlap, 6) AS overlap FROM trends_v c LEFT JOIN match_v m ON m.topic = c.topic AND m.label = c.label WHERE c.snapshot = 1")
def jn3(t):
    pairs = t.trend_pairs().select("topic", "previous", F.inline("trends"))
    match = evolution.best_previous(F.col("keywords"), F.col("previous"))
    return pairs.withColumn("m", match).select(
        "topic", "label", F.col("m.score").alias("previous_score"), F.round("m.overlap", 6).alias("overlap")
    )


@query("jn4_uniqueness", "SELECT topic, label, round(uniqueness, 6) AS uniqueness FROM unique_v")
def jn4(t):
    values = F.transform(
        "trends", lambda x: F.struct(x["label"], evolution.uniqueness(x, F.col("trends")).alias("uniqueness"))
    )
    return t.trend_pairs().select("topic", F.inline(values)).select("topic", "label", F.round("uniqueness", 6).alias("uniqueness"))


@query("so3_keyword_sets", """SELECT c.topic, c.label, p.label AS other, len(list_intersect(c.keywords, p.keywords)) AS both,
  len(list_distinct(list_concat(c.keywords, p.keywords))) AS either FROM trends_v c JOIN trends_v p ON p.topic = c.topic AND p.trend_rank = c.trend_rank + 1
  WHERE c.snapshot = 1 AND p.snapshot = 1""")
def so3(t):
    """Each trend against the next in rank."""
    return t.trend_pairs().select("topic", F.inline(evolution.next_in_rank(F.col("trends"))))


@query(
    "ag18_trend_evolution",
    "SELECT topic, label AS trend, round(before, 2) AS previous_score, round(score, 2) AS current_score, change, status FROM evolution_v",
)
def ag18(t):
    return evolution.trend_evolution(t.trend_pairs()).select("topic", F.inline("evolution")).drop("pct")


@query("jn1_evolution_of_trend", "SELECT topic, label, change, status FROM evolution_v")
def jn1(t):
    """Trends joined with the last evolution row of their label."""
    runs = evolution.trend_evolution(t.trend_pairs())
    found = F.transform(
        "trends", lambda x: F.struct(x["label"].alias("label"), evolution.evolution_by_label(x["label"], F.col("evolution")).alias("e"))
    )
    return runs.select("topic", F.inline(found)).select("topic", "label", "e.change", "e.status")


@query("ag17_opportunities", "SELECT topic, label AS trend, opportunity_score, reason FROM opportunity_v")
def ag17(t):
    return _scored(t).select("topic", F.inline("opportunities"))


@query("tk6_opportunity_order", "SELECT topic, label AS trend, row_number() OVER (PARTITION BY topic ORDER BY opportunity_score DESC, trend_rank) AS place FROM opportunity_v")
def tk6(t):
    rows = _scored(t).select("topic", F.posexplode("opportunities").alias("pos", "o"))
    return rows.select("topic", "o.trend", (F.col("pos") + 1).alias("place"))


@query("tk11_trend_sublists", """SELECT topic, n, string_agg(label, ', ' ORDER BY trend_rank) AS labels FROM trends_v, (VALUES (3), (4), (5), (6), (8)) s(n)
  WHERE snapshot = 1 AND trend_rank <= n GROUP BY 1, 2""")
def tk11(t):
    lists = F.transform(
        F.array(*[F.lit(n) for n in (3, 4, 5, 6, 8)]),
        lambda n: F.struct(n.alias("n"), F.concat_ws(", ", F.transform(F.slice("trends", 1, n), lambda x: x["label"])).alias("labels")),
    )
    return t.trend_pairs().select("topic", F.inline(lists))


@query("sc28_percent_text", "SELECT topic, label, change, printf('%.2f', round(score, 2)) AS score_text FROM evolution_v")
def sc28(t):
    rows = evolution.trend_evolution(t.trend_pairs()).select("topic", F.arrays_zip("trends", "evolution").alias("z"))
    return rows.select("topic", F.explode("z").alias("z")).select(
        "topic", F.col("z.trends.label").alias("label"), F.col("z.evolution.change").alias("change"),
        text.decimal_text(F.col("z.trends.score")).alias("score_text"),
    )


@query("sc27_trend_shares", "SELECT topic, label, round(score / greatest(max(score) OVER (PARTITION BY topic), 1.0) * 100, 1) AS share FROM trends_v WHERE snapshot = 1")
def sc27(t):
    return t.trend_pairs().select("topic", F.inline(explore.trend_shares(F.col("trends"))))


_KW = "coalesce(nullif(array_to_string(list_slice(keywords, 1, 5), ', '), ''), '—')"


@query(
    "snk5_report_rows",
    f"""SELECT topic, 'report' AS section, trend_rank AS rank, label || '  (score: ' || printf('%.2f', round(score, 2)) || ')  —  ' || {_KW} AS line FROM trends_v WHERE snapshot = 1 AND trend_rank <= 8
    UNION ALL SELECT topic, 'digest', trend_rank, label || ' ' || printf('%.2f', round(score, 2)) FROM trends_v WHERE snapshot = 1 AND trend_rank <= 5
    UNION ALL SELECT topic, 'alert', trend_rank, '• *' || label || '* (score ' || printf('%.2f', round(score, 2)) || ')' FROM trends_v WHERE snapshot = 1 AND trend_rank <= 3""",
)
def snk5(t):
    return reports.report_rows(t.trend_pairs())

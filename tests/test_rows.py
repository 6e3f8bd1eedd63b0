"""Validation, payloads, series, jobs, routing, explore, reports, caches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from topicloom.functions import lenient, payload, text, topics
from topicloom.functions.chunking import chunk_rows, chunks, pieces
from topicloom.functions.scoring import source_type
from topicloom.operators import collect, explore, history, insights, jobs, reports, series, validation
from topicloom.sources import landed, store

POST = "post_id long, content string, url string, source string, likes long, comments long, shares long, collected_at timestamp_ntz"


def test_validation(spark):
    rows = [
        (1, " a \n", "u1", "s", None, 2, None, None),
        (2, "a", "u1", "s", 0, 0, 0, None),
        (3, "a", "u2", "s", 5000, 0, 0, None),
        (4, " \t", "u3", "s", 0, 0, 0, None),
        (5, "b", "  ", "s", 0, 0, 0, None),
        (6, None, None, None, 0, 0, 0, None),
    ]
    df = spark.createDataFrame(rows, POST)
    good = validation.validate_posts(df, "post_id", F.to_timestamp_ntz(F.lit("2024-01-01"))).orderBy("post_id").collect()
    assert [(r.post_id, r.content, r.engagement_score) for r in good] == [(1, "a", 0.2), (3, "a", 100.0)]
    assert good[0].collected_at == dt.datetime(2024, 1, 1)
    bad = {r.post_id: r.reason for r in validation.rejected_posts(df).collect()}
    assert bad == {4: "empty content", 5: "missing url", 6: "empty content"}
    # The collector's hash covers the content only; doing it twice changes nothing.
    once = validation.deduplicate(df.where("post_id < 4").withColumn("content", text.strip(F.col("content"))), ["content"], "post_id")
    assert [r.post_id for r in once.collect()] == [1]
    assert validation.deduplicate(once, ["content"], "post_id").count() == 1


@pytest.mark.parametrize(
    "value,want",
    [
        ("1700000000", "2023-11-14 22:13:20"),
        ("1700000000000", "2023-11-14 22:13:20"),
        (" 1700000000 ", "2023-11-14 22:13:20"),
        ("2024-01-01T00:00:00Z", "2024-01-01 00:00:00"),
        ("2024-01-01T00:00:00+02:00", "2023-12-31 22:00:00"),
        ("2024-01-01T05:06:07", "2024-01-01 05:06:07"),
        ("junk", None),
        ("12:30", None),
        ("", None),
        (None, None),
        ("99999999999999999999", None),
    ],
)
def test_parse_time(spark, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(F.date_format(payload.parse_time(F.col("v")), "yyyy-MM-dd HH:mm:ss").alias("t")).first().t == want


@pytest.mark.parametrize(
    "json,want",
    [
        ('{"stats": {"numReactions": 5, "commentCount": "7"}, "shareCount": "3"}', (5, 7, 3)),
        ('{"likes": 0, "reactions": {"LIKE": 2, "LOVE": "3", "note": "x"}}', (5, 0, 0)),
        ('{"likes": -4, "comments": 2.9, "reposts": " 6 "}', (0, 2, 6)),
        ('{"engagement": {"likeComments": 4, "comments": 9}}', (4, 9, 0)),
        ('{"counts": {"likes": 1}, "likes": 50, "likedComments": 8}', (1, 8, 0)),
        ("{}", (0, 0, 0)),
    ],
)
def test_engagement_counts(spark, json, want):
    df = spark.createDataFrame([(json,)], "j string").select(payload.as_map(F.col("j")).alias("p"))
    assert tuple(df.select(payload.engagement_counts(F.col("p")).alias("e")).first().e) == want


@pytest.mark.parametrize(
    "json,want",
    [
        ('{"stats": {"liked": true, "commentCount": "7", "shares": 3.9}}', (1, 7, 3)),
        ('{"stats": {"likes": "3.7", "comments": false, "reposts": null}}', (0, 0, 0)),
        ('{"counts": {"likes": [1], "reactions": " +4 ", "comments": {"a": 1}}}', (4, 0, 0)),
        ('{"likes": true, "comments": "2.5", "shares": " 6 "}', (1, 0, 6)),
        ('{"likes": {"a": true, "b": "2", "c": 2.9, "d": "2.5", "e": " 3", "f": null, "g": [9]}, "comments": 2.9}', (5, 2, 0)),
        ('{"zLikes": 1, "aLikes": 2, "likes": -5, "comments": 12345678901}', (1, 12345678901, 0)),
        ('{"stats": "x", "counts": {}, "likes": "", "shares": null}', (0, 0, 0)),
        ("{}", (0, 0, 0)),
    ],
)
def test_engagement_counts_by_json_type(spark, json, want):
    df = spark.createDataFrame([(json,)], "j string")
    counts = payload.typed_engagement_counts(payload.as_map(F.col("j")), F.col("j"))
    assert tuple(df.select(counts.alias("e")).first().e) == want


def test_forecast_and_summary(spark):
    day = dt.date(2024, 1, 1)
    rows = [("a", day + dt.timedelta(weeks=i), 10 + 2 * i) for i in range(30)]
    rows += [("short", day, 5), ("short", day + dt.timedelta(weeks=1), 6), ("short", day + dt.timedelta(weeks=2), 7)]
    rows += [("flat", day + dt.timedelta(weeks=i), 7) for i in range(4)]
    df = spark.createDataFrame(rows, "topic string, dt date, value int")
    ahead = {(r.topic, r.step): (r.value, r.dt) for r in series.forecast(df).collect()}
    assert [ahead["a", s][0] for s in (1, 2, 15, 16, 17, 52)] == [70, 72, 98, 100, 100, 100]
    assert ahead["a", 1][1] == day + dt.timedelta(weeks=30)
    assert ahead["flat", 52][0] == 7 and ("short", 1) not in ahead
    info = {r.topic: r for r in series.summarise(df).collect()}
    assert (info["a"].avg_last_3m, info["a"].trend_direction, info["a"].peak_year) == (56, "rising", "2024")
    assert info["short"].trend_direction == "stable"


def test_jobs(spark):
    rows = [(0, "", "B", ""), (1, "Paris", "A", ""), (2, "Oslo", "A", "9k"), (3, "Oslo", "B", "8k"), (4, "Paris", "", "")]
    df = spark.createDataFrame([("t", *r) for r in rows], "topic string, pos long, location string, company string, salary string")
    r = jobs.summarise_jobs(df).first()
    assert (r.total_count, r.top_locations, r.top_companies, r.salary_range) == (5, ["Paris", "Oslo"], ["B", "A"], "9k")
    assert jobs.summarise_jobs(df.withColumn("salary", F.lit(""))).first().salary_range is None


def test_chunks(spark):
    exact, over = "x" * 1990, "x" * 1991
    sentences = "One sentence. " * 200
    df = spark.createDataFrame([(exact,), (over,), (sentences,), ("",), (None,)], "t string")
    got = [r.c for r in df.select(chunks("t").alias("c")).collect()]
    assert got[0] == [exact] and got[1] == ["x" * 1990, "x"] and got[3] == [""] and got[4] is None
    assert all(len(c) <= 1990 and c.endswith(".") for c in got[2]) and len(got[2]) == 2
    assert " ".join(got[2]) == sentences.strip()


def cut_by_copying(text, cap):
    found, rest = [], text
    while len(rest) > cap:
        stop = rest[:cap].rfind(". ")
        end = stop + 1 if stop >= 0 else cap
        found.append(rest[:end].strip())
        rest = rest[end:].strip()
    return found + [rest] if rest or not found else found


def test_pieces_are_those_of_cutting_the_rest_again_and_again():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("ab. \n\u3000") for _ in range(rng.randrange(60)))
        assert list(pieces(text, 7)) == cut_by_copying(text, 7)


def test_a_long_text_is_cut_in_linear_time(spark):
    text = "One sentence of many. " * 1_500_000  # 33 MB
    found = chunk_rows(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string"), "id", "t")
    got = found.groupBy("id").agg(F.count("*").alias("n"), F.max("chunk").alias("last"), F.sum(F.length("piece")).alias("size")).collect()
    sizes = {r.id: (r.n, r.size) for r in got}
    assert sizes.keys() == {1, 3} and sizes[3] == (1, 0)
    assert sizes[1][0] == got[[r.id for r in got].index(1)].last == 1_500_000 // 90 + 1


def test_landed_lines_and_their_quarantine(spark, tmp_path):
    at = '"collected_at": "2024-01-01T00:00:00"'
    lines = [
        f'{{"query": "q", "source": "s", "content": " a ", "url": "u", {at}, "other": 1}}',
        '{"query": "q"', "not json", "[1]", "", "{}", f'{{"query": "q", "source": "s", "content": "a", {at}}}',
        f'{{"query": "q", "source": "s", "content": " ", "url": "u", {at}}}',
        f'{{"query": "q", "source": "s", "content": "a", "url": "u", {at}, "metadata": {{"likes": "x"}}}}',
    ]
    (tmp_path / "a.json").write_text("\n".join(lines))
    judged = landed.read_landed(spark, str(tmp_path))
    assert [(r.query, r.content, r.url) for r in landed.accepted(judged).collect()] == [("q", "a", "u")]
    bad = {r.line: r.reason for r in landed.quarantined(judged).collect()}
    assert bad == {lines[1]: "malformed", lines[2]: "malformed", lines[3]: "malformed", "": "malformed", "{}": "malformed",
                   lines[6]: "missing url", lines[7]: "empty content", lines[8]: "malformed"}


def test_topics(spark):
    rows = ["x", "future robots", " Artificial   Intelligence ", "one two three four", "solar cells", "HR"]
    df = spark.createDataFrame([(r,) for r in rows], "topic string")
    got = [(r.query_type, r.suggestions[:1]) for r in df.select(*topics.classify_topic(F.col("topic"))).collect()]
    assert got == [
        ("broad", ["x industry trends"]),
        ("vague", ["future robots industry trends"]),
        ("broad", ["AI productivity tools"]),
        ("niche", []),
        ("niche", []),
        ("broad", ["talent acquisition trends"]),
    ]


def test_source_types(spark):
    rows = [("newsapi", "http://x.y"), ("a", "https://User@Blog.News.com:80/p"), ("a", "https://my.medium.com"), ("a", "https://x.com/news"), ("a", "nohost")]
    df = spark.createDataFrame(rows, "s string, u string")
    assert [r.k for r in df.select(source_type(F.col("s"), F.col("u")).alias("k")).collect()] == ["news", "news", "blog", "unknown", "unknown"]


def test_lenient_lists(spark):
    rows = ['```json\n["a", "b"]\n```', 'Use "alpha beta" or "x"', "nothing", '["a", 1]', "[]"]
    df = spark.createDataFrame([(r,) for r in rows], "raw string")
    got = [r.l for r in df.select(lenient.string_list(F.col("raw"), F.lit("T")).alias("l")).collect()]
    assert got[0] == ["a", "b"] and got[1] == ["alpha beta"] and got[4] == []
    assert len(got[2]) == 4 and got[2][0] == "T latest trends 2026" and got[3] == got[2]


def test_lenient_insights(spark):
    rows = ['{"summary": "s", "key_takeaways": ["k"], "opportunities": []}', '{"summary": "s"}', "no json"]
    df = spark.createDataFrame([(r,) for r in rows], "raw string")
    got = [r.i for r in df.select(lenient.insight(F.col("raw"), F.lit("T")).alias("i")).collect()]
    assert (got[0].summary, got[0].confidence) == ("s", 0.0)
    assert got[1].confidence == got[2].confidence == 0.4


def test_routing_caps_and_fallbacks(spark):
    queries = collect.expand_queries(spark.createDataFrame([("ai",)], "topic string"))
    items = spark.createDataFrame([(1, "ai", "ai technology innovations"), (2, "ai", "ai market"), (3, "ai", "zzz")], "post_id long, topic string, tag string")
    got = {r.post_id: r.query for r in collect.route_items(items, queries).collect()}
    assert got == {1: "ai technology innovations", 2: "ai market growth and key players", 3: "ai latest trends 2026"}
    many = spark.range(60).select(F.col("id").alias("post_id"), F.lit("ai").alias("topic"), F.expr("'ai technology innovations'").alias("query"))
    assert collect.cap_per_query(many, queries, 25, "post_id").count() == 7
    web = spark.createDataFrame([("q1",)] * 10 + [("q2",)] * 2, "query string").withColumn("s", F.lit("web"))
    news = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "query string").withColumn("s", F.lit("news"))
    last = spark.createDataFrame([("q3",), ("q4",)], "query string").withColumn("s", F.lit("last"))
    names = spark.createDataFrame([("q1",), ("q2",), ("q3",), ("q4",), ("q5",)], "query string")
    found = collect.with_fallbacks(names, web, news, last).groupBy("query", "s").count().collect()
    assert {(r.query, r.s): r["count"] for r in found} == {("q1", "web"): 10, ("q2", "web"): 2, ("q2", "news"): 1, ("q3", "news"): 1, ("q4", "last"): 1}


def test_explore_order(spark):
    rows = [(1, "2024-01-01", 0.5), (2, None, None), (3, "2024-03-01", -1.0), (4, "2024-02-01", 0.9)]
    df = spark.createDataFrame(rows, "post_id long, d string, s double").select("post_id", F.to_timestamp_ntz("d").alias("collected_at"), F.struct(F.col("s").alias("score")).alias("sentiment"))
    order = lambda name: [r.post_id for r in explore.sort_results(df, name, "post_id").collect()]
    assert order("relevance") == [1, 2, 3, 4] and order("date") == [3, 4, 1, 2] and order("sentiment") == [4, 1, 2, 3]


def test_cache_and_lookup(spark, tmp_path):
    rows = [("k", 1, "2024-01-01 00:00:00", "old"), ("k", 2, "2024-01-01 12:00:00", "new"), ("gone", 3, "2024-01-01 12:00:00", "x"), ("stale", 4, "2023-12-30 00:00:00", "y")]
    at = F.to_timestamp_ntz("d").alias("captured_at")
    store.append_snapshots(spark.createDataFrame(rows, "key string, id long, d string, result string").select("key", "id", at, "result"), str(tmp_path / "c"))
    deleted = spark.createDataFrame([("gone", "2024-01-01 13:00:00")], "key string, d string").select("key", F.to_timestamp_ntz("d").alias("deleted_at"))
    fresh = store.fresh_snapshots(spark.read.parquet(str(tmp_path / "c")), F.to_timestamp_ntz(F.lit("2024-01-01 18:00:00")), tombstones=deleted)
    asked = spark.createDataFrame([("k", False), ("k", True), ("gone", False), ("stale", False)], "key string, refresh boolean")
    got = [(r.key, r.refresh, r.result) for r in store.lookup(asked, fresh).collect()]
    assert sorted(got, key=str) == sorted([("k", False, "new"), ("k", True, None), ("gone", False, None), ("stale", False, None)], key=str)


def test_report_lines(spark):
    t = "array<struct<label:string,keywords:array<string>,score:double>>"
    df = spark.createDataFrame([("t", [("L", ["a", "b"], 1.005), ("M", [], 2.0)])], f"topic string, trends {t}")
    lines = {(r.section, r["rank"]): r.line for r in reports.report_rows(df).collect()}
    assert lines["report", 1] == "L  (score: 1.01)  —  a, b" and lines["report", 2] == "M  (score: 2.00)  —  —"
    assert lines["alert", 1] == "• *L* (score 1.01)"
    assert df.select(reports.headline(F.col("trends")).alias("h")).first().h == "L · M"


def test_insights_without_trends(spark):
    t = "array<struct<label:string,keywords:array<string>,score:double>>"
    d = "array<struct<engagement_score:double,keywords:array<string>>>"
    df = spark.createDataFrame([("t", 2, [], [], 0.1)], f"topic string, n_docs long, trends {t}, top_docs {d}, confidence double")
    r = insights.rule_insights(df).first()
    assert r.summary.startswith("Analysis of 2 filtered sources for 't' found limited") and len(r.key_takeaways) == 4 and len(r.opportunities) == 3


def test_totals_merge(spark):
    a = spark.createDataFrame([("t", 2, 10.0, "2024-01-01")], "topic string, total_runs long, sum_elapsed double, last_run_at string")
    b = spark.createDataFrame([("t", 1, 2.0, "2024-02-01"), ("u", 1, 1.0, "2024-01-05")], a.schema)
    got = {r.topic: (r.total_runs, r.avg_elapsed, r.last_run_at) for r in history.topic_history(history.merge_totals(a, b)).collect()}
    assert got == {"t": (3, 4.0, "2024-02-01"), "u": (1, 1.0, "2024-01-05")}


def test_raw_records_from_files(spark, tmp_path):
    good = '{"query": "q", "source": "s", "content": " c ", "url": "u", "collected_at": "2024-01-01T00:00:00", "extra": 1}'
    (tmp_path / "a.json").write_text("\n".join([good, good.replace('" c "', '"  "'), good.replace('"url": "u", ', ""), '{"query": ']))
    rows = landed.read_raw_records(spark, str(tmp_path)).collect()
    assert [(r.content, r.url) for r in rows] == [("c", "u")]

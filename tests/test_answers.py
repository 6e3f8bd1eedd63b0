"""Whole answers, run-scoped staging and ranked results."""

import glob

import pytest
from pyspark.sql import functions as F

from topicloom.operators.collect import expand_queries
from topicloom.operators.ranking import ranked_in_groups
from topicloom.operators.reports import ranked_results
from topicloom.plans import analysis, answers
from topicloom.plans.collect import Collected
from topicloom.session import new_folder, shared_root, stage, staging

POST = "post_id long, topic string, query string, source string, content string, url string, collected_at timestamp_ntz, likes long, comments long, shares long"


def _now():
    return F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))


def _folders(spark, name="run"):
    return glob.glob(shared_root(spark).removeprefix("file:") + f"/{name}-*")


def test_a_run_leaves_nothing(spark):
    before = _folders(spark)  # a run that was killed leaves its folder
    with staging(spark) as folder:
        held = stage(spark.range(5).toDF("n"), "kept")
        assert held.inputFiles()[0].startswith("file:///") and folder.removeprefix("file:") in held.inputFiles()[0]
        with staging(spark, "inner") as inner:
            assert new_folder(spark, "x").startswith(inner)
        assert new_folder(spark, "x").startswith(folder) and held.count() == 5
    assert _folders(spark) == before and not glob.glob(inner.removeprefix("file:")) and not new_folder(spark, "x").startswith(folder)
    with pytest.raises(ValueError), staging(spark):
        stage(spark.range(1).toDF("n"), "lost")
        raise ValueError
    assert _folders(spark) == before


def test_ranks_in_groups_of_any_size(spark):
    rows = [(f"g{0 if i % 3 else i % 7}", (i * 37) % 1000) for i in range(1000)]
    got = ranked_in_groups(spark.createDataFrame(rows, "g string, n int").repartition(7), ["g"], [F.desc("n")]).collect()
    want = {(g, n, r) for g in {x for x, _ in rows} for r, n in enumerate(sorted((m for h, m in rows if h == g), reverse=True), 1)}
    assert {tuple(r) for r in got} == want and len(got) == 1000


def _posts(spark, rows):
    return spark.createDataFrame(rows, POST)


def test_results_without_pages(spark):
    far = 1 << 60  # arrival numbers of any size
    posts = _posts(spark, [(i * far // 8, "t", "q0", "web", f"text {i} " + "x" * 300, "u", None, i, 0, 0) for i in range(5)])
    queries = spark.createDataFrame([("q0", 0), ("q1", 1)], "query string, ord int")
    got = ranked_results(queries, posts.withColumn("sentiment", F.lit("s"))).orderBy("ord", "rank").collect()
    assert [(r.query, r["rank"], r.metadata and r.metadata.likes) for r in got] == [("q0", i + 1, i) for i in range(5)] + [("q1", None, None)]
    assert all(len(r.content_preview) == 243 for r in got[:5])


def test_answers_errors_and_repeats(spark):
    # "weak" has one post without a counted word or a reaction; "none" has posts without texts only
    texts = ["solar panels on roofs", "solar panels and storage", "wind power and storage", "storage of solar power"]
    rows = [(i, "good", None, "linkedin", f"{t} {i}", f"u{i}", None, 5, 2, i) for i, t in enumerate(texts)]
    rows += [(10, "none", None, "web", "  ", "u", None, 1, 1, 1), (11, "none", None, "web", None, "u", None, 1, 1, 1)]
    rows += [(20, "kept", None, "web", "never read", "u", None, 1, 1, 1), (30, "weak", None, "web", "слова без чисел", "u", None, 0, 0, 0)]
    posts = _posts(spark, rows)
    requests = spark.createDataFrame(
        [("good", False), ("good", True), ("none", False), ("kept", False), ("weak", False), ("absent", False)], "topic string, refresh boolean"
    )
    snapshots = spark.createDataFrame([(1, "kept", '{"topic": "kept", "sources_analysed": 3}'), (2, "good", '{"topic": "good"}')], "id int, topic string, result string")
    snapshots = snapshots.select("id", answers.fingerprint(F.col("topic")).alias("key"), _now().alias("captured_at"), "result")
    runs = spark.createDataFrame([], f"id int, topic string, captured_at timestamp_ntz, trends array<{analysis.evolution.TREND_TYPE}>")
    topics = requests.select("topic").distinct()
    found = Collected(expand_queries(topics), posts, posts.withColumn("query", F.concat("topic", F.lit(" none"))), topics.limit(0))
    before = _folders(spark)
    made = answers.write_answers(
        spark, lambda: answers.answer(requests, found, runs, snapshots, _now(), clustering=analysis.column_clusters("source"))
    )
    got = {r.topic: r for r in made.answers.collect()}
    assert set(got) == {"good", "none", "kept", "weak", "absent"} and made.answers.count() == 5
    assert got["kept"].cached and got["kept"].answer.sources_analysed == 3
    assert not got["good"].cached and got["good"].error is None and got["good"].answer.query_intelligence.query_type == "broad"
    assert got["none"].error == got["absent"].error == answers.NO_DATA and got["none"].answer is None
    assert got["weak"].error == answers.NO_SURVIVORS
    assert [r.topic for r in made.runs.collect()] == ["good"] and made.snapshots.count() == 1
    assert {r.topic for r in made.documents.collect()} == {"good"}
    assert "kept" not in {r.topic for r in made.results.collect()}
    assert _folders(spark) == before

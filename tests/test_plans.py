"""What the plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from topicloom.operators import collect, evolution, similarity, terms, validation
from topicloom.operators.explore import by_date_range
from topicloom.session import shared_root
from topicloom.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_deduplication_limits_before_the_shuffle(spark):
    posts = Tables(spark, SF).posts(engagement=False).select("post_id", "content", "url")
    text = physical(validation.deduplicate(posts, ["content", "url"], "post_id"))
    assert text.count("WindowGroupLimit") == 2


def test_vocabulary_limits_before_the_shuffle(spark):
    text = physical(terms.vocabulary(Tables(spark, SF).posts(False, False)))
    assert text.count("WindowGroupLimit") == 2 and "Python" not in text


@pytest.mark.parametrize("build", ["similarity", "evolution", "routing"])
def test_no_cartesian_products(spark, build):
    t = Tables(spark, SF)
    if build == "similarity":
        df = similarity.consistency(terms.TermModel(t.posts(False, False)).document_keywords())
    elif build == "evolution":
        df = evolution.score_opportunities(evolution.trend_evolution(t.trend_pairs()))
    else:
        items = t.posts(False, False).select("post_id", "topic", F.lit("x").alias("tag"))
        df = collect.route_items(items, collect.expand_queries(items.select("topic").distinct()))
    text = physical(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumnRenamed("ts", "collected_at")
    df = by_date_range(rows, "7d", F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))).select("event_id")
    text = physical(df)
    assert "GreaterThanOrEqual(ts" in text and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_root(spark) == (named or spark.sparkContext.getCheckpointDir()).rstrip("/")


def test_bucketed_stores_are_read_without_an_exchange(spark, tmp_path):
    from topicloom.operators import history
    from topicloom.sources import store

    rows = spark.range(200).selectExpr(
        "id", "concat('t', id % 7) AS topic", "concat('t', id % 7) AS topic_key", "concat('t', id % 7) AS key",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id) AS captured_at", "array(id) AS trends", "cast(id AS string) AS result")
    at = F.to_timestamp_ntz(F.lit("2024-01-09 00:00:00"))
    for i in range(2):
        store.append_bucketed(rows.where(f"id % 2 = {i}"), "plan_runs", f"{tmp_path}/runs", "topic_key", "captured_at", 4)
        store.append_bucketed(rows.where(f"id % 2 = {i}"), "plan_snapshots", f"{tmp_path}/snapshots", "key", "captured_at", 4)
    runs = spark.table("plan_runs")
    latest = history.latest_trends(runs)
    assert {r.topic_key: r.trends for r in latest.collect()} == {f"t{i % 7}": [i] for i in range(193, 200)}
    fresh = store.fresh_snapshots(spark.table("plan_snapshots"), at, 864_000)
    for df in (latest, fresh, history.topic_totals(runs.withColumn("elapsed_secs", F.lit(1.0)).drop("topic").withColumnRenamed("topic_key", "topic"))):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    want = {(r.key, r.id) for r in fresh.collect()}
    gone = spark.createDataFrame([("t1",)], "key string").withColumn("deleted_at", at)
    for _ in range(2):
        held = store.compact_snapshots(spark, "plan_snapshots", f"{tmp_path}/snapshots", at, 864_000, gone, 4)
        assert {(r.key, r.id) for r in held.collect()} == {w for w in want if w[0] != "t1"}
    spark.sql("DROP TABLE plan_runs")
    again = store.open_bucketed(spark, "plan_runs", f"{tmp_path}/runs", runs.schema.toDDL(), "topic_key", "captured_at", 4)
    assert again.count() == 200 and "Exchange" not in history.latest_trends(again)._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE plan_runs")
    spark.sql("DROP TABLE plan_snapshots")


def test_stores_are_pruned_by_month_and_topic(spark, tmp_path):
    from topicloom.sources import store

    rows = spark.range(400).selectExpr("id", "concat('t', id % 5) AS topic", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id AS int)) AS captured_at")
    store.append_runs(rows, f"{tmp_path}/runs")
    stored = store.read_runs(spark, f"{tmp_path}/runs")
    low = F.to_timestamp_ntz(F.lit("2024-11-20 00:00:00"))
    recent = store.since(stored, "captured_at", low).where("topic = 't1'")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else the filters are cut short in the plan's text
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "captured_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(topic,t1)" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert recent.count() == rows.where((F.col("captured_at") >= low) & (F.col("topic") == "t1")).count()
    kinds = spark.createDataFrame([(f"t{i}", i) for i in range(5)], "topic string, n int")
    kinds.write.parquet(f"{tmp_path}/windows")
    windows = spark.read.parquet(f"{tmp_path}/windows").where("n < 2").select(
        "topic", F.to_timestamp_ntz(F.lit("2024-03-10 00:00:00")).alias("since"), F.to_timestamp_ntz(F.lit("2024-04-02 00:00:00")).alias("until")
    )
    found = store.runs_in_windows(stored, windows)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    want = rows.where("captured_at >= timestamp_ntz'2024-03-10' AND captured_at <= timestamp_ntz'2024-04-02' AND topic IN ('t0', 't1')")
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in want.collect())

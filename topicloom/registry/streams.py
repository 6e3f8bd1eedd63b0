"""Streams run to the end of the given tables; the final tables are compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.registry.base import query
from topicloom.registry.posts import stamp
from topicloom.session import new_folder
from topicloom.sources.tables import Tables
from topicloom.streaming import jobs


def stream(t: Tables, name: str):
    schema = t.read(name).schema
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{t.sf_dir}/{name}.parquet*")


def stream_of(t: Tables, df, name: str):
    """A table Spark derived, written in several files and read back as a stream."""
    path = new_folder(t.spark, name)
    df.repartition(4, df.columns[0]).write.parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


def finish(q) -> None:
    q.awaitTermination()


@query(
    "sm1_distinct_posts",
    """SELECT post_id, sha256(content || url) AS content_hash, engagement_score FROM (
      SELECT *, row_number() OVER (PARTITION BY sha256(content || url) ORDER BY ts, post_id) AS r FROM (
        SELECT event_id AS post_id, ts, event_type || ' ' || props AS content,
          CASE WHEN user_id % 10 = 0 THEN '' ELSE 'https://example.com/u/' || user_id END AS url,
          least((user_id % 50 + event_id % 7) / 10.0::DOUBLE, 100.0::DOUBLE) AS engagement_score FROM events) e
      WHERE url <> '') d WHERE r = 1""",
)
def sm1(t):
    """Events as arriving posts; users divisible by ten have no URL. The delay spans the table."""
    user = F.col("user_id")
    arriving = stream(t, "events").select(
        F.col("event_id").alias("post_id"),
        F.concat("event_type", F.lit(" "), "props").alias("content"),
        F.when(user % 10 == 0, "").otherwise(F.concat(F.lit("https://example.com/u/"), user.cast("string"))).alias("url"),
        F.lit("events").alias("source"),
        F.col("ts").cast("timestamp").alias("collected_at"),
        (user % 50).alias("likes"),
        (F.col("event_id") % 7).alias("comments"),
        F.lit(0).cast("bigint").alias("shares"),
    )
    path = new_folder(t.spark, "sm1")
    finish(jobs.run_posts(arriving, path, new_folder(t.spark, "sm1-state"), "60 days"))
    return t.spark.read.parquet(path).select("post_id", "content_hash", "engagement_score")


@query(
    "sm2_rolling_usage",
    """SELECT strftime(d - INTERVAL 6 DAYS, '%Y-%m-%d') AS window_start, source, count(*) AS total_calls, round(sum(response_ms) / count(*), 1) AS avg_response_ms,
      CAST(sum(record_count) AS BIGINT) AS total_records, count(*) FILTER (status_code >= 400) AS error_count
    FROM api_usage_v, (SELECT unnest(range(TIMESTAMP '2023-12-01', TIMESTAMP '2024-03-01', INTERVAL 1 DAY)) AS d) days
    WHERE logged_at >= d - INTERVAL 6 DAYS AND logged_at < d + INTERVAL 1 DAY GROUP BY d, source""",
)
def sm2(t):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    log = stream(t, "events").select(
        F.col("ts").cast("timestamp").alias("logged_at"),
        F.col("event_type").alias("source"),
        F.when(k >= 80, 500).otherwise(200).alias("status_code"),
        F.col("value").alias("response_ms"),
        k.alias("record_count"),
    )
    path = new_folder(t.spark, "sm2")
    finish(jobs.run_usage(log, path, new_folder(t.spark, "sm2-state"), "60 days"))
    return jobs.read_usage(t.spark, path).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "source", "total_calls", "avg_response_ms", "total_records", "error_count"
    )


@query(
    "sm3_topic_history",
    "SELECT topic, strftime(max(captured_at), '%Y-%m-%d %H:%M:%S') AS last_run_at, count(*) AS total_runs, round(avg(elapsed_secs), 6) AS avg_elapsed FROM runs_v GROUP BY 1",
)
def sm3(t):
    runs = stream_of(t, t.runs(counts=False), "sm3-runs")
    path = new_folder(t.spark, "sm3")
    finish(jobs.run_history(runs, path, new_folder(t.spark, "sm3-state")))
    return jobs.read_history(t.spark, path).select(
        "topic", stamp("last_run_at").alias("last_run_at"), "total_runs", F.round("avg_elapsed", 6).alias("avg_elapsed")
    )


@query(
    "sm4_trend_alerts",
    "SELECT id, topic, trend_rank - 1 AS pos, '• *' || label || '* (score ' || CAST(round(CAST(score AS DECIMAL(18, 6)), 2) AS DECIMAL(18, 2)) || ')' AS line FROM lines_v WHERE trend_rank <= 3",
)
def sm4(t):
    runs = stream_of(t, t.run_history(), "sm4-runs")
    path = new_folder(t.spark, "sm4")
    finish(jobs.run_alerts(runs, path, new_folder(t.spark, "sm4-state")))
    return t.spark.read.parquet(path).select("id", "topic", "pos", "line")

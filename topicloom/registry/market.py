"""Interest series and job listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.operators import jobs, series
from topicloom.operators.ranking import ordered_list
from topicloom.plans.reports import market_intel
from topicloom.registry.base import query
from topicloom.registry.sqltext import block
from topicloom.sources import landed

block("back_v", "SELECT *, row_number() OVER (PARTITION BY topic ORDER BY dt DESC) AS back FROM timeline_v")
block("fit_v", """
SELECT topic, count(*) AS n, max(dt) AS last, avg(value) AS ym, avg(CAST(1 - back AS DOUBLE)) AS xm,
  coalesce(regr_slope(CAST(value AS DOUBLE), CAST(1 - back AS DOUBLE)), 0) AS slope FROM back_v WHERE back <= 26 GROUP BY 1""")
block("forecast_v", """
SELECT topic, step, last + CAST(7 * step AS INT) AS dt,
  greatest(0, least(100, CAST(round_even(round(ym + slope * (step - xm), 9), 0) AS INT))) AS value
FROM fit_v, (SELECT CAST(i AS INT) AS step FROM range(1, 53) r(i)) s WHERE n >= 4""")
block("summary_v", """
SELECT topic, strftime(arg_min(dt, (-value, dt)), '%Y') AS peak_year, CAST(trunc(avg(value) FILTER (back <= 13)) AS INT) AS avg_last_3m,
  CASE WHEN count(*) < 16 THEN 'stable' WHEN avg(value) FILTER (back <= 8) > avg(value) FILTER (back BETWEEN 9 AND 16) * 1.08 THEN 'rising'
    WHEN avg(value) FILTER (back <= 8) < avg(value) FILTER (back BETWEEN 9 AND 16) * 0.92 THEN 'falling' ELSE 'stable' END AS trend_direction
FROM back_v GROUP BY 1""")


def top_values(column: str) -> str:
    return f"""(SELECT topic, string_agg({column}, ', ' ORDER BY r) AS top FROM (
      SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, first_pos) AS r FROM (
        SELECT topic, {column}, count(*) AS n, min(pos) AS first_pos FROM jobs_v WHERE {column} <> '' GROUP BY 1, 2) c) q WHERE r <= 5 GROUP BY 1)"""


block("jobsum_v", f"""
SELECT j.topic, j.total_count, salary_range, l.top AS top_locations, c.top AS top_companies
FROM (SELECT topic, count(*) AS total_count, arg_min(salary, pos) FILTER (salary <> '') AS salary_range FROM jobs_v GROUP BY 1) j
LEFT JOIN {top_values('location')} l USING (topic) LEFT JOIN {top_values('company')} c USING (topic)""")


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


@query("ts1_forecast", "SELECT topic, step, strftime(dt, '%Y-%m-%d') AS dt, value FROM forecast_v")
def ts1(t):
    return series.forecast(t.timeline()).select("topic", "step", day("dt"), "value")


@query("ts2_series_summary", "SELECT * FROM summary_v")
def ts2(t):
    return series.summarise(t.timeline())


@query("wn5_trailing_points", "SELECT topic, back, strftime(dt, '%Y-%m-%d') AS dt, value FROM back_v WHERE back <= 26")
def wn5(t):
    return series.trailing(t.timeline()).select("topic", "back", day("dt"), "value")


@query("wn6_recent_means", """SELECT topic, round(avg(value) FILTER (back <= 13), 6) AS last_13, round(avg(value) FILTER (back <= 8), 6) AS last_8,
  round(avg(value) FILTER (back BETWEEN 9 AND 16), 6) AS prior_8 FROM back_v GROUP BY 1""")
def wn6(t):
    means = [F.round(c, 6).alias(c) for c in ("last_13", "last_8", "prior_8")]
    return series.recent_means(t.timeline()).select("topic", *means)


@query("wn7_peak_year", "SELECT topic, peak_year FROM summary_v")
def wn7(t):
    return series.peaks(t.timeline())


@query("ag14_job_summary", "SELECT * FROM jobsum_v")
def ag14(t):
    return _flat(jobs.summarise_jobs(t.jobs()))


def _flat(rows):
    return rows.withColumn("top_locations", F.concat_ws(", ", "top_locations")).withColumn(
        "top_companies", F.concat_ws(", ", "top_companies")
    )


@query(
    "cq2_market_intel",
    """SELECT topic, peak_year, avg_last_3m, trend_direction, n_forecast, last_value, total_count, top_locations, top_companies, salary_range
    FROM summary_v LEFT JOIN (SELECT topic, count(*) AS n_forecast, arg_max(value, step) AS last_value FROM forecast_v GROUP BY 1) f USING (topic)
    FULL JOIN (SELECT * FROM jobsum_v) j USING (topic)""",
)
def cq2(t):
    rows = market_intel(t.timeline(), t.jobs())
    return rows.select(
        "topic", "peak_year", "avg_last_3m", "trend_direction",
        F.when(F.col("forecast").isNotNull(), F.size("forecast")).alias("n_forecast"),
        F.try_element_at("forecast", F.lit(-1))["value"].alias("last_value"),
        "total_count",
        F.when(F.col("top_locations").isNotNull(), F.concat_ws(", ", "top_locations")).alias("top_locations"),
        F.when(F.col("top_companies").isNotNull(), F.concat_ws(", ", "top_companies")).alias("top_companies"),
        "salary_range",
    )


# ---- landed payloads ------------------------------------------------------------


def interest_payloads(t):
    """One payload per topic and year: at most 54 weekly points, some with an unreadable date."""
    week = F.col("dt")
    text = F.concat(F.date_format(week, "MMM d, yyyy"), F.lit(" – "), F.date_format(F.date_add(week, 6), "MMM d, yyyy"))
    point = F.struct(
        F.when(F.weekofyear(week) % 10 == 0, "soon").otherwise(text).alias("date"),
        F.when(F.weekofyear(week) % 7 != 0, F.array(F.struct(F.col("value").alias("extracted_value")))).alias("values"),
    )
    return (
        t.timeline()
        .groupBy("topic", F.year("dt").alias("year"))
        .agg(ordered_list(F.col("dt"), point).alias("timeline_data"))
        .select("topic", F.to_json(F.struct("timeline_data")).alias("payload"))
    )


@query(
    "src5_interest_timeline",
    """SELECT topic, strftime(dt, '%Y-%m-%d') AS dt, CASE WHEN week(dt) % 7 <> 0 THEN value ELSE 0 END AS value
    FROM timeline_v WHERE week(dt) % 10 <> 0""",
)
def src5(t):
    return landed.interest_timeline(interest_payloads(t)).select("topic", day("dt"), "value")


def job_payloads(t, shape: str):
    """Feeds of at most twelve listings: a feed covers 60 consecutive customer numbers of one segment."""
    rows = t.jobs().select("*", F.floor(F.col("pos") / 60).alias("feed"))
    url = F.concat(F.lit("https://jobs.example.com/"), F.col("pos").cast("string"))
    if shape == "remote":
        item = F.struct(
            "title",
            F.col("company").alias("company_name"),
            F.col("location").alias("candidate_required_location"),
            url.alias("url"),
            F.lit("2024-05-06T07:08:09").alias("publication_date"),
            F.when(F.col("salary") != "", F.col("salary")).alias("salary"),
        )
        body = [F.when(F.col("feed") % 2 == 0, F.col("feed") + 100).alias("job-count"), F.col("items").alias("jobs")]
    else:
        item = F.struct(
            "title",
            F.col("company").alias("company_name"),
            "location",
            F.when(F.col("pos") % 2 == 0, F.array(F.struct(url.alias("link")))).alias("related_links"),
            F.struct(F.lit("3 days ago").alias("posted_at"), F.when(F.col("salary") != "", F.col("salary")).alias("salary")).alias(
                "detected_extensions"
            ),
        )
        total = F.when(F.col("feed") % 2 == 0, F.struct((F.col("feed") + 100).alias("total_results")))
        body = [total.alias("search_information"), F.col("items").alias("jobs_results")]
    feeds = rows.groupBy("topic", "feed").agg(ordered_list(F.col("pos"), item).alias("items"))
    return feeds.select("topic", "feed", F.to_json(F.struct(*body)).alias("payload"))


FEED = """(SELECT *, row_number() OVER (PARTITION BY topic, pos // 60 ORDER BY pos) - 1 AS p,
  count(*) OVER (PARTITION BY topic, pos // 60) AS n_feed, pos // 60 AS feed FROM jobs_v) f"""


@query(
    "src6_job_feeds",
    f"""SELECT topic, feed, p AS pos, 'remotive' AS source, title, company, CASE WHEN location = '' THEN 'Remote' ELSE location END AS location,
      'https://jobs.example.com/' || pos AS url, '2024-05-06' AS posted, salary FROM {FEED} WHERE p < 8
    UNION ALL SELECT topic, feed, p, 'serpapi', title, company, location, CASE WHEN pos % 2 = 0 THEN 'https://jobs.example.com/' || pos ELSE '' END,
      '3 days ago', salary FROM {FEED} WHERE p < 8""",
)
def src6(t):
    return landed.remote_jobs(job_payloads(t, "remote")).unionByName(landed.search_jobs(job_payloads(t, "search")))


@query(
    "src6_feed_totals",
    f"""SELECT DISTINCT topic, feed, 'remote' AS shape, CAST(CASE WHEN feed % 2 = 0 THEN feed + 100 ELSE n_feed END AS BIGINT) AS total_count FROM {FEED}
    UNION ALL SELECT DISTINCT topic, feed, 'search', CAST(CASE WHEN feed % 2 = 0 THEN feed + 100 ELSE least(n_feed, 8) END AS BIGINT) FROM {FEED}""",
)
def src6_totals(t):
    parts = [landed.feed_totals(job_payloads(t, s), s).withColumn("shape", F.lit(s)) for s in ("remote", "search")]
    return parts[0].unionByName(parts[1])

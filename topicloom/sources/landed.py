"""Flattening of landed payloads (JSON text, one payload per row) into canonical rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions import payload as P
from topicloom.functions.text import blank_to_null, cap_content, let, strip

RESULTS_PER_PAYLOAD = 5
JOBS_PER_PAYLOAD = 8
DEFAULT_URL = "https://example.com"
DATE_FORMAT = "MMM d, yyyy"

RAW_RECORD = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("collected_at", T.TimestampNTZType()),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("likes", T.LongType()),
                    T.StructField("comments", T.LongType()),
                    T.StructField("shares", T.LongType()),
                    T.StructField("author", T.StringType()),
                    T.StructField("hashtags", T.ArrayType(T.StringType())),
                ]
            ),
        ),
    ]
)
WEB_PAYLOAD = "struct<organic_results:array<struct<title:string,snippet:string,link:string>>>"
NEWS_PAYLOAD = "struct<articles:array<struct<title:string,description:string,url:string>>>"
INTEREST_PAYLOAD = "struct<timeline_data:array<struct<date:string,values:array<struct<extracted_value:int>>>>>"
REMOTE_JOBS = (
    "struct<`job-count`:bigint,jobs:array<struct<title:string,company_name:string,"
    "candidate_required_location:string,url:string,publication_date:string,salary:string>>>"
)
SEARCH_JOBS = (
    "struct<search_information:struct<total_results:bigint>,jobs_results:array<struct<title:string,"
    "company_name:string,location:string,related_links:array<struct<link:string>>,"
    "detected_extensions:struct<posted_at:string,salary:string>>>>"
)


REQUIRED = ("query", "source", "url", "collected_at")
CORRUPT = "_corrupt"
LANDED = T.StructType([*RAW_RECORD.fields, T.StructField(CORRUPT, T.StringType())])


def record_reason(corrupt: Column | None = None) -> Column:
    """Null for a usable record, else the first of: malformed, a missing field, blank content."""
    reason = F.lit(None).cast("string")
    reason = F.when(F.coalesce(strip(F.col("content")), F.lit("")) == "", "empty content").otherwise(reason)
    for name in reversed(REQUIRED):
        reason = F.when(F.col(name).isNull(), f"missing {name}").otherwise(reason)
    return reason if corrupt is None else F.when(corrupt.isNotNull(), "malformed").otherwise(reason)


def usable_records(records: DataFrame) -> DataFrame:
    """Every required field present and content not blank; content trimmed."""
    return records.where(record_reason().isNull()).withColumn("content", strip(F.col("content")))


def judged_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines of a batch or a stream, parsed under the fixed schema: the record's fields, ``line`` and ``reason``, which
    is null for usable ones. A line that is no JSON object or doesn't fit the schema is malformed; unknown fields are ignored."""
    kept = [c for c in lines.columns if c != column]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    # Inside the array every line is parsed once, whatever is later asked of its fields; no line is lost by the outer form.
    parsed = lines.select(*kept, F.col(column).alias("line"), F.inline_outer(F.array(F.from_json(column, LANDED, options))))
    malformed = F.coalesce(CORRUPT, F.when(F.coalesce(*[F.col(f.name).cast("string") for f in RAW_RECORD.fields]).isNull(), F.col("line")))
    return parsed.withColumn("reason", record_reason(malformed)).drop(CORRUPT)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """The lines of landed files as ``judged_lines`` gives them."""
    return judged_lines(spark.read.text(path))


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where("reason IS NULL").withColumn("content", strip(F.col("content"))).drop("line", "reason")


def quarantined(judged: DataFrame) -> DataFrame:
    """Rejected lines as they came, with the reason."""
    return judged.where("reason IS NOT NULL").drop(*RAW_RECORD.fieldNames())


def read_raw_records(spark: SparkSession, path: str) -> DataFrame:
    """Usable records of JSON line files; ``read_landed`` has the rejected lines as well."""
    return accepted(read_landed(spark, path))


def raw_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """As ``read_raw_records``, for JSON text already in a table."""
    kept = [c for c in lines.columns if c != column]
    # Inside the array every line is parsed once, whatever is later asked of its fields.
    return usable_records(lines.select(*kept, F.inline(F.array(F.from_json(column, RAW_RECORD)))))


def _items(payloads: DataFrame, schema: str, array: str, limit: int, column: str) -> DataFrame:
    kept = [c for c in payloads.columns if c != column]
    parsed = payloads.withColumn("_p", F.from_json(column, schema))
    return parsed.select(*kept, F.posexplode(F.slice(F.col(f"_p.{array}"), 1, limit)).alias("pos", "item"))


def web_results(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """First five organic results of each payload."""
    text = F.concat(F.coalesce("item.title", F.lit("")), F.lit(". "), F.coalesce("item.snippet", F.lit("")))
    items = _items(payloads, WEB_PAYLOAD, "organic_results", RESULTS_PER_PAYLOAD, column)
    return items.select(
        *[c for c in items.columns if c != "item"],
        F.lit("serpapi").alias("source"),
        text.alias("content"),
        F.coalesce("item.link", F.lit(DEFAULT_URL)).alias("url"),
    )


def news_results(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """First five articles; the body is the description, or the title without one."""
    body = strip(F.coalesce(blank_to_null(F.col("item.description")), F.col("item.title"), F.lit("")))
    items = _items(payloads, NEWS_PAYLOAD, "articles", RESULTS_PER_PAYLOAD, column).withColumn("_body", body)
    return (
        items.where(F.col("_body") != "")
        .select(
            *[c for c in items.columns if c not in ("item", "_body")],
            F.lit("newsapi").alias("source"),
            F.concat(F.coalesce("item.title", F.lit("")), F.lit(". "), F.col("_body")).alias("content"),
            F.coalesce("item.url", F.lit(DEFAULT_URL)).alias("url"),
        )
    )


def social_posts(payloads: DataFrame, collected_at: Column, column: str = "payload") -> DataFrame:
    """Heterogeneous post objects as canonical rows; texts under 20 characters are dropped."""
    kept = [c for c in payloads.columns if c != column]

    def row(p: Column) -> Column:
        tags = F.coalesce(F.from_json(P.field(p, "hashtags"), "array<string>"), F.array().cast("array<string>"))
        return F.struct(
            P.post_text(p).alias("text"),
            P.post_url(p).alias("url"),
            P.post_time(p, collected_at).alias("collected_at"),
            P.typed_engagement_counts(p, F.col(column)).alias("counts"),
            P.post_author(p).alias("author"),
            tags.alias("hashtags"),
        )

    # Parsed and tested inside one expression: a filter on a parsed column would be moved
    # below it and parse every payload again.
    long_enough = F.filter(F.array(let(P.as_map(F.col(column)), row)), lambda r: F.length(r["text"]) >= P.MIN_POST_CHARS)
    return payloads.select(*kept, F.inline(long_enough)).select(
        *kept,
        F.lit("linkedin").alias("source"),
        cap_content(F.col("text")).alias("content"),
        "url",
        "collected_at",
        F.struct("counts.likes", "counts.comments", "counts.shares", "author", "hashtags").alias("metadata"),
    )


def interest_timeline(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Interest points; rows whose date cannot be read are dropped."""
    kept = [c for c in payloads.columns if c != column]
    parsed = payloads.withColumn("_p", F.from_json(column, INTEREST_PAYLOAD))
    points = parsed.select(*kept, F.explode("_p.timeline_data").alias("pt"))
    start = F.trim(F.split_part(F.col("pt.date"), F.lit(" – "), F.lit(1)))
    date = F.try_to_timestamp(start, F.lit(DATE_FORMAT)).cast("date")
    value = F.coalesce(F.get(F.col("pt.values"), 0)["extracted_value"], F.lit(0))
    return points.select(*kept, date.alias("dt"), value.alias("value")).where(F.col("dt").isNotNull())


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def remote_jobs(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Listings of a remote-jobs feed: first eight, location defaulting to Remote."""
    items = _items(payloads, REMOTE_JOBS, "jobs", JOBS_PER_PAYLOAD, column)
    return items.select(
        *[c for c in items.columns if c != "item"],
        F.lit("remotive").alias("source"),
        _text("item.title").alias("title"),
        _text("item.company_name").alias("company"),
        F.coalesce(blank_to_null(F.col("item.candidate_required_location")), F.lit("Remote")).alias("location"),
        _text("item.url").alias("url"),
        F.substring(_text("item.publication_date"), 1, 10).alias("posted"),
        _text("item.salary").alias("salary"),
    )


def search_jobs(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Listings of a job-search feed: first eight."""
    items = _items(payloads, SEARCH_JOBS, "jobs_results", JOBS_PER_PAYLOAD, column)
    return items.select(
        *[c for c in items.columns if c != "item"],
        F.lit("serpapi").alias("source"),
        _text("item.title").alias("title"),
        _text("item.company_name").alias("company"),
        _text("item.location").alias("location"),
        F.coalesce(F.get(F.col("item.related_links"), 0)["link"], F.lit("")).alias("url"),
        _text("item.detected_extensions.posted_at").alias("posted"),
        _text("item.detected_extensions.salary").alias("salary"),
    )


def feed_totals(payloads: DataFrame, shape: str, column: str = "payload") -> DataFrame:
    """The total a feed states for itself, else its number of listings (those kept, for search feeds)."""
    kept = [c for c in payloads.columns if c != column]
    if shape == "remote":
        parsed = payloads.withColumn("_p", F.from_json(column, REMOTE_JOBS))
        total = F.coalesce(F.col("_p.`job-count`"), F.size("_p.jobs"))
    else:
        parsed = payloads.withColumn("_p", F.from_json(column, SEARCH_JOBS))
        shown = F.size(F.slice("_p.jobs_results", 1, JOBS_PER_PAYLOAD))
        total = F.coalesce(F.col("_p.search_information.total_results"), shown)
    return parsed.select(*kept, total.cast("bigint").alias("total_count"))

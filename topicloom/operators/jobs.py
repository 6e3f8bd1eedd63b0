"""Job listing summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.ranking import ordered_list, top_per_group

TOP = 5


def _most_common(listings: DataFrame, column: str, name: str) -> DataFrame:
    """Five most frequent non-blank values per topic; equals in order of first sight."""
    counts = (
        listings.where(F.coalesce(F.col(column), F.lit("")) != "")
        .groupBy("topic", column)
        .agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    )
    best = top_per_group(counts, ["topic"], [F.desc("n"), F.asc("first_pos")], TOP)
    return best.groupBy("topic").agg(ordered_list(F.col("rank"), F.col(column)).alias(name))


def summarise_jobs(listings: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """(topic, total_count, top_locations, top_companies, salary_range).

    ``totals`` (topic, total_count) overrides the listing count where a feed states one.
    """
    paid = F.col("salary").isNotNull() & (F.col("salary") != "")
    base = listings.groupBy("topic").agg(
        F.count("*").alias("listing_count"),
        F.min_by(F.when(paid, F.col("salary")), F.when(paid, F.col("pos"))).alias("salary_range"),
    )
    if totals is None:
        base = base.withColumn("total_count", F.col("listing_count"))
    else:
        base = base.join(totals, "topic", "left").withColumn(
            "total_count", F.coalesce("total_count", "listing_count")
        )
    return (
        base.drop("listing_count")
        .join(_most_common(listings, "location", "top_locations"), "topic", "left")
        .join(_most_common(listings, "company", "top_companies"), "topic", "left")
    )

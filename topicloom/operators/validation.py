"""Record validation and keep-first de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.scoring import baseline_engagement, total_engagement
from topicloom.functions.text import content_hash, strip
from topicloom.operators.ranking import first_per_group


def rejection_reason(content: Column, url: Column) -> Column:
    """Null for a usable record."""
    return F.when(strip(F.coalesce(content, F.lit(""))) == "", "empty content").when(
        strip(F.coalesce(url, F.lit(""))) == "", "missing url"
    )


def rejected_posts(records: DataFrame) -> DataFrame:
    """The quarantine: unusable records with the reason."""
    reason = rejection_reason(F.col("content"), F.col("url"))
    return records.withColumn("reason", reason).where(F.col("reason").isNotNull())


def deduplicate(records: DataFrame, hash_of: list[str], arrival: str, within: list[str] | None = None) -> DataFrame:
    """Keep the earliest record of each content hash, overall or ``within`` groups."""
    hashed = records.withColumn("content_hash", content_hash(*[F.col(c) for c in hash_of]))
    return first_per_group(hashed, [*(within or []), "content_hash"], [F.col(arrival)])


def usable_posts(records: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Trimmed, usable posts with a baseline engagement score. A null ``collected_at`` takes ``as_of`` when given."""
    total = total_engagement(F.col("likes"), F.col("comments"), F.col("shares"))
    current = F.col("engagement_score") if "engagement_score" in records.columns else F.lit(0.0)
    usable = (
        records.where(rejection_reason(F.col("content"), F.col("url")).isNull())
        .withColumn("content", strip(F.col("content")))
        .withColumn("url", strip(F.col("url")))
        .withColumn("source", strip(F.coalesce("source", F.lit(""))))
        .withColumn("engagement_score", baseline_engagement(current, total))
    )
    if as_of is not None:
        usable = usable.withColumn("collected_at", F.coalesce("collected_at", as_of))
    return usable


def validate_posts(records: DataFrame, arrival: str, as_of: Column | None = None,
                   within: list[str] | None = None) -> DataFrame:
    """Usable, distinct (content and url) posts, overall or ``within`` groups."""
    return deduplicate(usable_posts(records, as_of), ["content", "url"], arrival, within)

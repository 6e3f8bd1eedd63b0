"""Interest series: forecast and summary per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.operators.ranking import top_per_group

# Fixed values.
TREND_POINTS = 26
FORECAST_WEEKS = 52
RECENT_POINTS = 13
HALF = 8
MIN_POINTS = 4
MARGIN = 0.08


def trailing(series: DataFrame, points: int = TREND_POINTS) -> DataFrame:
    """Last ``points`` rows of each series; ``back`` is 1 for the newest. Of two values for one date the larger counts
    as the newer."""
    return top_per_group(series, ["topic"], [F.desc("dt"), F.desc("value")], points, "back")


def forecast(series: DataFrame, weeks: int = FORECAST_WEEKS) -> DataFrame:
    """(topic, step, dt, value, forecast): least squares over the trailing points."""
    back = F.col("back").cast("double")
    # x counts backwards from the newest point, so the line is read at x = -step.
    fit = (
        trailing(series)
        .groupBy("topic")
        .agg(
            F.count("*").alias("n"),
            F.max("dt").alias("last"),
            F.avg("value").alias("mean_y"),
            F.avg(1 - back).alias("mean_x"),
            F.coalesce(F.regr_slope(F.col("value").cast("double"), 1 - back), F.lit(0.0)).alias("slope"),
        )
        .where(F.col("n") >= MIN_POINTS)
    )
    at_step = F.col("mean_y") + F.col("slope") * (F.col("step") - F.col("mean_x"))
    # Values are whole numbers, so the ninth decimal of the line is summation noise.
    value = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.round(at_step, 9), 0).cast("int")))
    return fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(weeks)))).select(
        "topic",
        "step",
        F.expr("date_add(cast(last as date), 7 * step)").alias("dt"),
        value.alias("value"),
        F.lit(True).alias("forecast"),
    )


def peaks(series: DataFrame) -> DataFrame:
    """(topic, peak_year): year of the first maximum."""
    first_best = F.min_by("dt", F.struct((-F.col("value")).alias("v"), F.col("dt").alias("d")))
    return series.groupBy("topic").agg(F.date_format(first_best, "yyyy").alias("peak_year"))


def recent_means(series: DataFrame) -> DataFrame:
    """(topic, n, last_13, last_8, prior_8): means over the newest points, and how many there are of sixteen."""
    def mean(low: int, high: int) -> Column:
        return F.avg(F.when(F.col("back").between(low, high), F.col("value")))

    return (
        trailing(series, 2 * HALF)
        .groupBy("topic")
        .agg(
            F.count("*").alias("n"),
            mean(1, RECENT_POINTS).alias("last_13"),
            mean(1, HALF).alias("last_8"),
            mean(HALF + 1, 2 * HALF).alias("prior_8"),
        )
    )


def summarise(series: DataFrame) -> DataFrame:
    """(topic, peak_year, avg_last_3m, trend_direction)."""
    late, early = F.col("last_8"), F.col("prior_8")
    direction = (
        F.when(F.col("n") < 2 * HALF, "stable")
        .when(late > early * (1 + MARGIN), "rising")
        .when(late < early * (1 - MARGIN), "falling")
        .otherwise("stable")
    )
    return peaks(series).join(recent_means(series), "topic").select(
        "topic", "peak_year", F.col("last_13").cast("int").alias("avg_last_3m"), direction.alias("trend_direction")
    )

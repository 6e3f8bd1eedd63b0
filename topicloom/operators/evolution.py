"""Trend evolution, uniqueness and opportunity scores.

A run is one row holding its (at most twelve) ranked trends as an array, as stored in
the run table. Comparing two runs, or the trends of one, is then arithmetic inside a
row: no join, no shuffle, no pairs between rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.text import let, signed_percent
from topicloom.session import stage

TREND_TYPE = "struct<label:string,keywords:array<string>,score:double>"

# Fixed values.
MIN_OVERLAP = 0.2
CHANGE_MARGIN = 10
NEW_GROWTH = 1.35
GROWTH_FLOOR = 0.5
UNIQUENESS_BASE = 1.4
UNIQUENESS_FLOOR = 0.6


def overlap(a: Column, b: Column) -> Column:
    """(both, either): sizes of the intersection and the union of two keyword arrays as sets."""
    return F.struct(F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_union(a, b)).alias("either"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two keyword arrays as sets; 0 when both are empty."""
    return let(overlap(a, b), lambda o: F.when(o["either"] == 0, F.lit(0.0)).otherwise(o["both"] / o["either"]))


def next_in_rank(trends: Column) -> Column:
    """Each trend of an array against the next: label, other, both, either."""
    return F.zip_with(
        F.slice(trends, F.lit(1), F.greatest(F.size(trends) - 1, F.lit(0))),
        F.slice(trends, F.lit(2), F.greatest(F.size(trends) - 1, F.lit(0))),
        lambda a, b: let(
            overlap(a["keywords"], b["keywords"]),
            lambda o: F.struct(a["label"].alias("label"), b["label"].alias("other"), o["both"].alias("both"), o["either"].alias("either")),
        ),
    )


def best_previous(keywords: Column, previous: Column) -> Column:
    """The previous trend with the largest overlap (first of equals), if at least 0.2."""
    overlaps = F.transform(
        previous,
        lambda p, i: F.struct(
            jaccard(keywords, p["keywords"]).alias("overlap"), (-i).alias("order"), p["score"].alias("score")
        ),
    )
    return let(F.array_max(overlaps), lambda best: F.when(best["overlap"] >= MIN_OVERLAP, best))


def _evolve(trend: Column, previous: Column) -> Column:
    def finish(match: Column) -> Column:
        before = F.coalesce(match["score"], F.lit(0.0))
        now = F.coalesce(trend["score"], F.lit(0.0))
        change = F.when(before > 0, (now - before) / before * 100.0).when(now > 0, 100.0).otherwise(0.0)
        return let(
            change,
            lambda pct: F.struct(
                trend["label"].alias("trend"),
                F.round(before, 2).alias("previous_score"),
                F.round(now, 2).alias("current_score"),
                signed_percent(pct).alias("change"),
                F.when(match.isNull(), "new")
                .when(pct > CHANGE_MARGIN, "rising")
                .when(pct < -CHANGE_MARGIN, "falling")
                .otherwise("stable")
                .alias("status"),
                F.bround(pct, 0).alias("pct"),
            ),
        )

    # Wrapped, so that "no match" stays a null inside a non-null element.
    return let(F.struct(best_previous(trend["keywords"], previous).alias("m")), lambda w: finish(w["m"]))


def evolution_of(trends: Column, previous: Column) -> Column:
    earlier = F.coalesce(previous, F.array().cast(f"array<{TREND_TYPE}>"))
    return let(earlier, lambda prev: F.transform(trends, lambda t: _evolve(t, prev)))


def uniqueness(trend: Column, trends: Column) -> Column:
    """1.4 less the mean overlap with the other-labelled trends, at least 0.6; 1.0 without keywords."""
    others = F.filter(trends, lambda o: o["label"] != trend["label"])
    overlaps = F.transform(others, lambda o: jaccard(trend["keywords"], o["keywords"]))
    mean = let(
        overlaps,
        lambda xs: F.when(F.size(xs) == 0, F.lit(0.0)).otherwise(
            F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x) / F.size(xs)
        ),
    )
    return F.when(F.size(F.array_distinct(trend["keywords"])) == 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(UNIQUENESS_FLOOR), UNIQUENESS_BASE - mean)
    )


def growth_factor(status: Column, pct: Column) -> Column:
    return (
        F.when(status == "new", NEW_GROWTH)
        .when(status == "rising", 1.0 + F.greatest(pct, F.lit(0.0)) / 100.0)
        .when(status == "falling", F.greatest(F.lit(GROWTH_FLOOR), 1.0 + pct / 100.0))
        .otherwise(1.0)
    )


def opportunity_reason(growth: Column, unique: Column) -> Column:
    return (
        F.when((growth >= 1.3) & (unique >= 1.1), "high growth + low competition")
        .when(growth >= 1.2, "strong growth signal")
        .when(unique >= 1.15, "distinct cluster with limited overlap")
        .otherwise("solid trend strength with moderate competition")
    )


def evolution_by_label(label: Column, evolution: Column) -> Column:
    """(change, status, pct): the last evolution row of a label; +0% and stable without one."""
    return let(
        F.try_element_at(F.filter(evolution, lambda e: e["trend"] == label), F.lit(-1)),
        lambda e: F.struct(
            F.coalesce(e["change"], F.lit("+0%")).alias("change"),
            F.coalesce(e["status"], F.lit("stable")).alias("status"),
            F.coalesce(e["pct"], F.lit(0.0)).alias("pct"),
        ),
    )


def opportunities_of(trends: Column, evolution: Column) -> Column:
    """Trends scored by growth and uniqueness, scaled so that the best is 10, best first."""

    def raw(trend: Column, i: Column) -> Column:
        return let(
            evolution_by_label(trend["label"], evolution),
            lambda e: let(
                F.struct(
                    growth_factor(e["status"], e["pct"]).alias("growth"), uniqueness(trend, trends).alias("unique")
                ),
                lambda g: F.struct(
                    i.alias("i"),
                    trend["label"].alias("trend"),
                    (trend["score"] * g["growth"] * g["unique"]).alias("raw"),
                    g["growth"].alias("growth"),
                    g["unique"].alias("uniqueness"),
                ),
            ),
        )

    def scale(items: Column) -> Column:
        best = F.array_max(F.transform(items, lambda o: o["raw"]))
        return let(
            best,
            lambda top: F.transform(
                items,
                lambda o: F.struct(
                    F.when(top > 0, -F.round(o["raw"] / top * 10.0, 2)).otherwise(0.0).alias("order"),
                    o["i"].alias("i"),
                    o["trend"].alias("trend"),
                    F.when(top > 0, F.round(o["raw"] / top * 10.0, 2)).otherwise(0.0).alias("opportunity_score"),
                    opportunity_reason(o["growth"], o["uniqueness"]).alias("reason"),
                ),
            ),
        )

    scaled = let(F.transform(trends, raw), scale)
    return F.transform(
        F.array_sort(scaled), lambda o: F.struct(o["trend"], o["opportunity_score"], o["reason"])
    )


def trend_evolution(runs: DataFrame) -> DataFrame:
    """Runs with ``trends`` and ``previous`` gain ``evolution``."""
    return runs.withColumn("evolution", evolution_of(F.col("trends"), F.col("previous")))


def score_opportunities(runs: DataFrame) -> DataFrame:
    """Runs with ``trends`` and ``evolution`` gain ``opportunities``."""
    return runs.withColumn("opportunities", opportunities_of(F.col("trends"), F.col("evolution")))


def previous_snapshot(runs: DataFrame, value: str = "trends", at: str = "captured_at", tie: str = "id",
                      bucket: str = "week") -> DataFrame:
    """Each run with the ``value`` of the run before it on the same topic.

    The look-back runs inside (topic, week) slices, and the first run of a slice takes
    the last value of the topic's previous slice from a small table of slice ends; one
    hot topic is thus spread over its weeks.
    """
    sliced = runs.withColumn("_slice", F.date_trunc(bucket, F.col(at)))
    inside = Window.partitionBy("topic", "_slice").orderBy(at, tie)
    ends = stage(
        sliced.groupBy("topic", "_slice").agg(F.max_by(value, F.struct(at, tie)).alias("_last")), "slice-ends"
    )
    carried = ends.withColumn("_carried", F.lag("_last").over(Window.partitionBy("topic").orderBy("_slice"))).drop("_last")
    return (
        sliced.withColumn("_n", F.row_number().over(inside))
        .withColumn("_lag", F.lag(value).over(inside))
        .join(carried, ["topic", "_slice"], "left")
        .withColumn("previous", F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_lag")))
        .drop("_slice", "_n", "_lag", "_carried")
    )

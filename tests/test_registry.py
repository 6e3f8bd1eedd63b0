"""Registered queries against their SQL. TOPICLOOM_ALL=1 runs every one of them."""

import os

import pytest

from tests.oracle import compare, connect
from topicloom.registry import all_queries

SF = "/root/testdata/sf0.001"
SOME = [
    "ag9_sentiment_by_source", "wn3_deduplicate", "tk1_top_keywords", "ag6_post_scores", "ag15_cluster_trends",
    "ag17_opportunities", "wn2_previous_snapshot", "ts1_forecast", "ag14_job_summary", "src4_social_posts",
    "jn12_source_fallback", "sm1_distinct_posts", "sm2_rolling_usage", "cq1_analyse_by_source",
]


@pytest.fixture(scope="module")
def duck(spark):
    return connect(SF)


@pytest.mark.parametrize("name", list(all_queries()[0]) if os.environ.get("TOPICLOOM_ALL") else SOME)
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, SF, name)
    assert ok, note


def test_every_sql_has_a_query():
    queries, oracles = all_queries()
    assert set(oracles) <= set(queries)

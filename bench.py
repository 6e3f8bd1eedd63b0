"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from topicloom.registry import all_queries
from topicloom.session import build_session

HEADLINE = [
    "ag7_sentiment",
    "ag9_sentiment_by_source",
    "wn3_deduplicate",
    "ag1_vocabulary",
    "ag2_term_weights",
    "tk1_top_keywords",
    "ag6_post_scores",
    "ag15_cluster_trends",
    "jn5_consistency",
    "ag17_opportunities",
    "wn2_previous_snapshot",
    "ag10_usage_summary",
    "ts1_forecast",
    "ag14_job_summary",
    "src4_social_posts",
    "cq1_analyse_by_source",
    "ml1_given_centroids",
    "sm2_rolling_usage",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = all_queries()
    queries["ag12_total_runs"](spark, sf_dir).collect()  # start the JVM's worker threads
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        begin = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

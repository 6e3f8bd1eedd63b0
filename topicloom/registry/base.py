"""Registration of queries with their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from topicloom.registry.sqltext import RECURSIVE, oracle
from topicloom.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Ranks, positions and sizes that the operators give as INT, and DuckDB counts as BIGINT.
INT_COLUMNS = {
    "ag19_score_history": ["back", "pos"],
    "ag2_term_weights": ["tf"],
    "cq1_analyse_by_source": ["sources"],
    "cq1_analyse_with_history": ["sources"],
    "cq1_query_results": ["ord"],
    "cq2_market_intel": ["n_forecast"],
    "fl3_minimum_length": ["chars"],
    "jn6_supporting_document": ["trend_rank"],
    "jn9_literal_counts": ["literal"],
    "ml4_trends_by_source": ["trend_rank"],
    "sc20_word_counts": ["words", "sentiment_tokens"],
    "sm4_trend_alerts": ["pos"],
    "snk4_nested_results": ["n"],
    "snk5_report_rows": ["rank"],
    "so3_keyword_sets": ["both", "either"],
    "src2_web_results": ["pos"],
    "src3_news_results": ["pos"],
    "src6_job_feeds": ["pos"],
    "src7_bucketed_history": ["trends"],
    "src7_latest_history": ["trends"],
    "tk1_top_keywords": ["rank"],
    "tk3_cluster_keywords": ["rank"],
    "tk4_ranked_trends": ["trend_rank"],
    "tk5_top_keywords_of_trends": ["rank"],
    "tk6_opportunity_order": ["place"],
    "tk7_top_documents": ["rank"],
    "wn10_scored_positions": ["pos"],
    "wn2_previous_snapshot": ["previous_trends"],
    "wn5_trailing_points": ["back"],
    "wn8_last_runs": ["back"],
    "wn9_context_lookback": ["pos"],
}


def _as_int(sql: str, columns: list[str]) -> str:
    casts = ", ".join(f'CAST("{c}" AS INTEGER) AS "{c}"' for c in columns)
    return f"SELECT * REPLACE ({casts}) FROM ({sql}) counted" if columns else sql


def query(name: str, sql: str | None = None, blocks: dict[str, str] | None = None):
    """Register ``f(tables) -> DataFrame`` under ``name``, compared with ``sql`` if given;
    ``blocks`` replaces SQL building blocks."""

    def add(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__ = f.__name__
        run.__doc__ = f.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _as_int(sql if sql.startswith('WITH ') and not sql.startswith(RECURSIVE) else oracle(sql, blocks), INT_COLUMNS.get(name, []))
        return f

    return add

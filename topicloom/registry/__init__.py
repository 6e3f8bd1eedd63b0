"""Queries over the driver tables and the SQL each one is compared with."""

from __future__ import annotations


def all_queries():
    """(queries, comparison SQL), both by name. Needs no running session."""
    from topicloom.registry import (  # noqa: F401
        analyses,
        analysis,
        history,
        ingest,
        insights,
        market,
        posts,
        streams,
        topics,
    )
    from topicloom.registry.base import ORACLES, QUERIES

    return QUERIES, ORACLES


def all_sql() -> dict[str, str]:
    """The comparison SQL, complete."""
    from topicloom.registry.sqltext import complete

    return {name: complete(sql) for name, sql in all_queries()[1].items()}

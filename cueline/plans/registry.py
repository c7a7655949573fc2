"""The registered queries, each with its oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that must give the same rows."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def load() -> None:
    """Import every module that registers queries."""
    from cueline.plans import (  # noqa: F401
        flagship,
        queries_audio,
        queries_checks,
        queries_experiments,
        queries_files,
        queries_merging,
        queries_rules,
        queries_scores,
        queries_text,
        queries_timeline,
        queries_topics,
    )

"""Named queries: a Spark callable and, where SQL can say the same, its SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and their SQL."""
    from quillflow.plans import (  # noqa: F401
        answer_queries, apply_queries, feed_queries, flow_queries, history_queries,
        limit_queries, text_queries)

    return dict(QUERIES), dict(ORACLES)

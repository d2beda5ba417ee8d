"""Registered queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackframe.sources.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its body over the named views."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_views(views, sql) if views else sql.strip()
        return build

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from trackframe.catalog import boxes, io, pixels, scores, state, streams, tiles, tracks  # noqa: F401

    return QUERIES, ORACLES

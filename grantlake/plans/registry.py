"""Registry of named queries: a Spark callable, its comparison SQL and what it covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query. ``covers`` lists inventory numbers, ``sql`` is the comparison."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers.split()
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register

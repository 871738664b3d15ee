"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slicelake import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; ``tables`` names the adapters that its SQL stands on."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = fixtures.sql(tables, sql)
        return f

    return add

"""Registry of named queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.sources.fixtures import ITEMS_SQL, SAMPLES_SQL, SCORED_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Common tables for SQL over items, samples and scored.
FIXTURES = f"WITH {ITEMS_SQL},\n{SAMPLES_SQL},\n{SCORED_SQL}\n"


def query(name: str, sql: str | None = None, fixtures: bool = True) -> Callable[[Query], Query]:
    """Registers a query. sql is its tail after the fixtures' common tables (or all of it)."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = FIXTURES + sql if fixtures else sql
        return f

    return add

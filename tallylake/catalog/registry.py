"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallylake.catalog.views_sql import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
SURVEY_ROWS: dict[str, str] = {}


def query(name: str, row: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its key and inventory row; without SQL only its rows are checked."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        SURVEY_ROWS[name] = row
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return run

    return register

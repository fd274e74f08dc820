"""Registry of named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import filter_queries, fundamental_queries, history_queries, indicator_queries, pattern_queries, profile_queries, registry_queries, report_queries, series_queries, source_queries, window_queries

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, tuple[Query, str | None]] = {**series_queries.QUERIES, **registry_queries.QUERIES, **source_queries.QUERIES, **report_queries.QUERIES, **indicator_queries.QUERIES, **profile_queries.QUERIES, **pattern_queries.QUERIES, **window_queries.QUERIES, **fundamental_queries.QUERIES, **filter_queries.QUERIES, **history_queries.QUERIES}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}

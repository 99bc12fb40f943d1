"""All registered queries of the search engine, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def registered(name: str) -> tuple[Query, str | None]:
    """A query registered so far, and its twin."""
    return _QUERIES[name], _SQL.get(name)


def _load() -> None:
    from sablevec.plans import search_queries, source_queries  # noqa: F401  (they register themselves)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

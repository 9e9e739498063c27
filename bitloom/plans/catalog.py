"""Every query of the library with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _ORACLE[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from bitloom.plans import reference  # noqa: F401  registers on import

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLE)

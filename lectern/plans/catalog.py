"""Registry of queries and of the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
MODULES = ("corpus", "text", "inference", "agreement", "resampling", "models", "reports", "exchange")


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL where SQL can say the same."""

    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def oracle_of(name: str) -> str:
    """The SQL of a query registered before."""
    return _sql[name]


def _load() -> None:
    for m in MODULES:
        import_module(f"lectern.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)

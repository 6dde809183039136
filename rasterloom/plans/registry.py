"""Names of queries, their plans and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_PLANS: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ("usage", "timeline", "loops", "grid", "pixels", "colour", "duplicates", "lint", "geometry", "documents", "layout", "motion", "streams")


def plan(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the oracle's SQL where there is some."""

    def put(f: Query) -> Query:
        _PLANS[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def _loaded() -> None:
    for m in MODULES:
        importlib.import_module(f"rasterloom.plans.{m}")


def queries() -> dict[str, Query]:
    _loaded()
    return dict(_PLANS)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(_SQL)

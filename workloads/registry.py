"""Name -> query and name -> expected SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workloads import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query; ``uses`` names the shared views its SQL reads."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = views.with_views(sql, uses)
        return fn

    return add

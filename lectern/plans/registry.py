"""Queries by name, with the DuckDB SQL that tells the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the views as a query."""

    def register(make: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return make

    return register

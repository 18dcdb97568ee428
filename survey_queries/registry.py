"""Collects the queries; one decorator call registers a query and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from survey_queries.views import VIEWS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = "", views: bool = True):
    """Register a query. ``ctes`` are further named parts after the survey views."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            parts = [p for p in ((VIEWS_SQL if views else ""), ctes) if p]
            ORACLES[name] = ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + sql
        return function

    return register

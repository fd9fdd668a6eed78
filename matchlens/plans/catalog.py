"""Named queries over the tables, each with a plain-SQL form to check it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchlens.plans.views import check_sql
from matchlens.sources.adapter import adapted_tables
from matchlens.tables import Tables

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
CHECKS: dict[str, str] = {}
LIBRARY: dict[str, str] = {}

_open: dict[tuple, Tables] = {}


def shared(**views: str) -> None:
    """Add common table expressions that check queries may name."""
    LIBRARY.update(views)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its check, or None where plain SQL cannot say it."""

    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in PLANS:
            raise ValueError(f"query {name} registered twice")
        PLANS[name] = plan
        if sql:
            CHECKS[name] = sql
        return plan

    return register


def open_tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, id(spark), str(sf_dir).rstrip("/"))
    if key not in _open:
        _open[key] = adapted_tables(spark, key[-1])
    return _open[key]


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib

    for module in MODULES:
        importlib.import_module(f"matchlens.plans.{module}")


MODULES = ["season", "standings", "people", "rally", "text", "cells", "schedule", "scouting", "loads", "streams"]


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()
    return {n: (lambda spark, sf_dir, _p=p: _p(open_tables(spark, sf_dir))) for n, p in PLANS.items()}


def check_queries() -> dict[str, str]:
    load_all()
    return {n: check_sql(sql, LIBRARY) for n, sql in CHECKS.items()}

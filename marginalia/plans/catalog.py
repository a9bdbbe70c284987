"""All queries of the core and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.plans.registry import ORACLES, QUERIES

MODULES = ("text", "profiling", "anomalies", "scoring", "sources", "ranking", "gates", "serving", "relational", "values", "display", "records", "streams")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"marginalia.plans.{m}_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)

"""Every operator as a query over the test tables, next to the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dockpulse.registry import ingest, operators, reports, rollup, streams
from dockpulse.registry.base import REGISTRY

__all__ = ["REGISTRY", "ingest", "operators", "reports", "rollup", "streams", "queries", "oracle_sql"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: entry.run for name, entry in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry.sql for name, entry in REGISTRY.items() if entry.sql is not None}

"""All plans of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sixline.plans import data, ensemble, frames, registry_plans, scoring, symbols, tables_plans

_MODULES = (data, symbols, scoring, tables_plans, ensemble, registry_plans)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to callable over (spark, sf_dir)."""
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()} | frames.QUERIES


def oracle_sql() -> dict[str, str]:
    """Name to SQL that DuckDB runs on the same tables."""
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}

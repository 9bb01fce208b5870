"""Collects the queries of the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import catalog_plans, format_plans, model_plans, record_plans, signal_plans, text_plans, tree_plans


def modules() -> tuple:
    """The plan modules, each with QUERIES and ORACLES."""
    return (catalog_plans, signal_plans, model_plans, text_plans, record_plans, format_plans, tree_plans)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to callable of (spark, sf_dir)."""
    return {name: f for m in modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {name: sql for m in modules() for name, sql in m.ORACLES.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's metadata, inherited from the sidecars of its directories."""
    return catalog_plans.metadata_inherit(spark, sf_dir)

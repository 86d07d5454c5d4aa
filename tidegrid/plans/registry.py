"""All queries of the core, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import data_quality, function_queries, metric_queries

MODULES = [data_quality, metric_queries, function_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_queries.QUERIES["flagship_max_by"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}

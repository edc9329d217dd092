"""Registry of the library's own queries and of their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cascades, decisions, evaluation, families, features, geometry, guards, learning, recognition, retrieval, tables, unstructured

_MODULES = (retrieval, decisions, features, tables, unstructured, recognition, guards, families, evaluation, cascades, learning, geometry)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

"""All queries of the library with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under ``name``, with the SQL that gives the same rows."""

    def keep(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shaded relief of the carrier grid, counted by colour."""
    from pyspark.sql import functions as F

    return _QUERIES["grid_shade"](spark, sf_dir).groupBy("color").agg(F.count("*").alias("n"))

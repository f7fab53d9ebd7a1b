"""Registered queries of this subpackage and, where SQL can say them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sensorquery.llm.text import small_batches

_SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``f(spark, folder) -> DataFrame``."""

    def register(f):
        _SPARK[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from sensorquery.llm import queries as _  # noqa: F401

    return dict(_SPARK)


def oracle_sql() -> dict[str, str]:
    from sensorquery.llm import queries as _  # noqa: F401

    return dict(_SQL)

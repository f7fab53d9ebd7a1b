"""Registered queries: a Spark function over the given tables and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sensorquery.plans.testbed import MODEL_SQL, Testbed

_SPARK: dict[str, Callable[[Testbed], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``f(testbed) -> DataFrame``. The SQL may use the model tables and, when it starts
    with WITH, further definitions."""

    def register(f: Callable[[Testbed], DataFrame]):
        if name in _SPARK:
            raise ValueError(f"query registered twice: {name}")
        _SPARK[name] = f
        if sql is not None:
            _SQL[name] = with_model(sql)
        return f

    return register


def with_model(sql: str) -> str:
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {MODEL_SQL},\n{body[5:]}"
    return f"WITH {MODEL_SQL}\n{body}"


def load() -> None:
    from sensorquery.plans import changes, functions, ingest, quality, reads, streams  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()

    def runner(f):
        return lambda spark, folder: f(Testbed(spark, folder))

    return {name: runner(f) for name, f in _SPARK.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_SQL)

"""Runs registered queries against their SQL on the same files: ``python tests/oracle.py DIR [name..]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    if type(value).__name__ == "Decimal":
        return float(f"{float(value):.12g}")
    if isinstance(value, dict):
        return tuple(sorted((k, cell(v)) for k, v in value.items()))
    return value


def normal(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


def compare(spark_columns, spark_rows, sql_columns, sql_rows) -> str:
    """Empty if both results are the same multiset of rows."""
    a, left = normal(list(spark_columns), [tuple(r) for r in spark_rows])
    b, right = normal(list(sql_columns), sql_rows)
    if a != b:
        return f"columns differ: {a} / {b}"
    if len(left) != len(right):
        return f"rows differ: {len(left)} / {len(right)}"
    for x, y in zip(left, right):
        if x != y:
            return f"values differ: {x} / {y}"
    return ""


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("sensorquery-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(folder: str, wanted: list[str]) -> int:
    from sensorquery.plans import registry

    spark, con = session(), connect(folder)
    queries, sql = registry.queries(), registry.oracle_sql()
    failed = 0
    for name, run in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        begin = time.time()
        try:
            df = run(spark, folder)
            rows = df.collect()
            took = time.time() - begin
            if name in sql:
                cursor = con.execute(sql[name])
                problem = compare(df.columns, rows, [d[0] for d in cursor.description], cursor.fetchall())
            else:
                problem = ""
            state = "ok " if not problem else "BAD"
            note = "" if name in sql else "(rows only)"
            print(f"{state} {name} rows={len(rows)} {took:.2f}s {note} {problem[:700]}", flush=True)
        except Exception as error:  # noqa: BLE001
            problem = str(error)
            print(f"ERR {name} {type(error).__name__} {problem[:900]}", flush=True)
        failed += bool(problem)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)

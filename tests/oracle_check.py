"""Compare every registered query with its SQL: `python -m tests.oracle_check FOLDER [NAME...]`."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as contract


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    return type(value).__name__


def table_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def differences(spark: SparkSession, connection, folder: str, name: str) -> list[str]:
    """What differs between a query and its SQL: columns, row count, types, values."""
    found = contract.queries()[name](spark, folder)
    rows = [tuple(row) for row in found.collect()]
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return [] if rows else ["no rows"]
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    wanted = result.fetchall()
    if sorted(names) != sorted(found.columns):
        return [f"columns {sorted(found.columns)} instead of {sorted(names)}"]
    if len(rows) != len(wanted):
        return [f"{len(rows)} rows instead of {len(wanted)}"]
    problems = []
    for left, right in zip(table_of(found.columns, rows), table_of(names, wanted)):
        if left != right or list(map(kind, left)) != list(map(kind, right)):
            problems.append(f"{left} instead of {right}")
    return problems


def main(folder: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = database(folder)
    failed = 0
    for name in names or list(contract.queries()):
        started = time.time()
        try:
            problems = differences(spark, connection, folder, name)
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        checked = "" if name in contract.oracle_sql() else " (rows only)"
        print(f"{'FAIL' if problems else 'ok'} {name}{checked} {time.time() - started:.1f}s", flush=True)
        for problem in problems[:4]:
            print("   ", problem[:900], flush=True)
    print(f"{failed} failed", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)

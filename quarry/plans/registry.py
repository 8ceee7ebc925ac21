"""Registered queries, with the SQL that must give the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query. Its function takes t, which reads a table by name, as t("orders")."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def values(t, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of given rows, in the session that t reads with."""
    return t("region").sparkSession.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    """The same rows for SQL."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({names})"

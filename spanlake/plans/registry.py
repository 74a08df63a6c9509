"""Queries over the driver's tables and the SQL that each must agree with.

events stand for logs and metrics (ts the event time, user_id the tenant, event_type the severity, value the metric, props the
attributes), documents for log bodies, orders and lineitem for parent and child spans, the other tables for resources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self.folder = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with the SQL that must give the same rows."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def spark_query(name: str, text: str, sql: str | None = None) -> None:
    """Registers Spark SQL over views of the tables, as users of the SQL interface write it; sql where DuckDB needs another form."""
    from spanlake.plans.sqlapi import sql as run

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
            if table in text:
                spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        return run(spark, text)

    QUERIES[name], SQL[name] = f, sql or text


from spanlake.plans import document_queries, platform_queries, sql_queries, telemetry_queries  # noqa: E402, F401  they register themselves

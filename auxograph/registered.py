"""The register of queries and their DuckDB oracles, and what the modules that fill it share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auxograph.functions import values
from auxograph.functions.stored import folder

Query = Callable[[SparkSession, str], DataFrame]

__all__ = ["HOURS", "ORACLES", "QUERIES", "Query", "event_series", "folder", "query", "r6", "table"]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: str | object, name: str):
    return F.round(values.col(c), 6).alias(name)


# Series of events

HOURS = "(unix_micros(cast(ts as timestamp)) - unix_micros(timestamp'2024-01-01 00:00:00')) / 3.6e9"


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.expr(HOURS).alias("t"), F.col("value").alias("v"), "event_id")

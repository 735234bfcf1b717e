"""Registration of queries with their reference SQL, and table loading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolemill.plans.parallel import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function ``(tables) -> DataFrame`` under its own name."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            # The files carry no zone; read their times as instants in UTC.
            spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
            return fn(Tables(spark, sf_dir))

        run.__name__ = fn.__name__
        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return run

    return add


class Tables:
    """Tables of one scale factor by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table for work that is heavy per row, on at least as many tasks as there are cores."""
        return spread(getattr(self, name))

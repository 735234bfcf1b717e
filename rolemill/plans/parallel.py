"""Use all cores on inputs that arrive as very few scan tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

SCAN_BYTES = 64 * 1024 * 1024


def scan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a frame, from file sizes for a plain scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a small input over the cores before work that is heavy per row.

    A file with one row group is one task however many cores wait.  Inputs that
    give every core a full scan task are left alone: there the shuffle would
    cost more than it brings.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if scan_bytes(df) < cores * SCAN_BYTES else df

"""Broadcast only what has been measured."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 << 20


def _width(field: StructField) -> Column:
    """Bytes of a value, by its length or that of its JSON form."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (StringType, BinaryType)):
        size = F.octet_length(value)
    elif isinstance(field.dataType, (ArrayType, MapType, StructType)):
        size = F.octet_length(F.to_json(value))
    else:
        return F.lit(8)
    return F.coalesce(size, F.lit(0)) + 8


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``max_bytes``; two sums, added up per task."""
    width = sum((_width(f) for f in df.schema), F.lit(0)).cast("bigint")
    found = df.agg(F.count("*").alias("n"), F.sum(width).alias("bytes")).first()
    return found["n"] <= max_rows and (found["bytes"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast after counting rows and bytes; a larger side is left to the optimizer."""
    return F.broadcast(df) if not df.isStreaming and is_small(df, max_rows) else df


def narrow(table: DataFrame, few: DataFrame, on: Sequence[str], max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Rows of a large table whose key occurs in a small batch.

    With few keys (counted) the table is scanned and filtered in place, so what
    follows never shuffles it; with many keys it is returned as it is.
    """
    keys = few.select(*on)
    if not is_small(keys, max_rows):
        return table
    return table.join(F.broadcast(keys), list(on), "left_semi")

"""Union length of overlapping spans per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.plans.skew import HOT_ROWS, running_max_before

DAY = 86_400 * 1_000_000


def span_union(df: DataFrame, key: str, start: str, end: str, parts: int | None = None) -> DataFrame:
    """Per key: number of islands and covered microseconds; touching spans merge.

    A span adds what lies beyond the furthest end seen before it, so the union
    is a plain sum.  Spans with the same start are reduced to the longest first.
    Ranges of (key, start) are scanned in parallel: days of a key, or with more spans than one
    task may see, or ``parts`` given, sampled ranges, so that neither a key nor a day is one task.
    """
    spans = (
        df.select(key, F.unix_micros(start).alias("_s"), F.unix_micros(end).alias("_e"))
        .where(F.col("_e") > F.col("_s"))
        .groupBy(key, "_s").agg(F.max("_e").alias("_e"))
    )
    days = F.floor(F.col("_s") / F.lit(DAY)) if parts is None and df.count() <= HOT_ROWS else None
    reach = running_max_before(spans, [key], "_s", "_e", "_reach", days, parts)
    opens = F.col("_reach").isNull() | (F.col("_s") > F.col("_reach"))
    gain = F.greatest(F.col("_e") - F.greatest("_s", "_reach"), F.lit(0))
    return reach.groupBy(key).agg(
        F.count_if(opens).alias("islands"), F.sum(gain).alias("covered_us"))

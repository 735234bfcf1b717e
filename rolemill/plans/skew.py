"""Plans that stay balanced when one key holds a large share of the rows.

Three shapes cover the operators of this package: numbering the rows of a key
(`first_per_key`), attaching one row per key to many rows (`join_per_key`), and
running totals along an order (`running_max_before`, `running_sum`, `trailing_count`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemill.plans.broadcast import is_small
from rolemill.plans.session import materialize

SALTS = 256
HOT_SHARE = 1024  # a key is hot when it holds more than 1/HOT_SHARE of all rows
WINDOWS_PER_BLOCK = 16  # trailing windows per time block: one in so many rows is copied
TRACKED = 16 * HOT_SHARE  # size of the sketch that finds hot keys
HOT_ROWS = 1_000_000  # rows of a key that one task may see


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                  flag: str = "is_first", salts: int = SALTS) -> DataFrame:
    """Mark the first row of every key in the given (total) order.

    Step one finds the first row of each (key, salt).  Step two compares only
    those winners, at most ``salts`` per key; all other rows stay spread over
    their salts.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys, "_lane").orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_lane", F.when(F.row_number().over(local) == 1, -1).otherwise(F.col("_salt")))
        .withColumn(flag, (F.col("_lane") == -1) & (F.row_number().over(final) == 1))
        .drop("_salt", "_lane")
    )


def hot_keys(df: DataFrame, key: str, at_least: int = 0) -> list:
    """Keys that hold more than 1/HOT_SHARE of all rows (and ``at_least`` rows).

    One pass with a frequent-items sketch: every task keeps a table of fixed size
    and nothing is shuffled by key.  The list has fewer than HOT_SHARE entries.
    It only steers how work is spread, so its counts may be estimates.  Fewer rows
    than ``at_least`` are only counted.
    """
    if at_least and df.select(key).count() <= at_least:
        return []
    row = df.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {HOT_SHARE}, {TRACKED})").alias("top"), F.count("*").alias("n")).first()
    floor = max(row["n"] / HOT_SHARE, at_least)
    return [item["item"] for item in row["top"] or [] if item["count"] > floor]


def join_per_key(rows: DataFrame, table: DataFrame, key: str, how: str = "left",
                 spread: Sequence[str] | None = None, keys_of: DataFrame | None = None) -> DataFrame:
    """Join ``rows`` with a ``table`` that is unique by ``key``, splitting hot keys.

    Hot keys are found in ``rows``, or in ``keys_of``, a cheaper frame with about the same keys.

    Only rows of hot keys are salted, and only their few table rows are copied.
    Rows without a key match nothing and are spread as well.  The salt is a hash
    of the ``spread`` columns (default: all), so a recomputed task repeats it.

    A small table, by its counted rows and bytes, is broadcast.  A larger one never is, however small its
    files are: every task would hold it whole.
    """
    if is_small(table):
        return rows.join(F.broadcast(table), key, how)
    hot = hot_keys(rows if keys_of is None else keys_of, key)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    salt = F.pmod(F.xxhash64(*(spread or rows.columns)), F.lit(SALTS)).cast("int")
    lanes = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.withColumn("_salt", F.when(is_hot | F.col(key).isNull(), salt).otherwise(0))
    right = table.withColumn("_salt", F.explode(lanes) if hot else F.lit(0))
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")


def in_ranges(df: DataFrame, keys: Sequence[str], order: str, parts: int | None = None) -> DataFrame:
    """Rows with ``_block``: sampled ranges of (keys, order) of about equal size, numbered in that order.

    However many rows a key or a day has, it is spread over as many ranges as it needs.  The rows are written,
    so that their ranges stay the same for everything that follows.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys, order).withColumn("_block", F.spark_partition_id())
    return materialize(dealt, "ranges")


def _carried(rows: DataFrame, keys: Sequence[str], total: Column) -> DataFrame:
    """(keys, ``_block``, ``_carry``): ``total``, an aggregate of ``_top``, over the blocks of a key before each one.

    One row per key and block: no more rows of a key than there are ranges.
    """
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_carry", total.over(before)).drop("_top")


def running_max_before(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str,
                       block: Column | None = None, parts: int | None = None) -> DataFrame:
    """Largest ``value`` among the earlier rows of a key, by unique ``order``.

    Ranges are scanned in parallel; one row per key and range carries the maximum across them.
    They are sampled, ``parts`` of them, or given as ``block``, numbers that follow the order.
    """
    rows = in_ranges(df, keys, order, parts) if block is None else df.withColumn("_block", block)
    carry = _carried(rows.groupBy(*keys, "_block").agg(F.max(value).alias("_top")), keys, F.max("_top"))
    inside = (Window.partitionBy(*keys, "_block").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (
        rows.withColumn("_inside", F.max(value).over(inside))
        .join(carry, [*keys, "_block"])
        .withColumn(out, F.greatest("_inside", "_carry"))
        .drop("_inside", "_carry", "_block")
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str,
                parts: int | None = None) -> DataFrame:
    """Sum of ``value`` over the rows of a key up to and including each one, by unique ``order``."""
    rows = in_ranges(df, keys, order, parts)
    carry = _carried(rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_top")), keys, F.sum("_top"))
    inside = (Window.partitionBy(*keys, "_block").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        rows.withColumn("_inside", F.sum(value).over(inside))
        .join(carry, [*keys, "_block"])
        .withColumn(out, F.col("_inside") + F.coalesce("_carry", F.lit(0)))
        .drop("_inside", "_carry", "_block")
    )


def trailing_count(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, out: str,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of the same key less than ``seconds`` old, the current one included.

    Keys with more than ``hot_rows`` rows and a noticeable share of all are counted by rank, others by blocks of time.
    """
    hot = hot_keys(df, keys[0], hot_rows) if len(keys) == 1 else []
    if not hot:
        return _count_in_blocks(df, keys, ts, seconds, out)
    is_hot = F.coalesce(F.col(keys[0]).isin(hot), F.lit(False))
    return _count_in_blocks(df.where(~is_hot), keys, ts, seconds, out).unionByName(
        _count_by_rank(df.where(is_hot), keys, ts, seconds, out))


def _count_by_rank(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, out: str) -> DataFrame:
    """The number of rows up to a time less that up to the window's far end.

    Both are running sums over the distinct times and far ends of a key, which lie in sampled ranges: a window
    that holds any number of rows is never gathered.
    """
    rows = df.withColumn("_us", F.unix_micros(ts))
    times = rows.groupBy(*keys, "_us").agg(F.count("*").alias("_n"))
    ends = times.select(*keys, (F.col("_us") - seconds * 1_000_000).alias("_us"), F.lit(0).cast("bigint").alias("_n"))
    points = times.unionByName(ends).groupBy(*keys, "_us").agg(F.sum("_n").alias("_n"))
    upto = running_sum(points, keys, "_us", "_n", "_upto").select(*keys, "_us", "_upto")
    far = upto.select(*keys, (F.col("_us") + seconds * 1_000_000).alias("_us"), F.col("_upto").alias("_gone"))
    return (rows.join(upto.join(far, [*keys, "_us"]), [*keys, "_us"])
            .withColumn(out, F.col("_upto") - F.col("_gone")).drop("_us", "_upto", "_gone"))


def _count_in_blocks(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, out: str) -> DataFrame:
    """Time is cut into blocks of several windows.  Rows of a block's last window are
    copied into the next one as context, so a window never looks beyond two
    blocks and a busy key is spread over its blocks.
    """
    micros = F.unix_micros(ts)
    width = seconds * 1_000_000
    span = width * WINDOWS_PER_BLOCK
    home = F.col("_home")
    late = F.col("_us") > (home + 1) * span - width
    frame = (Window.partitionBy(*keys, "_block").orderBy("_us").rangeBetween(-width + 1, Window.currentRow))
    return (
        df.withColumn("_us", micros)
        .withColumn("_home", ((F.col("_us") - F.pmod("_us", F.lit(span))) / span).cast("bigint"))
        .withColumn("_block", F.explode(F.when(late, F.array(home, home + 1)).otherwise(F.array(home))))
        .withColumn(out, F.count("*").over(frame))
        .where(F.col("_block") == home)
        .drop("_us", "_home", "_block")
    )

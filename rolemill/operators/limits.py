"""Admission limits and lockouts over recorded hits (batch form)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.plans.broadcast import broadcast_if_small
from rolemill.plans.session import materialize
from rolemill.plans.skew import HOT_ROWS, first_per_key, hot_keys, trailing_count

# Limits and windows.
DAILY_LIMIT = 10
WINDOW_S = 24 * 3600
PRUNE_S = 25 * 3600
FAILURE_LIMIT = 10
FAILURE_WINDOW_S = 3600

HOT_HITS = 5_000_000  # hits of one key that a single ordered pass may see

DECISION = "allowed boolean, remaining int, retry_after_s bigint"


class Admission:
    """State of one key: times (microseconds) of accepted hits, at most ``limit``."""

    def __init__(self, limit: int, window_s: int, prune_s: int, times=()):
        self.limit, self.window, self.prune = limit, window_s * 1_000_000, prune_s * 1_000_000
        self.times = deque(times)

    def hit(self, now: int) -> tuple[bool, int, int]:
        while self.times and self.times[0] < now - self.prune:
            self.times.popleft()
        used = len(self.times)
        if used >= self.limit:
            wait = -((now - self.times[0] - self.window) // 1_000_000)
            return False, 0, max(1, wait)
        if not self.times or self.times[-1] != now:  # a second hit at the same instant is stored once
            self.times.append(now)
        return True, self.limit - used - 1, 0

    def remember(self, then: int) -> tuple[None, None, None]:
        """Take over a hit that was accepted before."""
        self.times.append(then)
        return None, None, None


def rate_limit(hits: DataFrame, key: str, ts: str, limit: int = DAILY_LIMIT,
               window_s: int = WINDOW_S, prune_s: int = PRUNE_S, tie: str | None = None,
               stored: DataFrame | None = None, hot_hits: int = HOT_HITS,
               exempt: Column | None = None) -> DataFrame:
    """Decide every hit of every key in time order.

    ``stored`` holds hits accepted by earlier runs (same key and time columns).  Hits that are ``exempt``
    (administrators, callers with a key of their own) pass unlimited: they are allowed, use up nothing, and
    have no ``remaining``.

    Only accepted hits count against later ones, which makes this a recurrence
    that no window function expresses.  Ordinary keys stream through tasks in
    order; a key with more than ``hot_hits`` hits that also holds a noticeable
    share of all rows is decided from its packed instants.
    """
    if exempt is not None:
        free = F.coalesce(exempt, F.lit(False))
        limited = rate_limit(hits.where(~free), key, ts, limit, window_s, prune_s, tie, stored, hot_hits)
        return limited.unionByName(hits.where(free).withColumns({
            "allowed": F.lit(True), "remaining": F.lit(None).cast("int"), "retry_after_s": F.lit(0).cast("bigint")}))
    rows = hits.withColumn("_us", F.unix_micros(ts))
    past = None if stored is None else stored.select(key, F.unix_micros(ts).alias("_us")).distinct()
    hot = hot_keys(rows, key, hot_hits)
    if not hot:
        return _in_order(rows, past, key, limit, window_s, prune_s, tie)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    none = rows.select(key, "_us").where("false")
    usual = _in_order(rows.where(~is_hot), past if past is None else past.where(~is_hot),
                      key, limit, window_s, prune_s, tie)
    busy = _from_instants(rows.where(is_hot), none if past is None else past.where(is_hot),
                          key, limit, window_s, prune_s, tie)
    return usual.unionByName(busy)


def _in_order(rows: DataFrame, past: DataFrame | None, key: str, limit: int, window_s: int, prune_s: int,
              tie: str | None) -> DataFrame:
    """One ordered pass: Spark sorts (spilling to disk), tasks keep one key's accepted times."""
    schema = f"{_ddl(rows.drop('_us'))}, {DECISION}"
    rows = rows.withColumn("_past", F.lit(False))
    if past is not None:
        rows = rows.unionByName(past.withColumn("_past", F.lit(True)), allowMissingColumns=True)
    order = ["_us", F.desc("_past"), *([tie] if tie else [])]
    ordered = rows.repartition(F.col(key)).sortWithinPartitions(key, *order)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out = []
            for k, now, known in zip(*(batch.column(c).to_pylist() for c in (key, "_us", "_past"))):
                if state is None or k != current:
                    current, state = k, Admission(limit, window_s, prune_s)
                out.append(state.remember(now) if known else state.hit(now))
            allowed, remaining, retry = zip(*out) if out else ((), (), ())
            plain = batch.drop_columns(["_us", "_past"])
            decided = pa.RecordBatch.from_arrays(
                [*plain.columns, pa.array(allowed, pa.bool_()), pa.array(remaining, pa.int32()),
                 pa.array(retry, pa.int64())],
                names=[*plain.schema.names, "allowed", "remaining", "retry_after_s"])
            yield decided.filter(pc.invert(batch.column("_past")))

    return ordered.mapInArrow(decide, schema)


def _packed(instants: DataFrame, key: str, parts: int) -> DataFrame:
    """(key, lo, us): a key's instants in order, many to a row; the sort is spread over ranges of (key, time)."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            us, codes = batch.column("_us").to_numpy(), batch.column(key).dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            chunks = [np.unique(us[i:j]) for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(us)])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(starts)), pa.array([c[0] for c in chunks], pa.int64()),
                 pa.array([c.tobytes() for c in chunks], pa.binary())], names=[key, "lo", "us"])

    kind = instants.schema[key].dataType.simpleString()
    ordered = instants.select(key, "_us").repartitionByRange(parts, key, "_us").sortWithinPartitions(key, "_us")
    return ordered.mapInArrow(pack, f"`{key}` {kind}, lo bigint, us binary")


def admit(instants: np.ndarray, live: deque[int], past: deque[int], limit: int, prune: int) -> list[int]:
    """Instants that are newly accepted, in order; ``live`` (accepted times) and ``past`` (stored ones to come) move along.

    Never looks at a hit that is refused: with all slots taken, the next candidate is the first instant
    behind the time at which one becomes free, found by bisection.
    """
    taken, i = [], 0
    while i < len(instants):
        now = int(instants[i])
        while past and past[0] <= now:
            live.append(past.popleft())
        while live and live[0] < now - prune:
            live.popleft()
        if len(live) >= limit:
            i += int(np.searchsorted(instants[i:], live[len(live) - limit] + prune, "right"))
            continue
        if not live or live[-1] != now:
            live.append(now)
            taken.append(now)
        i += 1
    return taken


def _from_instants(rows: DataFrame, past: DataFrame, key: str, limit: int, window_s: int, prune_s: int,
                   tie: str | None) -> DataFrame:
    """The same decisions for few very busy keys, without their hits ever meeting in a task.

    A key's distinct instants are sorted over many tasks and packed, eight bytes each.  One task per key
    then reads these packs in order and jumps from one accepted instant to the next, holding a pack and the
    accepted times still remembered.  Every hit is decided where it is, against the accepted times around its
    stretch of time: at most ``limit`` per stretch besides stored ones.
    """
    prune = prune_s * 1_000_000
    kind = rows.schema[key].dataType.simpleString()
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packs = _packed(rows, key, parts).withColumn("past", F.lit(False)).unionByName(
        _packed(past, key, parts).withColumn("past", F.lit(True)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, live, before = None, deque(), deque()
        for batch in batches:
            keys, found = [], []
            for k, raw, is_past in zip(*(batch.column(c).to_pylist() for c in (key, "us", "past"))):
                us = np.frombuffer(raw, np.int64)
                if k != current:
                    current, live, before = k, deque(), deque()
                if is_past:  # stored hits of a key come first
                    before.extend(us.tolist())
                else:
                    accepted = admit(us, live, before, limit, prune)
                    keys += [k] * len(accepted)
                    found += accepted
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(key).type), pa.array(found, pa.int64())],
                                             names=[key, "_us"])

    ordered = packs.repartition(F.col(key)).sortWithinPartitions(key, F.desc("past"), "lo")
    taken = materialize(ordered.mapInArrow(walk, f"`{key}` {kind}, _us bigint"), "accepted")

    def around(times: DataFrame, name: str) -> DataFrame:
        stretch = F.floor(F.col("_us") / F.lit(prune))
        return (times.withColumn("_slice", F.explode(F.array(stretch, stretch + 1)))
                .groupBy(key, "_slice").agg(F.collect_list("_us").alias(name)))

    near = around(taken, "taken").join(around(past, "kept"), [key, "_slice"], "full_outer")
    at, none = F.col("_us"), F.array().cast("array<bigint>")
    live = F.concat(F.filter("taken", lambda a: (a < at) & (a >= at - prune)),
                    F.filter("kept", lambda a: (a <= at) & (a >= at - prune)))
    # Further hits at an accepted instant find its slot used but are not stored.
    again = F.array_contains("taken", at) & ~F.col("_first")
    wait = F.greatest(F.ceil((F.array_min("_live") + window_s * 1_000_000 - at) / F.lit(1e6)), F.lit(1))
    return (
        first_per_key(rows, [key, "_us"], [tie or "_us"], "_first").withColumn("_slice", F.floor(at / F.lit(prune)))
        .join(broadcast_if_small(near), [key, "_slice"], "left")
        .withColumns({"taken": F.coalesce("taken", none), "kept": F.coalesce("kept", none)})
        .withColumn("_live", F.concat(live, F.when(again, F.array(at)).otherwise(none)))
        .withColumn("_used", F.size("_live"))
        .withColumns({
            "allowed": F.col("_used") < limit,
            "remaining": F.greatest(limit - F.col("_used") - 1, F.lit(0)).cast("int"),
            "retry_after_s": F.when(F.col("_used") < limit, F.lit(0)).otherwise(wait).cast("bigint"),
        })
        .drop("_us", "_first", "_slice", "taken", "kept", "_live", "_used")
    )


def lockout(failures: DataFrame, key: str, ts: str, limit: int = FAILURE_LIMIT,
            window_s: int = FAILURE_WINDOW_S, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Failures with the count inside the trailing window and whether that locks.

    A key's failures at the same instant are stored once.  The window is open at
    its far end: a failure exactly ``window_s`` old no longer counts.
    """
    once = failures.select(key, ts).distinct()
    return trailing_count(once, [key], ts, window_s, "failures", hot_rows).withColumn(
        "locked", F.col("failures") > limit)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

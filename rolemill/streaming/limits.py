"""Stateful streams: admission limit, failure lockout, response cache.

Each keeps a small bounded state per key in the state store.  Micro-batches are
taken as they come, and the rows of a key inside one in time order, however Spark
cuts them into chunks: a task holds the times of one key and micro-batch, eight
bytes each, so the trigger's size bounds it.

A stream may take over what a batch store holds (``stored``): its rows become the
state before the first micro-batch.  With ``grace_s`` a key's state is dropped by a
timer once it cannot matter any more: rows may then come up to so many seconds behind
the latest one seen, and Spark drops those that come later still.  Without it nothing
is dropped, neither rows nor states.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rolemill.operators.limits import (
    DAILY_LIMIT, DECISION, FAILURE_LIMIT, FAILURE_WINDOW_S, PRUNE_S, WINDOW_S, Admission,
)

MICROS = 1_000_000
OUT_ROWS = 10_000  # rows of an output frame


def _times(rows: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """Times of a key in one micro-batch in order, in stretches of bounded length."""
    chunks = [pdf["us"].to_numpy(np.int64) for pdf in rows]
    ordered = np.sort(np.concatenate(chunks)) if chunks else np.zeros(0, np.int64)
    for at in range(0, len(ordered), OUT_ROWS):
        yield ordered[at:at + OUT_ROWS]


class _Expiring(StatefulProcessor):
    """State of a key that is dropped ``keep`` microseconds of event time behind its latest entry."""

    keep: int
    expires: bool

    def _keep_until(self, last: int | None) -> None:
        """Move the key's only timer behind its latest entry."""
        if self.expires:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if last is not None:
                self.handle.registerTimer((last + self.keep) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


class _LimitProcessor(_Expiring):
    """Accepted hit times of one key, at most ``limit`` of them."""

    def __init__(self, limit: int, window_s: int, prune_s: int, expires: bool):
        self.args, self.keep, self.expires = (limit, window_s, prune_s), prune_s * MICROS, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getListState("accepted", "us bigint")

    def forget(self) -> None:
        self.accepted.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        times = sorted({r[0] for r in self.accepted.get()} | set(initialState["us"].tolist()))
        self.accepted.put([(t,) for t in times])
        self._keep_until(times[-1] if times else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = Admission(*self.args, times=sorted(r[0] for r in self.accepted.get()))
        for us in _times(rows):
            decided = [state.hit(now) for now in us.tolist()]
            yield pd.DataFrame({
                "key": key[0], "us": us,
                "allowed": [d[0] for d in decided], "remaining": [d[1] for d in decided],
                "retry_after_s": [d[2] for d in decided]})
        self.accepted.put([(t,) for t in state.times])
        self._keep_until(state.times[-1] if state.times else None)


class _LockoutProcessor(_Expiring):
    """The latest ``limit + 1`` distinct failure times of one key: enough to decide exactly."""

    def __init__(self, limit: int, window_s: int, expires: bool):
        self.limit, self.window, self.keep, self.expires = limit, window_s * MICROS, window_s * MICROS, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "us bigint")

    def forget(self) -> None:
        self.recent.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        times = sorted({r[0] for r in self.recent.get()} | set(initialState["us"].tolist()))[-self.limit - 1:]
        self.recent.put([(t,) for t in times])
        self._keep_until(times[-1] if times else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(r[0] for r in self.recent.get())
        stored, last = set(times), None
        for us in _times(rows):
            fresh, locked = [], []
            for now in us.tolist():
                if now == last or now in stored:
                    continue
                last = now
                insort(times, now)
                del times[:-self.limit - 1]
                fresh.append(now)
                locked.append(sum(now - self.window < t <= now for t in times) > self.limit)
            yield pd.DataFrame({"key": key[0], "us": fresh, "locked": locked})
        self.recent.put([(t,) for t in times])
        self._keep_until(times[-1] if times else None)


class _SeenProcessor(_Expiring):
    """When a prompt hash was last answered anew; replies are kept for ``keep_s`` seconds, or for ever."""

    def __init__(self, keep_s: int | None, expires: bool):
        self.keep, self.expires, self.limited = (keep_s or 0) * MICROS, expires and keep_s is not None, keep_s is not None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at bigint")

    def forget(self) -> None:
        self.seen.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        times = initialState["us"].tolist() + ([self.seen.get()[0]] if self.seen.exists() else [])
        self.seen.update((max(times),))
        self._keep_until(max(times))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.seen.get()[0] if self.seen.exists() else None
        before = at
        for us in _times(rows):
            flags = []
            for now in us.tolist():
                flags.append(at is not None and not (self.limited and now - at > self.keep))
                if not flags[-1]:
                    at = now
            yield pd.DataFrame({"key": key[0], "us": us, "cached": flags})
        if at != before:
            self.seen.update((at,))
            self._keep_until(at)


def _run(stream: DataFrame, key: str, ts: str, processor: StatefulProcessor, out: str,
         stored: DataFrame | None, grace_s: int | None) -> DataFrame:
    named = [F.col(key).cast("string").alias("key"), F.unix_micros(ts).alias("us")]
    if grace_s is not None:
        rows = stream.withWatermark(ts, f"{grace_s} seconds").select(*named, F.col(ts).alias("ts"))
    else:
        rows = stream.select(*named)
    before = None if stored is None else stored.select(*named).where("key is not null").groupBy("key")
    decided = rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"key string, us bigint, {out}",
        outputMode="Append", timeMode="None" if grace_s is None else "EventTime", initialState=before)
    return decided.withColumn("ts", F.timestamp_micros("us")).drop("us")


def rate_limit_stream(hits: DataFrame, key: str, ts: str, limit: int = DAILY_LIMIT,
                      window_s: int = WINDOW_S, prune_s: int = PRUNE_S, stored: DataFrame | None = None,
                      grace_s: int | None = None) -> DataFrame:
    """Decisions by micro-batch, then time: (key, ts, allowed, remaining, retry_after_s).

    ``stored`` holds hits accepted before the stream began (same key and time columns).
    """
    return _run(hits, key, ts, _LimitProcessor(limit, window_s, prune_s, grace_s is not None), DECISION, stored, grace_s)


def lockout_stream(failures: DataFrame, key: str, ts: str, limit: int = FAILURE_LIMIT,
                   window_s: int = FAILURE_WINDOW_S, stored: DataFrame | None = None,
                   grace_s: int | None = None) -> DataFrame:
    """(key, ts, locked) for every distinct failure time; ``stored`` holds earlier failures."""
    return _run(failures, key, ts, _LockoutProcessor(limit, window_s, grace_s is not None), "locked boolean", stored, grace_s)


def cache_hits_stream(prompts: DataFrame, key: str, ts: str, stored: DataFrame | None = None,
                      keep_s: int | None = None, grace_s: int | None = None) -> DataFrame:
    """(key, ts, cached): the earliest row of a hash in its first micro-batch misses, others hit.

    ``stored`` holds replies given before (same key and time columns).  With ``keep_s`` a reply that is
    older counts as a miss and is given anew.
    """
    return _run(prompts, key, ts, _SeenProcessor(keep_s, grace_s is not None), "cached boolean", stored, grace_s)

"""Exactly-once effects of micro-batches on the state tables.

A stream may deliver a micro-batch again after a failure.  Whatever a batch decides
from the tables' state before it (its rows, its counters) is written once under the
stream's id and the batch's number and read back by later deliveries; its appends are
committed under the same name; and a marker written last, with the batch's counters,
lets a later delivery return at once.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from rolemill.plans.files import Files
from rolemill.plans.store import Delivery, Store


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps in a stream's checkpoint: batch numbers mean something only under it."""
    text = Files(spark).read(f"{checkpoint.rstrip('/')}/metadata")
    return json.loads(text.splitlines()[-1])["id"]


@dataclass(frozen=True)
class Commits:
    """What the micro-batches of one stream have done to a store."""

    store: Store
    stream: str

    @property
    def folder(self) -> str:
        return f"{self.store.root.rstrip('/')}/_commits/{self.stream}"

    def tag(self, batch: int) -> str:
        return f"{self.stream}-{batch}"

    def _files(self) -> Files:
        return Files(self.store.spark)

    def result(self, batch: int) -> dict | None:
        """Counters of a batch that is done, else None."""
        text = self._files().read(f"{self.folder}/{batch}.done")
        return None if text is None else json.loads(text)

    def commit(self, batch: int, counters: dict) -> dict:
        return json.loads(self._files().write_once(f"{self.folder}/{batch}.done", json.dumps(counters)))

    def note(self, batch: int, name: str, make: Callable[[], dict]) -> dict:
        """Counters that depend on the tables before the batch: made by the first delivery, read by others."""
        path = f"{self.folder}/{batch}.{name}"
        held = self._files().read(path)
        return json.loads(held if held is not None else self._files().write_once(path, json.dumps(make())))

    def stage(self, batch: int, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """Rows that depend on the tables before the batch, written once; a broken write is repeated."""
        path = f"{self.folder}/{batch}-{name}"
        if not self._files().exists(f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.store.spark.read.parquet(path)

    def totals(self, since: int = 0) -> dict:
        """Sums of the counters of all batches done from number ``since`` on; texts are joined, equal ones once."""
        done = sorted(int(n.removesuffix(".done")) for n in self._files().names(self.folder) if n.endswith(".done"))
        out: dict = {}
        for batch in done:
            if batch >= since:
                for name, value in self.result(batch).items():
                    if isinstance(value, str):
                        parts = out[name].split("; ") if name in out else []
                        out[name] = "; ".join(dict.fromkeys([*parts, *value.split("; ")]))
                    elif value is not None:
                        out[name] = out.get(name, 0) + value
        return out


class BatchDelivery(Delivery):
    """One micro-batch: every decision is kept under its number, every append is committed once."""

    def __init__(self, commits: Commits, batch: int):
        super().__init__(commits.store)
        self.commits, self.batch = commits, batch

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return self.commits.stage(self.batch, name, make)

    def note(self, name: str, make: Callable[[], dict]) -> dict:
        return self.commits.note(self.batch, name, make)

    def append(self, table: str, rows: DataFrame) -> None:
        self.store.append_once(table, rows, self.commits.tag(self.batch))


def exactly_once(store: Store, checkpoint: str, apply: Callable[[Delivery, DataFrame], dict],
                 after: Callable[[Commits, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function whose effects happen once per batch, however often it is delivered.

    ``apply`` returns the batch's counters.  ``after(commits, first)`` follows every delivery; ``first`` is
    the first batch of this run, so sums of a run come from `Commits.totals`; it must be repeatable.
    """
    first: list[int] = []

    def run(batch: DataFrame, number: int) -> None:
        commits = Commits(store, stream_id(store.spark, checkpoint))
        first.append(number)
        if commits.result(number) is None:
            commits.commit(number, apply(BatchDelivery(commits, number), batch))
        if after is not None:
            after(commits, min(first))

    return run

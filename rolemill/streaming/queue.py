"""The embedding queue as a stream: notices of waiting rows, drained per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.functions.vectors import EMBEDDING_DIM
from rolemill.operators.embedding import (
    MODEL, Encoder, cache_rows, candidates, row_results, text_vectors, tick_stats, write_back,
)
from rolemill.operators.upsert import new_rows
from rolemill.plans.broadcast import narrow
from rolemill.plans.store import Delivery, Store
from rolemill.streaming.commits import exactly_once

#: Table and key of each kind of row that can wait.
WAITING = {"job": ("jobs", "content_hash"), "cv": ("cv_profiles", "id")}


def drain_batches(store: Store, make_encoder: Callable[[], Encoder], as_of: Column, checkpoint: str,
                  dim: int = EMBEDDING_DIM, model: str = MODEL) -> Callable[[DataFrame, int], None]:
    """Embed the rows that notices (``kind``, ``id``) name, if they still wait; each micro-batch counts once.

    A batch fixes its queue first and its vectors second, so a later delivery neither asks the encoder
    again nor counts a failure twice; rows that another batch has embedded since are not in it.
    """
    def apply(delivery: Delivery, notices: DataFrame) -> dict:
        def named(kind: str) -> DataFrame:
            table = store.read(WAITING[kind][0])
            return narrow(table, notices.where(F.col("kind") == kind).select("id").distinct(), ["id"]).join(
                notices.where(F.col("kind") == kind).select("id").distinct(), "id", "left_semi")

        waiting = delivery.stage("queue", lambda: candidates(named("job"), store.read("job_skills"), named("cv")))
        vectors = delivery.stage("vectors", lambda: text_vectors(
            waiting, store.read("embedding_cache"), make_encoder, dim))
        results = delivery.stage("results", lambda: row_results(waiting, vectors))
        # Vectors enter the cache first, so a run that stops half way finds them there.
        delivery.append("embedding_cache", new_rows(store.read("embedding_cache"), cache_rows(vectors, as_of, dim, model),
                                                    ["content_hash"], "content_hash", narrow_state=True))
        for kind, (table, key) in WAITING.items():
            mine = results.where(F.col("kind") == kind)
            touched = narrow(store.read(table), mine.select("id"), ["id"]).join(mine.select("id"), "id", "left_semi").select(key)
            store.change(table, touched, lambda state, mine=mine: write_back(state, mine, as_of))
        return tick_stats(results).first().asDict()

    return exactly_once(store, checkpoint, apply)

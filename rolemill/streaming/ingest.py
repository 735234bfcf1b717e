"""Incremental ingest: every micro-batch of landed files goes through the batch upsert."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from rolemill.operators.admin import ERROR_CHARS
from rolemill.plans.broadcast import narrow
from rolemill.plans.files import Files
from rolemill.plans.ingest import FeedRun, log_runs, run_feed
from rolemill.plans.isolation import message_of
from rolemill.plans.session import shared_folder
from rolemill.plans.store import Delivery, Store
from rolemill.sources.landing import read_payloads
from rolemill.streaming.commits import Commits, exactly_once


def upsert_stream(stream: DataFrame, apply: Callable[[DataFrame, int], None],
                  checkpoint: str | None = None) -> StreamingQuery:
    """Feed every available micro-batch to ``apply`` and stop.

    ``apply`` must be repeatable: a batch may be delivered again after a failure.
    No watermark is set, because a late record is simply the latest arrival.
    """
    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint or shared_folder(stream.sparkSession, "stream"))
        .trigger(availableNow=True).start()
    )


def ingest_batches(store: Store, feed: str, as_of: Column, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """Apply micro-batches of a feed's payloads to the store, each once.

    The run log counts every payload once, however often its micro-batch is delivered.  A board that raises is
    named in the run log and left out, as in a batch run; what fails for the whole feed stops the stream,
    which then starts again at the same files.
    """
    def apply(delivery: Delivery, batch: DataFrame) -> dict:
        run = run_feed(delivery, batch, feed, as_of)
        return {"fetched": run.fetched, "inserted": run.inserted, "updated": run.updated,
                "rejected": run.rejected, "error": run.error}

    def log(commits: Commits, first: int) -> None:
        log_runs(store, [feed_totals(feed, commits.totals(first))], as_of)

    once = exactly_once(store, checkpoint, apply, log)

    def deliver(batch: DataFrame, number: int) -> None:
        try:
            once(batch, number)
        except Exception as err:
            log_runs(store, [FeedRun(feed, error=message_of(err)[:ERROR_CHARS])], as_of)
            raise

    return deliver


def ingest_stream(spark: SparkSession, landing: str, store: Store, feed: str, as_of: Column,
                  checkpoint: str, max_files: int | None = None) -> StreamingQuery:
    """Ingest the files of one feed that landed since the last run."""
    return upsert_stream(read_payloads(spark, landing, feed, streaming=True, max_files=max_files),
                         ingest_batches(store, feed, as_of, checkpoint), checkpoint)


def feed_totals(feed: str, totals: dict) -> FeedRun:
    error = totals.pop("error", None)
    return FeedRun(feed, error=error and error[:ERROR_CHARS], **totals)


def log_batches(store: Store, table: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """Append micro-batches to a log table, such as usage; one that is delivered twice is there once."""
    def apply(delivery: Delivery, batch: DataFrame) -> dict:
        rows = delivery.stage("rows", lambda: batch)
        delivery.append(table, rows)
        return {"rows": rows.count()}

    return exactly_once(store, checkpoint, apply)


def read_folded(spark: SparkSession, path: str, keys: Sequence[str], schema: StructType, below: int | None = None) -> DataFrame:
    """The latest row of every key over all versions of a folded table, or those below a number."""
    versions = sorted(int(n.removeprefix("v=")) for n in Files(spark).names(path) if n.startswith("v="))
    wanted = [f"{path}/v={n}" for n in versions if below is None or n < below]
    if not wanted:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields, StructField("v", IntegerType())])).option("basePath", path).parquet(*wanted)
    if len(wanted) == 1:
        return rows.drop("v")
    # Numbers are compared first, so wide rows are joined once and never sorted.
    newest = rows.groupBy(*keys).agg(F.max("v").alias("v"))
    return rows.join(newest, [*keys, "v"]).drop("v")


def fold_stream(stream: DataFrame, path: str, keys: Sequence[str], schema: StructType,
                merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str | None = None) -> StreamingQuery:
    """Keep a folded table as versions: version ``n`` has the rows of the keys in batch ``n``, merged with what was known.

    A batch reads and writes its own keys only (`read_folded` puts the versions together).  Versions are named by
    batch number, so a repeated batch rewrites its own.
    """
    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = batch.select(*keys).distinct()
        known = read_folded(spark, path, keys, schema, below=number)
        before = narrow(known, touched, keys).join(touched, list(keys), "left_semi")
        merge(before, batch).select(*schema.names).write.mode("overwrite").parquet(f"{path}/v={number}")

    return upsert_stream(stream, apply, checkpoint)

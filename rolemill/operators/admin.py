"""Operational reads and writes: run log, counters, error roll-up, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemill.operators.search import STALE_DAYS
from rolemill.operators.upsert import delete_with_children, upsert

ERROR_CHARS = 1000
RUN_COLUMNS = ["last_run_at", "last_status", "last_error", "jobs_fetched", "embedding_pending_count"]


def status_counts(df: DataFrame, status: str, wanted: dict[str, str]) -> DataFrame:
    """One row: total, and one counter per (name, status value)."""
    return df.agg(F.count("*").alias("total"),
                  *[F.count_if(F.col(status) == v).alias(n) for n, v in wanted.items()])


def job_stats(jobs: DataFrame) -> DataFrame:
    return status_counts(jobs, "embedding_status", {"embedded": "embedded", "pending": "pending"})


def pending_total(tables: list[DataFrame], status: str = "embedding_status", value: str = "pending") -> DataFrame:
    """Pending rows over several tables."""
    counts = [t.where(F.col(status) == value).agg(F.count("*").alias("n")) for t in tables]
    return reduce(lambda a, b: a.unionByName(b), counts).agg(F.sum("n").alias("pending"))


def source_health(run_log: DataFrame) -> DataFrame:
    return run_log.orderBy("name")


def record_run(run_log: DataFrame, runs: DataFrame) -> DataFrame:
    """Upsert run results (unique by name) into the run log."""
    return upsert(run_log, runs, ["name"], replace=RUN_COLUMNS)


def run_result(errors: DataFrame, fetched: DataFrame, key: str = "source") -> DataFrame:
    """(key, fetched, last_error, last_status) per source."""
    return (
        fetched.join(errors, key, "left")
        .withColumn("last_status", F.when(F.col("last_error").isNull(), "ok").otherwise("error"))
    )


def roll_up_errors(errors: DataFrame, key: str, part: str, message: str,
                   max_chars: int = ERROR_CHARS) -> DataFrame:
    """Per key: ``part: message`` joined by ``; ``, cut to ``max_chars``.

    Only the entries that start before the cut are gathered.  Every entry takes its separator
    at least, so the first ``max_chars / 2 + 2`` of a key hold all of them; tasks cut to that
    many before keys meet, as long as it is below Spark's window group limit.
    """
    text = F.concat_ws(": ", part, message)
    before = Window.partitionBy(key).orderBy(part, message)
    entry = F.struct("_n", F.col("_text").alias("text"))
    return (
        errors.withColumn("_text", text).withColumn("_n", F.row_number().over(before))
        .where(F.col("_n") <= max_chars // 2 + 2)
        .withColumn("_start", F.sum(F.length("_text") + 2).over(
            before.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("_text") - 2)
        .where(F.col("_start") < max_chars + 2)  # its separator stands before it
        .groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
        .select(key, F.left(F.array_join(F.transform("_all", lambda e: e["text"]), "; "),
                            F.lit(max_chars)).alias("last_error"))
    )


def retain(jobs: DataFrame, job_sources: DataFrame, job_skills: DataFrame, as_of: Column,
           days: int = STALE_DAYS) -> dict[str, DataFrame]:
    """Remove postings not seen for ``days``, with their sources and skills."""
    dead = F.col("last_seen_at") < as_of - F.make_dt_interval(F.lit(days))
    out = delete_with_children(jobs, dead, "id", {
        "job_sources": (job_sources, "job_id"), "job_skills": (job_skills, "job_id")})
    out["jobs"] = out.pop("parent")
    return out

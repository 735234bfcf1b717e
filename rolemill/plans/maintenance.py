"""Runs over the state tables: document upload, embedding drain, retention, sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.functions.vectors import EMBEDDING_DIM
from rolemill.operators.admin import retain
from rolemill.operators.embedding import MODEL, Encoder, drain_queue, write_back
from rolemill.operators.search import STALE_DAYS
from rolemill.operators.upsert import new_rows
from rolemill.plans.session import materialize
from rolemill.plans.store import Store
from rolemill.sources.documents import parse_profiles, profile_rows, route_documents


def upload(store: Store, files: DataFrame, terms: DataFrame, as_of: Column) -> DataFrame:
    """Parse documents into profile and skill rows; returns the rejected ones with reasons.

    Document ids derive from their paths, so a repeated upload adds nothing.
    """
    texts, rejected = route_documents(files, once=True)
    parsed = materialize(parse_profiles(texts, terms, as_of), "profiles")
    profiles, skills = profile_rows(parsed, as_of)
    store.append("cv_profiles", new_rows(store.read("cv_profiles"), profiles, ["id"], "id", True))
    store.append("cv_skills", new_rows(store.read("cv_skills"), skills, ["cv_id", "skill"], "cv_id", True))
    unreadable = parsed.where(F.col("reject_reason").isNotNull()).select("id", "filename", "reject_reason")
    return rejected.select("id", "filename", "reject_reason").unionByName(unreadable)


def drain(store: Store, make_encoder: Callable[[], Encoder], as_of: Column, dim: int = EMBEDDING_DIM,
          model: str = MODEL) -> dict[str, int]:
    """Embed everything queued in the store; returns the counters of the run.

    Vectors enter the cache first, so a run that stops half way finds them there.
    """
    jobs, cvs = store.read("jobs"), store.read("cv_profiles")
    out = drain_queue(jobs, store.read("job_skills"), cvs, store.read("embedding_cache"), make_encoder,
                      as_of, dim, model)
    # The queue is part of the tables that change below, so its outcome is fixed first.
    results = materialize(out.results, "embedded")
    stats = out.stats.first().asDict()
    store.append("embedding_cache", new_rows(
        store.read("embedding_cache"), out.new_cache, ["content_hash"], "content_hash"))
    for name, kind, table, key in [("jobs", "job", jobs, "content_hash"), ("cv_profiles", "cv", cvs, "id")]:
        mine = results.where(F.col("kind") == kind)
        touched = table.join(mine.select("id"), "id", "left_semi").select(key)
        store.change(name, touched, lambda state, mine=mine: write_back(state, mine, as_of))
    return stats


def remove_stale(store: Store, as_of: Column, days: int = STALE_DAYS) -> None:
    """Delete postings not seen for ``days`` with their links; children go first."""
    kept = retain(store.read("jobs"), store.read("job_sources"), store.read("job_skills"), as_of, days)
    for name in ("job_skills", "job_sources", "jobs"):
        store.overwrite(name, kept[name])


def record(store: Store, name: str, rows: DataFrame, keys: Sequence[str] = (), order: str = "arrival") -> None:
    """Append to a log table; with ``keys``, only rows whose key is new."""
    store.append(name, new_rows(store.read(name), rows, keys, order) if keys else rows)

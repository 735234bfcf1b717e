"""Postings from the landing zone into the state tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemill import schemas
from rolemill.functions.identity import content_hash, job_id, job_summary
from rolemill.functions.text import strip_html
from rolemill.operators import admin
from rolemill.operators.upsert import fold, new_rows, replace_sets, upsert
from rolemill.plans.broadcast import narrow
from rolemill.plans.isolation import isolate, message_of
from rolemill.plans.session import materialize
from rolemill.plans.store import Delivery, Store
from rolemill.sources.adapters import normalize, split_rejects, union_all
from rolemill.sources.boards import enabled_boards, with_board
from rolemill.sources.landing import UNREADABLE, parse_payloads, read_payloads, select_feeds

GENERIC_PLACE = r"(?i)\A(remote|hybrid|onsite)\z"

# How a posting that is seen again changes the stored row.
FIRST_WINS = ["title", "company", "remote_allowed", "seniority", "salary_min", "salary_max",
              "salary_currency", "salary_period", "url"]
LAST_WINS = ["location", "description", "summary"]
LAST_GIVEN_WINS = ["posted_at"]
EMBEDDING = ["embedding", "embedding_status", "embedding_retry_count", "embedding_last_attempt_at"]


def with_headquarters(location: Column, hq: Column) -> Column:
    """A bare "Remote", "Hybrid" or "Onsite", or nothing, is completed by the headquarters."""
    empty = F.coalesce(location, F.lit("")) == ""
    return (
        F.when(hq.isNotNull() & empty, hq)
        .when(hq.isNotNull() & location.rlike(GENERIC_PLACE), F.concat(location, F.lit(" · "), hq))
        .otherwise(location)
    )


def enrich(postings: DataFrame) -> DataFrame:
    """Content hash, id, summary; then plain-text description and completed location.

    Hash and summary describe the posting as published, before the headquarters
    are added and before skills are deduplicated.
    """
    return (
        postings.withColumn("content_hash", content_hash(
            F.col("company"), F.col("title"), F.col("location"), F.col("skills")))
        .withColumns({
            "id": job_id(F.col("content_hash")),
            "summary": job_summary(F.col("title"), F.col("company"), F.col("skills"), F.col("location"),
                                   F.col("seniority"), F.col("salary_min"), F.col("salary_max"),
                                   F.col("salary_currency")),
            "description": strip_html(F.col("description")),
        })
        .withColumn("location", with_headquarters(F.col("location"), F.col("hq_location")))
    )


def scan_feed(payloads: DataFrame, feed: str, companies: DataFrame | None = None) -> DataFrame:
    """Payload rows of one feed to normalized records (with reject reasons)."""
    raw = parse_payloads(payloads, feed)
    if schemas.FEEDS[feed].per_board:
        raw = with_board(raw, companies, feed)
    return normalize(raw, feed)


def upsert_jobs(state: DataFrame, batch: DataFrame, as_of: Column, order: str = "arrival",
                earliest_posted: bool = False) -> DataFrame:
    """Jobs after applying a batch of enriched postings in arrival order.

    The first sighting supplies title, company, link, level, pay and remote
    flag; every later one only moves location, description, summary, the last
    sighting and a given posting date.  Embedding state and ``updated_at`` are
    untouched by sightings.  ``earliest_posted`` keeps the earliest posting date
    instead of the latest.
    """
    folded = fold(batch, ["content_hash"], first=["id", *FIRST_WINS], last=LAST_WINS,
                  last_non_null=LAST_GIVEN_WINS, order=order)
    if earliest_posted:
        dates = batch.groupBy("content_hash").agg(F.min("posted_at").alias("posted_at"))
        folded = folded.drop("posted_at").join(dates, "content_hash")
        merged = state.select("content_hash", F.col("posted_at").alias("_was"))
        folded = (folded.join(merged, "content_hash", "left")
                  .withColumn("posted_at", F.least("posted_at", "_was")).drop("_was"))
    fresh = folded.withColumns({
        "embedding": F.lit(None).cast("array<float>"), "embedding_status": F.lit("pending"),
        "embedding_retry_count": F.lit(0),
        "embedding_last_attempt_at": F.lit(None).cast("timestamp"),
        "fetched_at": as_of, "last_seen_at": as_of, "updated_at": as_of,
    })
    return upsert(state, fresh, ["content_hash"],
                  insert_only=["id", *FIRST_WINS, *EMBEDDING, "fetched_at", "updated_at"],
                  replace=[*LAST_WINS, "last_seen_at"], replace_if_given=LAST_GIVEN_WINS)


def source_links(batch: DataFrame, as_of: Column) -> DataFrame:
    return batch.select(F.col("id").alias("job_id"), "source", "source_job_id",
                        as_of.alias("first_seen_at"), "arrival")


def count_batch(store: Store, batch: DataFrame) -> dict[str, int]:
    """How many postings of a batch are new and how many are stored, before it is written."""
    distinct = batch.select("content_hash").distinct()
    known = narrow(store.read("jobs").select("content_hash"), distinct, ["content_hash"])
    total = distinct.count()
    updated = distinct.join(known, "content_hash", "left_semi").count()
    return {"inserted": total - updated, "updated": updated}


def write_batch(delivery: Delivery, batch: DataFrame, as_of: Column) -> None:
    """Write one batch of enriched postings, held by a table, to all three tables.

    Every step gives the same tables when it is repeated, so a batch that was
    interrupted is simply applied again.
    """
    store = delivery.store
    keys = batch.select("content_hash", F.col("id").alias("job_id"))
    store.change("jobs", keys, lambda s: upsert_jobs(s, batch, as_of))
    delivery.append("job_sources", new_rows(
        store.read("job_sources"), source_links(batch, as_of), ["job_id", "source"], narrow_state=True))
    skills = batch.select(F.col("id").alias("job_id"), F.col("skills").alias("new_skills"), "arrival")
    store.change("job_skills", keys, lambda s: replace_sets(s, skills, "job_id", "skill", "new_skills"))


def apply_batch(store: Store, batch: DataFrame, as_of: Column) -> tuple[int, int]:
    """Write one batch of enriched postings to all three tables: (inserted, updated)."""
    batch = materialize(batch, "batch")
    counts = count_batch(store, batch)
    write_batch(Delivery(store), batch, as_of)
    return counts["inserted"], counts["updated"]


@dataclass
class FeedRun:
    feed: str
    fetched: int = 0
    inserted: int = 0
    updated: int = 0
    rejected: int = 0
    error: str | None = None


def _scanned(payloads: DataFrame, feed: str, companies: DataFrame, boards: Sequence[str] | None = None) -> DataFrame:
    """Normalized and enriched records of a feed, or of a stretch of its boards, written once.

    Everything that depends on a record's content happens here, so a record that makes a task raise
    raises here and not while tables change.
    """
    if boards is not None:
        payloads = payloads.where(F.col("board").between(boards[0], boards[-1]))
    return materialize(enrich(scan_feed(payloads, feed, companies)), f"scan-{feed}")


def scan_isolated(payloads: DataFrame, feed: str, companies: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """(scan, message by failing board) of a feed; a board that raises in a task leaves the others alone.

    Usually one job.  A feed of boards that fails is scanned again by halves of its boards, in order of
    their names; payloads of other boards are then not read.  What fails for every board, or a feed
    without boards, raises.
    """
    if not schemas.FEEDS[feed].per_board:
        return _scanned(payloads, feed, companies), {}
    try:
        return _scanned(payloads, feed, companies), {}
    except Exception:  # noqa: BLE001 - which board it was is found below
        boards = sorted({r["board"] for r in enabled_boards(companies, feed).select("board").distinct().collect()})
        found = isolate(boards, lambda some: _scanned(payloads, feed, companies, some))
        if not found.results:
            raise
        return materialize(union_all(found.results), f"scan-{feed}"), found.failed


def run_feed(delivery: Delivery, payloads: DataFrame, feed: str, as_of: Column) -> FeedRun:
    """Scan, count and write one feed; boards that raise are left out and named in the run's error."""
    store, held = delivery.store, []

    def scan() -> tuple[DataFrame, dict[str, str]]:
        if not held:
            held.append(scan_isolated(payloads, feed, store.read("companies")))
        return held[0]

    scanned = delivery.stage("scan", lambda: scan()[0])
    failed = delivery.note("failed", lambda: scan()[1])
    good, bad = split_rejects(scanned)
    # Every record that arrived counts as fetched; an unreadable payload holds none.
    reason = F.coalesce("reject_reason", F.lit(""))

    def count() -> dict[str, int]:
        seen = scanned.agg(F.count_if(reason != UNREADABLE).alias("fetched"), F.count_if(reason != "").alias("rejected"))
        return seen.first().asDict() | count_batch(store, good)

    run = FeedRun(feed, **delivery.note("counts", count))
    write_batch(delivery, good, as_of)
    # Unreadable payloads and boards that raise are errors of the run; single bad records are only set aside.
    part = F.nullif(F.regexp_replace(F.coalesce("source", F.lit("")), f"^{feed}:?", ""), F.lit(""))
    broken = bad.where(F.col("reject_reason") == UNREADABLE).select(
        F.lit(feed).alias("name"), part.alias("part"), "reject_reason").distinct()
    if failed:
        broken = broken.unionByName(store.spark.createDataFrame(
            [(feed, board, message) for board, message in failed.items()], broken.schema))
    rolled = admin.roll_up_errors(broken, "name", "part", "reject_reason").first()
    run.error = rolled["last_error"] if rolled else None
    return run


def ingest_payloads(store: Store, payloads_of: Callable[[str], DataFrame], feeds: Iterable[str],
                    as_of: Column) -> list[FeedRun]:
    """Run feeds one by one; a feed that fails is logged and never stops the others."""
    runs = []
    for feed in feeds:
        try:
            run = run_feed(Delivery(store), payloads_of(feed), feed, as_of)
        except Exception as err:  # noqa: BLE001 - isolation between feeds is the point
            run = FeedRun(feed, error=message_of(err)[:admin.ERROR_CHARS])
        runs.append(run)
    log_runs(store, runs, as_of)
    return runs


def log_runs(store: Store, runs: list[FeedRun], as_of: Column) -> None:
    """Upsert one run-log row per feed."""
    pending = admin.pending_total([store.read("jobs")]).first()["pending"]
    rows = store.spark.createDataFrame(
        [(r.feed, "error" if r.error else "ok", r.error, r.fetched, pending) for r in runs],
        "name string, last_status string, last_error string, jobs_fetched bigint, "
        "embedding_pending_count bigint").withColumn("last_run_at", as_of)
    store.change("sources", rows, lambda s: admin.record_run(s, rows))


def ingest(spark: SparkSession, landing: str, store: Store, as_of: Column,
           sources: Iterable[str] | None = None) -> list[FeedRun]:
    """Ingest all feeds, or the selected ones, from the landing zone."""
    return ingest_payloads(store, lambda feed: read_payloads(spark, landing, feed),
                           select_feeds(sources), as_of)

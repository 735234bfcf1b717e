"""Registry of company boards: checks, lookups, changes and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.functions.text import trim_ws
from rolemill.operators.upsert import fold, upsert
from rolemill.plans.broadcast import broadcast_if_small
from rolemill.schemas import BOARD_TYPES

MAX_NAME = 200


def check_boards(requests: DataFrame) -> DataFrame:
    """Cleaned registry requests with a ``reject_reason`` for invalid ones.

    Only an explicit ``enabled = false`` disables a board.
    """
    name, slug = trim_ws(F.coalesce("name", F.lit(""))), trim_ws(F.coalesce("board_slug", F.lit("")))
    hq = F.nullif(trim_ws(F.col("hq_location")), F.lit(""))
    return requests.withColumns({
        "name": name,
        "board_slug": slug,
        "hq_location": F.left(hq, F.lit(MAX_NAME)),
        "enabled": F.coalesce(F.col("enabled"), F.lit(True)),
    }).withColumn(
        "reject_reason",
        F.when(~F.length("name").between(1, MAX_NAME), "invalid name")
        .when(~F.length("board_slug").between(1, MAX_NAME), "invalid board slug")
        .when(F.col("ats_type").isNull() | ~F.col("ats_type").isin(*BOARD_TYPES), "invalid board type"),
    )


def enabled_boards(companies: DataFrame, feed: str) -> DataFrame:
    return companies.where((F.col("ats_type") == feed) & F.col("enabled")).select(
        F.col("board_slug").alias("board"), F.col("name").alias("board_company"), "hq_location")


def with_board(raw: DataFrame, companies: DataFrame, feed: str) -> DataFrame:
    """Raw board records with the registry's company and headquarters.

    Records of unknown or disabled boards drop out.
    """
    return raw.join(broadcast_if_small(enabled_boards(companies, feed)), "board")


def upsert_boards(companies: DataFrame, requests: DataFrame, as_of, order: str = "arrival") -> DataFrame:
    """Insert or update boards by (name, type); the last request in a batch wins."""
    key = ["name", "ats_type"]
    changing = ["board_slug", "hq_location", "enabled"]
    batch = fold(requests, key, last=changing, order=order).withColumns({
        "id": F.sha2(F.concat_ws("|", *key), 256),
        "created_at": as_of, "updated_at": as_of,
    })
    return upsert(companies, batch, key, insert_only=["id", "created_at"],
                  replace=[*changing, "updated_at"])


def disable_boards(companies: DataFrame, ids: list[str], as_of) -> DataFrame:
    hit = F.col("id").isin(ids)
    return companies.withColumns({
        "enabled": F.col("enabled") & ~hit,
        "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at")),
    })


def delete_boards(companies: DataFrame, ids: list[str]) -> DataFrame:
    return companies.where(~F.col("id").isin(ids))


def boards_with_counts(companies: DataFrame, job_sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every board with its number of postings, latest change first.

    Links are counted per source before the registry is joined, so a board that
    holds most postings costs no more than any other.
    """
    counts = (
        job_sources.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
        .groupBy("source").agg(F.count("*").alias("job_count"))
    )
    keyed = companies.withColumn("source", F.concat("ats_type", F.lit(":"), "board_slug"))
    return (
        keyed.join(counts, "source", "left").drop("source")
        .withColumn("job_count", F.coalesce("job_count", F.lit(0)))
        .orderBy(F.desc_nulls_first("updated_at"), F.desc("id"))
    )

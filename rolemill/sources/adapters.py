"""Raw records of each feed to the common posting columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.functions.salary import SALARY_TYPE, parse_salary
from rolemill.functions.seniority import seniority
from rolemill.functions.text import strip_html

UNKNOWN = "Unknown"

# Currency of yearly pay by country name.
COUNTRY_CURRENCY = {
    "australia": "AUD",
    "new zealand": "NZD",
    "singapore": "SGD",
    "india": "INR",
    "canada": "CAD",
    "united states": "USD",
    "united kingdom": "GBP",
    "germany": "EUR",
    "netherlands": "EUR",
}


def _text(value: str | None = None) -> Column:
    return F.lit(value).cast("string")


def _lowered(tags: Column) -> Column:
    return F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _says_remote(text: Column) -> Column:
    """True or false for a given text, null without one."""
    return F.when(F.length(text) > 0, text.rlike("(?i)remote"))


def _moment(text: Column) -> Column:
    """Timestamp of an ISO text; without an offset it is UTC, unreadable is null."""
    return F.try_to_timestamp(_filled(text))


def _epoch(number: Column) -> Column:
    """Seconds below 1e12, else milliseconds; zero counts as missing."""
    millis = F.when(F.abs(number) < 1e12, number * 1000).otherwise(number)
    return F.when(number != 0, F.timestamp_millis(millis.cast("bigint")))


def _plain_number(number: Column) -> Column:
    whole = number.cast("bigint")
    return F.when(number == whole, whole.cast("string")).otherwise(number.cast("string"))


def _arbeitnow(raw: Column) -> dict[str, Column]:
    stamp = raw["created_at"]
    return dict(
        source_job_id=raw["id"], title=raw["title"], company=raw["company_name"],
        location=raw["location"], remote_allowed=raw["remote"],
        description=strip_html(raw["description"]),
        url=F.coalesce(
            raw["url"],
            F.concat(F.lit("https://www.arbeitnow.com/jobs/"), _filled(raw["company_slug"]),
                     F.lit("/"), _filled(raw["slug"])),
            F.lit("https://www.arbeitnow.com")),
        skills=_lowered(raw["tags"]),
        posted_at=F.coalesce(_epoch(stamp.try_cast("double")), _moment(stamp)),
        salary_text=raw["salary"],
    )


def _remotive(raw: Column) -> dict[str, Column]:
    tags = F.coalesce(raw["tags"], F.array().cast("array<string>"))
    return dict(
        source_job_id=raw["id"], title=raw["title"], company=raw["company_name"],
        location=raw["candidate_required_location"], remote_allowed=F.lit(True),
        description=strip_html(raw["description"]),
        url=F.coalesce(raw["url"], F.lit("https://remotive.com/remote-jobs")),
        skills=_lowered(F.concat(tags, F.array_compact(F.array(_filled(raw["category"]))))),
        posted_at=_moment(raw["publication_date"]),
        salary_text=raw["salary"],
    )


def _remoteok(raw: Column) -> dict[str, Column]:
    return dict(
        source_job_id=F.coalesce(raw["id"], raw["slug"], F.lit("")),
        title=raw["position"], company=raw["company"], location=raw["location"],
        remote_allowed=F.lit(True), description=strip_html(raw["description"]),
        url=F.coalesce(
            raw["url"], F.concat(F.lit("https://remoteok.com/remote-jobs/"), _filled(raw["slug"])),
            F.lit("https://remoteok.com")),
        skills=_lowered(raw["tags"]),
        posted_at=F.coalesce(
            F.when(raw["epoch"] != 0, F.timestamp_seconds(raw["epoch"])), _moment(raw["date"])),
        salary_text=F.concat(_plain_number(raw["salary_min"]), F.lit(" - "),
                             _plain_number(raw["salary_max"])),
    )


def _adzuna(raw: Column) -> dict[str, Column]:
    area = raw["location"]["area"]
    currencies = F.create_map(*[F.lit(x) for pair in COUNTRY_CURRENCY.items() for x in pair])
    paid = raw["salary_min"].isNotNull() | raw["salary_max"].isNotNull()
    return dict(
        source_job_id=F.concat_ws(":", F.col("country"), raw["id"]),
        title=raw["title"],
        company=F.coalesce(raw["company"]["display_name"], F.lit("Confidential Employer")),
        location=F.when(
            F.size(area) >= 3, F.concat_ws(", ", F.get(area, F.lit(2)), F.get(area, F.lit(0)))
        ).otherwise(raw["location"]["display_name"]),
        remote_allowed=F.when(raw["title"].rlike("(?i)remote|work from home"), True),
        description=strip_html(raw["description"]), url=raw["redirect_url"],
        skills=F.array().cast("array<string>"), posted_at=_moment(raw["created"]),
        salary=F.when(paid, F.struct(
            raw["salary_min"].cast("bigint").alias("salary_min"),
            raw["salary_max"].cast("bigint").alias("salary_max"),
            F.try_element_at(currencies, F.lower(F.get(area, F.lit(0)))).alias("salary_currency"),
            F.lit("yearly").alias("salary_period"))).cast(SALARY_TYPE),
    )


def _greenhouse(raw: Column) -> dict[str, Column]:
    place = raw["location"]["name"]
    return dict(
        source_job_id=raw["id"], title=raw["title"],
        company=F.coalesce(raw["company_name"], F.col("board_company"), F.lit(UNKNOWN)),
        location=place, remote_allowed=_says_remote(place), description=_text(),
        url=F.coalesce(raw["absolute_url"],
                       F.concat(F.lit("https://job-boards.greenhouse.io/"), raw["id"])),
        skills=F.array().cast("array<string>"),
        posted_at=_moment(F.coalesce(_filled(raw["first_published"]), raw["updated_at"])),
    )


def _lever(raw: Column) -> dict[str, Column]:
    place = raw["categories"]["location"]
    return dict(
        source_job_id=raw["id"], title=F.coalesce(raw["text"], F.lit(UNKNOWN)),
        # The feed carries no company; the registry name is authoritative.
        company=F.coalesce(F.col("board_company"), F.lit(UNKNOWN)),
        location=place, remote_allowed=_says_remote(place), description=raw["descriptionPlain"],
        url=F.coalesce(raw["hostedUrl"], F.concat(F.lit("https://jobs.lever.co/"), raw["id"])),
        skills=F.array().cast("array<string>"),
        posted_at=F.when(raw["createdAt"] != 0, F.timestamp_millis(raw["createdAt"])),
    )


def _ashby(raw: Column) -> dict[str, Column]:
    return dict(
        source_job_id=raw["id"], title=raw["title"],
        company=F.coalesce(raw["company"], F.col("board_company"), F.lit(UNKNOWN)),
        location=raw["location"],
        remote_allowed=F.coalesce(raw["isRemote"], _says_remote(raw["location"])),
        description=raw["descriptionPlain"],
        url=F.coalesce(raw["jobUrl"], raw["applyUrl"],
                       F.concat(F.lit("https://jobs.ashbyhq.com/"), raw["id"])),
        skills=F.array().cast("array<string>"), posted_at=_moment(raw["publishedAt"]),
    )


# A new feed is one schema in ``schemas.FEEDS`` and one entry here.
ADAPTERS: dict[str, Callable[[Column], dict[str, Column]]] = {
    "arbeitnow": _arbeitnow,
    "remotive": _remotive,
    "remoteok": _remoteok,
    "adzuna": _adzuna,
    "greenhouse": _greenhouse,
    "lever": _lever,
    "ashby": _ashby,
}

COMMON = ["title", "company", "location", "remote_allowed", "description", "url", "skills", "posted_at"]


def finalize(df: DataFrame) -> DataFrame:
    """Seniority from the title and salary columns.

    A structured ``salary`` wins over ``salary_text``; a given ``seniority``
    wins over the inferred one.  Either column may be absent.
    """
    structured = F.col("salary") if "salary" in df.columns else F.lit(None).cast(SALARY_TYPE)
    given = F.col("seniority") if "seniority" in df.columns else _text()
    if "salary_text" in df.columns:
        structured = F.coalesce(structured, parse_salary(F.col("salary_text")))
    return (
        df.withColumn("seniority", F.coalesce(given, seniority(F.col("title"))))
        .withColumn("_pay", structured)
        .select("*", "_pay.*")
        .drop("_pay", "salary", "salary_text")
    )


def normalize(raw_df: DataFrame, feed: str) -> DataFrame:
    """Normalized postings of one feed.

    ``raw_df`` comes from the landing scan; board feeds must have been joined
    with the registry first.  Rows that cannot become a posting keep a
    ``reject_reason``, so one bad record never stops a batch.
    """
    raw = F.col("raw")
    if feed == "remoteok":
        # The legal notice at the head of the feed has neither field.
        raw_df = raw_df.where(F.col("reject_reason").isNotNull()
                              | (raw["position"].isNotNull() & raw["company"].isNotNull()))
    board = F.concat(F.lit(f"{feed}:"), F.col("board")) if "board_company" in raw_df.columns else F.lit(feed)
    columns = ADAPTERS[feed](raw)
    done = finalize(raw_df.select(
        board.alias("source"), "arrival", "reject_reason",
        *(["hq_location"] if "hq_location" in raw_df.columns else [_text().alias("hq_location")]),
        *[c.alias(n) for n, c in columns.items()]))
    return done.withColumn("reject_reason", F.coalesce(
        F.col("reject_reason"),
        F.when(F.col("title").isNull(), "missing title")
        .when(F.col("company").isNull(), "missing company")
        .when(F.col("url").isNull(), "missing url"),
    ))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted without the reason column, rejected with it)."""
    return (df.where(F.col("reject_reason").isNull()).drop("reject_reason"),
            df.where(F.col("reject_reason").isNotNull()))

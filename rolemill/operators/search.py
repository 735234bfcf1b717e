"""Filtered, keyset-paginated search, suggestions and detail lookups.

Filters are plain predicates that reach the Parquet scan where it can use them;
a page is a bounded top-n, and only its few rows meet the source links.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemill.functions.display import source_label
from rolemill.functions.text import contains_ci

# Page sizes, staleness, suggestion sizes.
DEFAULT_LIMIT = 20
MAX_LIMIT = 100
STALE_DAYS = 30
SUGGEST_K = 8
MIN_PREFIX = 2
VISA_WORDS = ["visa sponsorship", "sponsorship", "visa", "relocation"]
UUID = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"

PAGE_COLUMNS = [
    "id", "title", "company", "location", "remote_allowed", "seniority", "salary_min",
    "salary_max", "salary_currency", "summary", "url", "posted_at",
]


@dataclass(frozen=True)
class JobFilter:
    """Search arguments; unset ones do not filter."""

    q: str | None = None
    company: str | None = None
    location: str | None = None
    workplace: str | None = None  # remote, hybrid or onsite
    remote: bool | None = None
    seniority: str | None = None  # comma-separated list
    salary_min: int | None = None
    posted_within: int | None = None  # days
    visa: bool = False
    source: str | None = None
    source_family: bool = False  # match the text before the board name instead
    skills: Sequence[str] = field(default_factory=tuple)  # all of them


def clamp_limit(limit: int | str | None) -> int:
    """Page size: the leading whole number; missing, zero or unreadable is the default, never above the maximum."""
    found = re.match(r"\s*([+-]?\d+)", "" if limit is None else str(limit), re.ASCII)
    wanted = int(found[1]) if found else 0
    return min(wanted or DEFAULT_LIMIT, MAX_LIMIT)


def visible(as_of: Column, stale_days: int = STALE_DAYS, seen: str = "last_seen_at",
            status: str = "embedding_status") -> Column:
    return (F.col(seen) >= as_of - F.make_dt_interval(F.lit(stale_days))) & (F.col(status) == "embedded")


def any_contains(columns: Sequence[str], needles: Sequence[str]) -> Column:
    """Some needle occurs in some column, ignoring case."""
    tests = [contains_ci(F.col(c), n) for c in columns for n in needles]
    return reduce(lambda a, b: a | b, tests)


def workplace_is(kind: str, remote: str = "remote_allowed", location: str = "location") -> Column:
    flag, place = F.col(remote), F.col(location)
    says_remote, says_hybrid = contains_ci(place, "remote"), contains_ci(place, "hybrid")
    no = F.lit(False)
    if kind == "remote":
        return F.coalesce(flag, no) | F.coalesce(says_remote, no)
    if kind == "hybrid":
        return F.coalesce(says_hybrid, no)
    if kind == "onsite":
        return ~F.coalesce(flag, no) & ~F.coalesce(says_remote, no) & ~F.coalesce(says_hybrid, no)
    raise ValueError(f"unknown workplace: {kind}")


def within_days(ts: str, days: int, as_of: Column) -> Column:
    return F.col(ts) >= as_of - F.make_dt_interval(F.lit(days))


def conditions(f: JobFilter, as_of: Column) -> list[Column]:
    """Row predicates of a filter (those that need no other table)."""
    conds: list[Column] = []
    if f.company:
        conds.append(F.col("company") == f.company)
    if f.location:
        conds.append(contains_ci(F.col("location"), f.location))
    if f.remote is not None:
        conds.append(F.col("remote_allowed") == f.remote)
    if f.workplace:
        conds.append(workplace_is(f.workplace))
    levels = [s.strip() for s in (f.seniority or "").split(",") if s.strip()]
    if levels:
        conds.append(F.col("seniority").isin(levels))
    if f.salary_min is not None:
        conds.append(F.col("salary_max") >= f.salary_min)
    if f.posted_within and f.posted_within > 0:
        conds.append(within_days("posted_at", f.posted_within, as_of))
    if f.visa:
        conds.append(any_contains(["description"], VISA_WORDS))
    if f.q:
        conds.append(any_contains(["title", "company", "summary"], [f.q]))
    return conds


def having_all(df: DataFrame, key: str, links: DataFrame, link_key: str, value: str,
               wanted: Sequence[str]) -> DataFrame:
    """Rows of ``df`` linked to every wanted value, ignoring case.

    One pass over the links: each key keeps one flag per wanted value, combined
    on the map side.
    """
    wanted = sorted({w.lower() for w in wanted})
    if not wanted:
        return df
    low = F.lower(value)
    flags = [F.bool_or(low == w) for w in wanted]
    keys = (
        links.where(low.isin(wanted)).groupBy(F.col(link_key).alias("_key"))
        .agg(reduce(lambda a, b: a & b, flags).alias("_all")).where("_all")
    )
    return df.join(keys, df[key] == keys["_key"], "left_semi")


def having_source(df: DataFrame, key: str, links: DataFrame, link_key: str, source: str,
                  family: bool = False) -> DataFrame:
    name = source_label(F.col("source")) if family else F.col("source")
    hits = links.where(name == source)
    return df.join(hits, df[key] == hits[link_key], "left_semi")


def parse_cursor(cursor: str) -> tuple[str | None, str]:
    stamp, _, last_id = cursor.partition("|")
    return stamp or None, last_id


def after_cursor(ts: Column, key: Column, cursor: str) -> Column:
    """Rows behind a cursor in the order: newest first, missing times ahead of all."""
    stamp, last_id = parse_cursor(cursor)
    at = F.lit(last_id)
    if stamp is None:
        return ts.isNotNull() | (key < at)
    when = F.lit(stamp).cast("timestamp")
    return (ts < when) | ((ts == when) & (key < at))


def cursor_of(ts: Column, key: Column) -> Column:
    """``time|id``; a missing time is an empty first part."""
    iso = F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.concat(F.coalesce(iso, F.lit("")), F.lit("|"), key.cast("string"))


def page(df: DataFrame, ts: str, key: str, limit: int, cursor: str | None = None) -> DataFrame:
    """One page by (``ts`` descending, ``key`` descending) and the cursor of the next.

    ``next_cursor`` is set on the page's last row when more rows follow.
    """
    if cursor:
        df = df.where(after_cursor(F.col(ts), F.col(key), cursor))
    order = [F.desc_nulls_first(ts), F.desc(key)]
    # limit + 1 <= 101 rows: the windows below see no more than that.
    top = df.orderBy(*order).limit(limit + 1)
    rank = Window.orderBy(*order)
    return (
        top.withColumn("_rank", F.row_number().over(rank))
        .withColumn("_more", F.max("_rank").over(Window.partitionBy()) > limit)
        .where(F.col("_rank") <= limit)
        .withColumn("next_cursor", F.when(
            F.col("_more") & (F.col("_rank") == limit), cursor_of(F.col(ts), F.col(key))))
        .withColumnRenamed("_rank", "position").drop("_more")
    )


def with_links(rows: DataFrame, key: str, links: DataFrame, link_key: str, value: str, out: str) -> DataFrame:
    """Sorted list of distinct link values per row, empty when there are none.

    Duplicates are removed on the map side, so a key's list is no longer than
    its number of distinct values.
    """
    lists = links.groupBy(F.col(link_key).alias("_key")).agg(F.array_sort(F.collect_set(value)).alias(out))
    return (
        rows.join(lists, rows[key] == lists["_key"], "left").drop("_key")
        .withColumn(out, F.coalesce(out, F.array().cast("array<string>")))
    )


def attach_sources(page_rows: DataFrame, key: str, links: DataFrame, link_key: str,
                   value: str = "source", out: str = "sources") -> DataFrame:
    """`with_links` for the rows of one page.

    The page is read first, at most MAX_LIMIT rows, so that the links can be
    scanned for exactly its ids instead of being shuffled.
    """
    rows = page_rows.collect()
    local = page_rows.sparkSession.createDataFrame(rows, page_rows.schema)
    ids = [r[key] for r in rows]
    return with_links(local, key, links.where(F.col(link_key).isin(ids)), link_key, value, out)


def search(jobs: DataFrame, job_skills: DataFrame, job_sources: DataFrame, f: JobFilter,
           as_of: Column, limit: int | str | None = None, cursor: str | None = None,
           stale_days: int = STALE_DAYS) -> DataFrame:
    """One page of visible postings with their sources, in page order."""
    rows = jobs.where(visible(as_of, stale_days))
    for cond in conditions(f, as_of):
        rows = rows.where(cond)
    if f.source:
        rows = having_source(rows, "id", job_sources, "job_id", f.source, f.source_family)
    rows = having_all(rows, "id", job_skills, "job_id", "skill", f.skills)
    found = page(rows.select(*PAGE_COLUMNS), "posted_at", "id", clamp_limit(limit), cursor)
    return attach_sources(found, "id", job_sources, "job_id").orderBy("position")


def next_cursor(page_df: DataFrame) -> str | None:
    """Cursor of the following page (reads at most one page)."""
    row = page_df.where(F.col("next_cursor").isNotNull()).select("next_cursor").first()
    return row[0] if row else None


def frequent_values(df: DataFrame, column: str, prefix: str, k: int = SUGGEST_K) -> DataFrame:
    """The ``k`` most frequent values containing the text, ties by value."""
    return (
        df.where(contains_ci(F.col(column), prefix)).groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)
    )


def suggest_union(frames: Sequence[tuple[DataFrame, str]], prefix: str, k: int = SUGGEST_K) -> DataFrame:
    """Distinct values containing the text: at most ``k`` per table, then ``k`` overall."""
    branches = [
        df.where(contains_ci(F.col(c), prefix)).select(F.col(c).alias("value")).distinct()
        .orderBy("value").limit(k)
        for df, c in frames
    ]
    return reduce(lambda a, b: a.union(b), branches).distinct().orderBy("value").limit(k)


def suggest(jobs: DataFrame, job_skills: DataFrame, field_name: str, prefix: str,
            k: int = SUGGEST_K, drop_echo: bool = False) -> DataFrame:
    """Autocomplete values for a field; inputs shorter than two characters give none."""
    text = prefix.strip()
    if field_name == "skill":
        out = frequent_values(job_skills, "skill", text, k).select("value")
    elif field_name in ("location", "company"):
        out = frequent_values(jobs, field_name, text, k).select("value")
    else:
        out = suggest_union([(jobs, "title"), (jobs, "company")], text, k)
    if drop_echo:
        out = without_echo(out, text)
    return out if len(text) >= MIN_PREFIX else out.limit(0)


def without_echo(values: DataFrame, text: str) -> DataFrame:
    """Remove the value that equals the input itself, after the cut to ``k``."""
    return values.where(F.lower("value") != text.lower())


def detail(table: DataFrame, row_id: str, links: DataFrame | None = None, link_key: str = "",
           value: str = "skill", out: str = "skills") -> DataFrame:
    """One row by id with its sorted link values; a malformed id finds nothing."""
    one = table.where((F.col("id") == row_id) & F.lit(row_id).rlike(UUID))
    if links is None:
        return one
    # The id is fixed, so the links are filtered by it before they are grouped.
    return with_links(one, "id", links.where(F.col(link_key) == row_id), link_key, value, out)


PROFILE_COLUMNS = [
    "id", "filename", "content_type", "contacts", "sections", "skills",
    "estimated_years_experience", "target_role", "embedding_status", "created_at", "updated_at",
]


def profile_detail(profiles: DataFrame, row_id: str) -> DataFrame:
    """Structured profile only: no raw text, no vector."""
    return detail(profiles, row_id).select(*PROFILE_COLUMNS)

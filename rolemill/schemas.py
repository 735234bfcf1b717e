"""Schemas of the raw feeds and of the tables, as DDL.

Reads always use these; nothing is inferred from data.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Feed:
    """One raw feed: where its records sit in a payload and how they look."""

    name: str
    record: str  # struct DDL of one record
    envelope: str | None  # array field holding the records; None: the payload is the array
    per_board: bool = False


# Field names of each feed's records.  Ids may be numbers or text,
# so they are read as text.
FEEDS = {
    feed.name: feed
    for feed in [
        Feed("arbeitnow",
             "id string, title string, company_name string, company_slug string, location string, "
             "remote boolean, description string, url string, slug string, tags array<string>, "
             "job_types array<string>, created_at string, salary string", "data"),
        Feed("remotive",
             "id string, url string, title string, company_name string, category string, "
             "tags array<string>, job_type string, publication_date string, "
             "candidate_required_location string, salary string, description string", "jobs"),
        Feed("remoteok",
             "slug string, id string, epoch bigint, date string, company string, position string, "
             "tags array<string>, location string, url string, salary_min double, "
             "salary_max double, description string", None),
        Feed("adzuna",
             "id string, title string, redirect_url string, description string, created string, "
             "company struct<display_name:string>, "
             "location struct<display_name:string,area:array<string>>, contract_time string, "
             "salary_min double, salary_max double", "results"),
        Feed("greenhouse",
             "id string, title string, company_name string, location struct<name:string>, "
             "absolute_url string, first_published string, updated_at string", "jobs", True),
        Feed("lever",
             "id string, text string, hostedUrl string, createdAt bigint, "
             "categories struct<location:string,commitment:string,department:string,team:string>, "
             "descriptionPlain string", None, True),
        Feed("ashby",
             "id string, title string, company string, department string, team string, "
             "employmentType string, location string, isRemote boolean, workplaceType string, "
             "publishedAt string, jobUrl string, applyUrl string, descriptionPlain string, "
             "descriptionHtml string", "jobs", True),
    ]
}

EMBEDDING_STATE = (
    "embedding array<float>, embedding_status string, embedding_retry_count int, "
    "embedding_last_attempt_at timestamp"
)

JOBS = (
    "id string, content_hash string, title string, company string, location string, "
    "remote_allowed boolean, seniority string, salary_min bigint, salary_max bigint, "
    "salary_currency string, salary_period string, description string, summary string, "
    f"url string, {EMBEDDING_STATE}, posted_at timestamp, fetched_at timestamp, "
    "last_seen_at timestamp, updated_at timestamp"
)
JOB_SOURCES = "job_id string, source string, source_job_id string, first_seen_at timestamp"
JOB_SKILLS = "job_id string, skill string"
COMPANIES = (
    "id string, name string, ats_type string, board_slug string, hq_location string, "
    "enabled boolean, created_at timestamp, updated_at timestamp"
)
RUN_LOG = (
    "name string, last_run_at timestamp, last_status string, last_error string, "
    "jobs_fetched bigint, embedding_pending_count bigint"
)
CV_PROFILES = (
    "id string, filename string, content_type string, raw_text string, "
    "contacts struct<email:string,phone:string,github:string,linkedin:string,url:string>, "
    "sections array<struct<name:string,heading:string,lines:array<string>>>, "
    "skills array<struct<skill:string,occurrences:int>>, estimated_years_experience float, "
    f"target_role string, {EMBEDDING_STATE}, created_at timestamp, updated_at timestamp"
)
CV_SKILLS = "cv_id string, skill string, occurrences int"
EMBEDDING_CACHE = (
    "content_hash string, embedding array<float>, model string, dim int, created_at timestamp"
)
CHAT_USAGE = (
    "id string, user_key string, model string, prompt_tokens int, completion_tokens int, "
    "cached boolean, latency_ms int, created_at timestamp"
)
CHAT_CACHE = "prompt_hash string, response_text string, model string, created_at timestamp"
RATE_LIMIT_HITS = "user_key string, hit_at timestamp"

# Allowed status and board type names.
EMBEDDING_STATUS = ("pending", "embedded", "failed")
RUN_STATUS = ("ok", "error")
BOARD_TYPES = ("greenhouse", "lever", "ashby")

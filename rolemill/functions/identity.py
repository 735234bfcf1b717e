"""Content keys, embedding texts and display summaries of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemill.functions.seniority import seniority_from_years
from rolemill.functions.text import normalize_text, round_half_up

SEP = " · "
TOP_JOB_SKILLS = 8
TOP_CV_SKILLS = 10
PROMPT_SEP = "\x1f"


def _given(text: Column) -> Column:
    """Empty counts as absent, so that separators are not doubled."""
    return F.nullif(text, F.lit(""))


def _skill_list(skills: Column, n: int) -> Column:
    return _given(F.array_join(F.slice(skills, 1, n), ", "))


def content_hash(company: Column, title: Column, location: Column, skills: Column) -> Column:
    """Identity of a posting: company, title, location and the sorted skill list."""
    listed = F.array_sort(F.transform(F.coalesce(skills, F.array().cast("array<string>")),
                                      normalize_text))
    return F.sha2(
        F.concat_ws("|", normalize_text(company), normalize_text(title),
                    normalize_text(location), F.array_join(listed, ",")),
        256,
    )


def job_id(content_key: Column) -> Column:
    """UUID-shaped id derived from the content key, so reruns give the same ids."""
    return F.regexp_replace(
        F.left(content_key, F.lit(32)), r"\A(.{8})(.{4})(.{4})(.{4})(.{12})\z", "$1-$2-$3-$4-$5")


def job_summary(title: Column, company: Column, skills: Column, location: Column,
                level: Column, salary_min: Column, salary_max: Column,
                currency: Column) -> Column:
    pay = F.concat(salary_min.cast("string"), F.lit("-"), salary_max.cast("string"),
                   F.coalesce(currency, F.lit("")))
    return F.concat_ws(SEP, title, company, _skill_list(skills, TOP_JOB_SKILLS),
                       _given(location), _given(level), pay)


def job_composite(title: Column, company: Column, skills: Column, location: Column,
                  level: Column) -> Column:
    """Short text that is embedded for a posting."""
    return F.concat_ws(SEP, title, company, _skill_list(skills, TOP_JOB_SKILLS),
                       _given(location), _given(level))


def by_occurrences(skills: Column) -> Column:
    """Skill structs ordered by occurrences, most frequent first, ties in given order."""
    ranked = F.transform(skills, lambda s, i: F.struct(
        (-s["occurrences"]).alias("rank"), i.alias("pos"), s["skill"].alias("skill")))
    return F.transform(F.array_sort(ranked), lambda s: s["skill"])


def cv_composite(role: Column, skills: Column, years: Column) -> Column:
    """Short text that is embedded for a profile: role, top skills, years, level."""
    experience = F.concat(round_half_up(years).cast("string"), F.lit(" years"))
    return F.concat_ws(SEP, _given(role), _skill_list(by_occurrences(skills), TOP_CV_SKILLS),
                       experience, seniority_from_years(years))


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def entity_version(entity_id: Column, updated_at: Column) -> Column:
    """``id@updated_at`` of a referenced record, empty when nothing is referenced."""
    return F.coalesce(
        F.concat(_given(entity_id), F.lit("@"), F.coalesce(iso_millis(updated_at), F.lit(""))),
        F.lit(""))


def prompt_key(system: Column, model: Column, message: Column,
               cv_version: Column, job_version: Column) -> Column:
    """Response cache key over everything that can change a reply."""
    return F.sha2(F.concat_ws(PROMPT_SEP, system, model, message, cv_version, job_version), 256)


def user_key(forwarded: Column, real_ip: Column, salt: Column) -> Column:
    """Pseudonym of a caller: 16 hex digits of a salted hash of the first address."""
    address = F.coalesce(
        _given(F.trim(F.element_at(F.split(forwarded, ","), 1))), _given(real_ip),
        F.lit("unknown"))
    return F.left(F.sha2(F.concat(address, F.lit(":"), salt), 256), F.lit(16))

"""Uploaded documents: type routing, admission checks and structured profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemill.functions.contacts import contacts
from rolemill.functions.experience import target_role, years_experience
from rolemill.functions.identity import job_id
from rolemill.functions.sections import sections
from rolemill.functions.text import trim_ws
from rolemill.operators.skills import match_terms, skill_lists
from rolemill.plans.session import materialize

MAX_BYTES = 4 * 1024 * 1024
MIN_CHARS = 40


def document_kind(content_type: Column, filename: Column) -> Column:
    """pdf, docx, text or unsupported; the first rule that fits wins."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    ext = F.substring_index(F.lower(F.coalesce(filename, F.lit(""))), ".", -1)
    return (
        F.when(F.contains(kind, F.lit("pdf")) | (ext == "pdf"), "pdf")
        .when(F.contains(kind, F.lit("officedocument.wordprocessingml"))
              | F.contains(kind, F.lit("msword")) | ext.isin("docx", "doc"), "docx")
        .when(kind.startswith("text/") | ext.isin("txt", "md"), "text")
        .otherwise("unsupported")
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files as (id, filename, content_type, size, content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        job_id(F.sha2("path", 256)).alias("id"),
        F.url_decode(F.substring_index("path", "/", -1)).alias("filename"),
        F.lit("").alias("content_type"), F.col("length").alias("size"), "content",
        F.col("modificationTime").alias("created_at"))


def route_documents(files: DataFrame, max_bytes: int = MAX_BYTES, min_chars: int = MIN_CHARS,
                    once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(text documents, rejected files with a reason).

    With ``once``, texts are decoded in the tasks the files are dealt to and written, for callers that read them
    several times; else every read decodes again, and its filter may move to the few tasks of the scan.  Text is decoded as UTF-8 here, and a file that is not valid UTF-8 is set aside;
    binary formats need a decoder of their own and are set aside too.
    """
    kind = document_kind(F.col("content_type"), F.col("filename"))
    text = F.when(kind == "text", trim_ws(F.try_validate_utf8(F.col("content").cast("string"))))
    checked = files.withColumn("kind", kind).withColumn("raw_text", text).withColumn(
        "reject_reason",
        F.when(F.col("size") > max_bytes, "too large")
        .when(F.col("kind") == "unsupported", "unsupported type")
        .when(F.col("kind") != "text", F.concat("kind", F.lit(" needs a decoder")))
        .when(F.col("raw_text").isNull(), "not UTF-8 text")
        .when(F.length("raw_text") < min_chars, "text too short")).drop("content")
    checked = materialize(checked, "routed") if once else checked
    return (
        checked.where(F.col("reject_reason").isNull()).drop("reject_reason", "kind"),
        checked.where(F.col("reject_reason").isNotNull()).drop("raw_text"),
    )


def parse_profiles(docs: DataFrame, terms: DataFrame, as_of: Column, key: str = "id", text: str = "raw_text",
                   contact_chars: int | None = None, role_chars: int | None = None) -> DataFrame:
    """Structured profile columns for every document, with a reason where nothing was found.

    Whole texts are searched; ``contact_chars`` and ``role_chars`` bound contacts and title phrases to the
    beginning, as the original service does (`contacts.HEAD_CHARS`, `experience.HEAD_CHARS`).  Only the matched skills are shuffled and joined back by ``key``.
    """
    found = skill_lists(match_terms(docs, key, text, terms), key)
    body = F.col(text)
    parsed = (
        docs.withColumn("sections", sections(body))
        .withColumns({
            "contacts": contacts(body, contact_chars),
            "estimated_years_experience": years_experience(F.col("sections"), as_of),
            "target_role": target_role(F.col("sections"), body, role_chars),
        })
        .join(found, key, "left")
        .withColumn("skills", F.coalesce(
            "skills", F.array().cast("array<struct<skill:string,occurrences:int>>")))
    )
    no_signal = ((F.size("skills") == 0) & F.col("estimated_years_experience").isNull()
                 & F.col("target_role").isNull())
    return parsed.withColumn("reject_reason", F.when(
        (F.size("sections") == 0) | no_signal, "no sections or signals found"))


def profile_rows(parsed: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(profile rows, skill rows) ready to be appended."""
    good = parsed.where(F.col("reject_reason").isNull())
    profiles = good.select(
        "id", "filename",
        F.coalesce(F.nullif(F.col("content_type"), F.lit("")), F.lit("application/octet-stream")).alias("content_type"),
        "raw_text", "contacts", "sections", "skills",
        F.col("estimated_years_experience").cast("float").alias("estimated_years_experience"),
        "target_role",
        F.lit(None).cast("array<float>").alias("embedding"), F.lit("pending").alias("embedding_status"),
        F.lit(0).alias("embedding_retry_count"), F.lit(None).cast("timestamp").alias("embedding_last_attempt_at"),
        as_of.alias("created_at"), as_of.alias("updated_at"))
    skills = good.select(F.col("id").alias("cv_id"), F.inline("skills"))
    return profiles, skills

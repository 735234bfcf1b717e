"""Seniority buckets from a title or from years of experience."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemill.functions.text import words

# Title keywords per bucket, tested top to bottom.
TITLE_RULES = [
    ("intern|internship|apprentice", "intern"),
    (r"junior|jr\.?|entry|graduate", "junior"),
    ("staff|principal", "staff"),
    (r"sr\.?|senior", "senior"),
    ("lead", "lead"),
    ("expert", "senior"),
    ("director|vp|vice president|chief|cto|cio|ceo", "director+"),
    ("manager|head of", "manager"),
]
TITLE_DEFAULT = "mid"

# Upper bound in years (exclusive) per bucket.
YEAR_RULES = [(2, "intern"), (4, "junior"), (7, "mid"), (12, "senior")]
YEAR_DEFAULT = "staff"


def seniority(title: Column) -> Column:
    """Bucket of a title; the first rule that matches wins, null title stays null."""
    lowered = F.lower(title)
    rule = F.when(title.isNull(), F.lit(None).cast("string"))
    for pattern, bucket in TITLE_RULES:
        rule = rule.when(lowered.rlike(words(pattern)), bucket)
    return rule.otherwise(TITLE_DEFAULT)


def seniority_from_years(years: Column) -> Column:
    rule = F.when(years.isNull(), F.lit(None).cast("string"))
    for bound, bucket in YEAR_RULES:
        rule = rule.when(years < bound, bucket)
    return rule.otherwise(YEAR_DEFAULT)

"""Columns shown to people: salary, workplace, age, source family, match percent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemill.functions.identity import by_occurrences
from rolemill.functions.text import round_half_up

# Suffix per pay period.
PERIOD_SUFFIX = [("hourly", "/hr"), ("monthly", "/mo"), ("yearly", "/yr")]


def format_salary(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """``$90k – $120k/yr``; open ends as ``$90k+`` or ``$120k-``; null without figures."""
    sign = (
        F.when(currency.isNull(), "")
        .when(currency == "EUR", "€")
        .when(currency.startswith("USD"), F.concat(F.lit("$"), F.substring(currency, 4, 64)))
        .otherwise(F.regexp_replace(currency, r"GBP\z", "£"))
    )

    def amount(n: Column) -> Column:
        short = F.concat(round_half_up(n / F.lit(1000.0)).cast("string"), F.lit("k"))
        return F.concat(sign, F.when(n >= 1000, short).otherwise(n.cast("string")))

    body = F.coalesce(
        F.concat(amount(low), F.lit(" – "), amount(high)),
        F.concat(amount(low), F.lit("+")),
        F.concat(amount(high), F.lit("-")),
    )
    suffix = F.lit("")
    for name, text in reversed(PERIOD_SUFFIX):
        suffix = F.when(period == name, text).otherwise(suffix)
    return F.concat(body, suffix)


def workplace_label(remote: Column, location: Column) -> Column:
    """Struct of label and kind; a hybrid location text beats the remote flag.

    ``remote`` is a nullable boolean.
    """
    place = F.coalesce(location, F.lit(""))
    flag = F.coalesce(remote, F.lit(False))

    def pair(label: str, kind: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"))

    return (
        F.when(place.rlike("(?i)hybrid"), pair("Hybrid", "hybrid"))
        .when(flag | place.rlike("(?i)remote"), pair("Remote", "remote"))
        .when(remote.isNotNull() | (place != ""), pair("On-site", "onsite"))
        .otherwise(pair("—", "any"))
    )


def time_ago(ts: Column, as_of: Column) -> Column:
    """Age of a timestamp relative to ``as_of`` in the largest whole unit."""
    secs = F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(1e6))
    minutes = F.floor(secs / 60)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    months = F.floor(days / 30)

    def ago(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f"{unit} ago"))

    return (
        F.when(ts.isNull(), "")
        .when(secs < 60, "just now")
        .when(minutes < 60, ago(minutes, "m"))
        .when(hours < 24, ago(hours, "h"))
        .when(days < 30, ago(days, "d"))
        .when(months < 12, ago(months, "mo"))
        .otherwise(ago(F.floor(months / 12), "y"))
    )


def source_label(source: Column) -> Column:
    """Source family: the text before the board name."""
    return F.substring_index(source, ":", 1)


def match_percent(score: Column) -> Column:
    return round_half_up(score * 100.0).cast("int")


def top_skills(skills: Column, n: int = 5) -> Column:
    return F.slice(by_occurrences(skills), 1, n)

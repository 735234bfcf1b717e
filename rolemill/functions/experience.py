"""Years of experience and target role from document sections."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemill.functions.sections import section
from rolemill.functions.text import EDGE, WS, collapse_ws, first_match, let, trim_ws

# Date spellings, range signs and the words for an open end.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
OPEN_END = "present|current|now|today"
DATE_PARTS = rf"\A(?:([a-zA-Z]{{3,9}})\.?{WS}+|(\d{{1,2}})/)?(\d{{4}})\z"
DATE_TOKEN = rf"(?:[a-zA-Z]{{3,9}}+\.?{WS}++\d{{4}}|\d{{1,2}}/\d{{4}}|\d{{4}}|{OPEN_END})"
DATE_RANGE = rf"(?i)({DATE_TOKEN}){WS}*(?:-|–|—|to|until|through){WS}*({DATE_TOKEN})"

# Sections that count as work history.
WORK_SECTIONS = ["experience", "employment", "work-history", "career-history"]
MAX_SPAN_YEARS = 40
DAY_MS = 86_400_000
YEAR_MS = 365.25 * DAY_MS

# Phrases that announce a wanted role, and words that mark a title line.
WANTED = (
    rf"(?i)(?:target(?:ing)?(?:{WS}+role)?|seeking(?:{WS}+a)?){WS}+"
    rf"(?:as{WS}+|a{WS}+|an{WS}+)?"
    r"([A-Za-z][\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff\w/&-]{2,60})"
)
TITLE_WORDS = (
    "engineer|developer|manager|designer|analyst|scientist|architect|consultant|specialist|"
    "lead|director"
)
TITLES = ["Engineer", "Developer", "Manager", "Designer"]
TITLE_PHRASE = rf"{EDGE}([A-Z][a-z]+(?:{WS}+[A-Z][a-z]+)*{WS}+(?:{'|'.join(TITLES)})){EDGE}"
TITLE_LINE_CHARS = 80
# Fixed value: the original service looks for a title phrase in so many first characters; for callers that want it.
HEAD_CHARS = 500


def date_token_ms(token: Column, as_of: Column) -> Column:
    """Epoch milliseconds of a date token; ``as_of`` for words like "present"."""
    def parse(t: Column) -> Column:
        return let(F.struct(t.alias("t"), *[
            F.regexp_extract(t, DATE_PARTS, g).alias(n) for g, n in [(1, "name"), (2, "number"), (3, "year")]]), moment)

    def moment(p: Column) -> Column:
        known = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.left(p["name"], F.lit(3))))
        month = F.when(p["name"] != "", known.cast("int")).when(p["number"] != "", p["number"].cast("int")).otherwise(1)
        year = F.nullif(p["year"], F.lit("")).cast("int")
        # Two-digit years written with leading zeros belong to the last century.
        year = F.when(year < 100, year + 1900).otherwise(year)
        first = F.when(month.between(1, 12), F.make_date(year, month, F.lit(1)))
        return (F.when(F.lower(p["t"]).isin(OPEN_END.split("|")), F.unix_millis(as_of))
                .otherwise(F.unix_date(first).cast("bigint") * F.lit(DAY_MS)))

    return let(trim_ws(token), parse)


def date_spans(text: Column, as_of: Column) -> Column:
    """Plausible (start, end) spans in epoch milliseconds found in a text, by start."""
    def build(t: Column) -> Column:
        # One pass over the text; the two dates are then taken from the short matches.
        found = F.regexp_extract_all(t, F.lit(DATE_RANGE), F.lit(0))
        parsed = F.transform(found, lambda m: F.struct(*[
            date_token_ms(F.regexp_extract(m, DATE_RANGE, g), as_of).alias(n)
            for g, n in [(1, "start"), (2, "end")]]))
        sane = F.filter(parsed, lambda s: (s["end"] > s["start"]) & (
            (s["end"] - s["start"]) / F.lit(YEAR_MS) <= MAX_SPAN_YEARS))
        return F.array_sort(sane)

    return let(text, build)


def covered_ms(spans: Column) -> Column:
    """Total length covered by spans ordered by start; overlaps count once."""
    def step(acc: Column, s: Column) -> Column:
        gain = F.greatest(s["end"] - F.greatest(s["start"], acc["until"]), F.lit(0))
        return F.struct((acc["total"] + gain).cast("bigint").alias("total"),
                        F.greatest(acc["until"], s["end"]).cast("bigint").alias("until"))

    start = F.struct(F.lit(0).cast("bigint").alias("total"),
                     F.lit(-(2**62)).cast("bigint").alias("until"))
    return F.aggregate(spans, start, step, lambda acc: acc["total"])


def years_experience(parts: Column, as_of: Column) -> Column:
    """Years covered by the date ranges of the work sections, to one decimal."""
    work = F.filter(parts, lambda s: s["name"].isin(WORK_SECTIONS))
    spans = F.flatten(F.transform(work, lambda s: date_spans(F.array_join(s["lines"], "\n"), as_of)))

    def total(found: Column) -> Column:
        years = F.floor(covered_ms(F.array_sort(found)) / F.lit(YEAR_MS) * 10 + 0.5) / 10.0
        return F.when(F.size(found) > 0, years)

    return let(spans, total)


def target_role(parts: Column, text: Column, head_chars: int | None = None) -> Column:
    """Wanted role: a stated target, else a title line at the top, else a title phrase.

    With ``head_chars``, the phrase is looked for in that many first characters.
    """
    def stated(line: Column) -> Column:
        role = collapse_ws(first_match(line, WANTED, 1))
        return F.regexp_replace(role, rf"(?i){WS}+roles?\z", "")

    wanted = F.get(F.filter(F.transform(section(parts, "summary")["lines"], stated),
                            lambda r: F.length(r) >= 3), F.lit(0))
    titled = F.get(F.filter(
        section(parts, "header")["lines"],
        lambda l: (F.length(trim_ws(l)) > 2) & l.rlike(f"(?i){EDGE}(?:{TITLE_WORDS}){EDGE}")),
        F.lit(0))
    head = text if head_chars is None else F.substring(text, 1, head_chars)
    held = reduce(or_, [F.contains(head, F.lit(t)) for t in TITLES])  # a plain byte scan before the pattern
    return F.coalesce(wanted, F.left(collapse_ws(titled), F.lit(TITLE_LINE_CHARS)),
                      F.when(held, first_match(head, TITLE_PHRASE, 1)))

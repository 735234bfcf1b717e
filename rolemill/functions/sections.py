"""Heading-based sections of a document, assembled inside the row.

A document never leaves its row: lines, headings and slices are array
expressions, so splitting a corpus into sections needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemill.functions.text import EDGE, WS, is_blank, let, trim_ws

# Heading prefixes in test order, with the section each one opens.
HEADINGS = [
    (rf"(?:professional{WS}+)?(?:work{WS}+|employment{WS}+)?experience", "experience"),
    (rf"employment(?:{WS}+history)?", "experience"),
    (rf"work{WS}+history", "experience"),
    (rf"career{WS}+(?:history|summary)", "experience"),
    (rf"education(?:al)?(?:{WS}+background|{WS}+history)?", "education"),
    (rf"(?:technical{WS}+)?skills?(?:{WS}+(?:&|and){WS}+\w+)?", "skills"),
    (rf"(?:core|key){WS}+competenc(?:y|ies)", "skills"),
    (rf"projects?(?:{WS}+(?:&|and){WS}+\w+)?", "projects"),
    (rf"(?:professional{WS}+)?summary", "summary"),
    (rf"(?:profile|objective|about{WS}+me)", "summary"),
    ("certifications?", "certifications"),
    ("languages", "languages"),
    ("publications?", "publications"),
    (rf"awards?(?:{WS}+(?:&|and){WS}+honors)?", "awards"),
    (rf"volunteer(?:ing)?(?:{WS}+experience)?", "volunteer"),
    ("interests?", "interests"),
    ("references?", "references"),
]
# What every heading looks like from its first characters: a known word behind an
# optional bullet, or a line without lower-case letters.  Most lines fail here.
MAYBE_HEADING = (
    rf"\A{WS}*[-–—•·*]?{WS}*(?i:professional|work|employment|experience|career|education|technical|"
    rf"skill|core|key|project|summary|profile|objective|about|certification|languages|publication|"
    rf"award|volunteer|interest|reference)|\A[^a-z]*[A-Z][^a-z]*\z"
)
MAX_HEADING_CHARS = 60
MAX_CAPS_WORDS = 5
HEADER = "header"

SECTION_TYPE = "array<struct<name:string,heading:string,lines:array<string>>>"


def split_lines(text: Column) -> Column:
    return F.split(text, r"\r?\n", -1)


def heading_name(line: Column) -> Column:
    """Canonical section name opened by a line, or null when it is no heading."""
    def named(bare: Column) -> Column:
        rule = F.when(F.length(bare) == 0, F.lit(None).cast("string"))
        for pattern, name in HEADINGS:
            rule = rule.when(bare.rlike(rf"(?i)\A{pattern}{EDGE}"), name)
        shouted = (
            (F.length(bare) > 2) & (bare == F.upper(bare)) & bare.rlike("[A-Z]")
            & (F.size(F.split(bare, f"{WS}+")) <= MAX_CAPS_WORDS)
        )
        return rule.when(shouted, F.regexp_replace(F.lower(bare), f"{WS}+", "-"))

    def check(trimmed: Column) -> Column:
        bare = F.regexp_replace(trimmed, rf":{WS}*\z", "")
        bare = trim_ws(F.regexp_replace(bare, rf"\A[-–—•·*]{WS}*", ""))
        plausible = F.length(trimmed).between(1, MAX_HEADING_CHARS) & ~trimmed.rlike(r"[.,;]\z")
        return F.when(plausible, let(bare, named))

    return F.when(line.rlike(MAYBE_HEADING), let(trim_ws(line), check))


def _drop_trailing_blank(lines: Column) -> Column:
    last = F.array_max(F.transform(lines, lambda l, i: F.when(~is_blank(l), i + 1).otherwise(0)))
    return F.slice(lines, F.lit(1), F.coalesce(last, F.lit(0)))


def sections(text: Column) -> Column:
    """Ordered sections of a text; what precedes the first heading is ``header``."""
    def assemble(lines: Column) -> Column:
        # Line numbers of headings, closed by a sentinel behind the last line.
        marks = F.filter(
            F.transform(lines, lambda l, i: F.struct(i.alias("at"), heading_name(l).alias("name"))),
            lambda m: m["name"].isNotNull())

        def cut(m: Column) -> Column:
            def body(mark: Column, k: Column) -> Column:
                end = F.when(k + 1 < F.size(m), F.get(m, k + 1)["at"]).otherwise(F.size(lines))
                return F.struct(
                    mark["name"].alias("name"),
                    trim_ws(F.get(lines, mark["at"])).alias("heading"),
                    _drop_trailing_blank(
                        F.slice(lines, mark["at"] + 2, end - mark["at"] - 1)).alias("lines"))

            intro_len = F.coalesce(F.get(m, F.lit(0))["at"], F.size(lines))
            intro = F.filter(F.slice(lines, F.lit(1), intro_len), lambda l: ~is_blank(l))
            header = F.transform(
                F.filter(F.array(intro), lambda ls: F.size(ls) > 0),
                lambda ls: F.struct(F.lit(HEADER).alias("name"), F.lit("(header)").alias("heading"),
                                    ls.alias("lines")))
            found = F.filter(F.transform(m, body), lambda s: F.size(s["lines"]) > 0)
            return F.concat(header, found)

        return let(marks, cut)

    return let(split_lines(text), assemble).cast(SECTION_TYPE)


def section(parts: Column, name: str) -> Column:
    """First section with the given name, or null."""
    return F.get(F.filter(parts, lambda s: s["name"] == name), F.lit(0))

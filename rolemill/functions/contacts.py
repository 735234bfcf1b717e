"""Contact details from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemill.functions.text import first_match, let, trim_ws

# Patterns for each contact kind.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/[a-zA-Z0-9-]{1,39}/?"
LINKEDIN = r"(?i)(?:https?://)?(?:[a-z]{2,3}\.)?linkedin\.com/in/[a-zA-Z0-9_%-]{3,100}/?"
_GAP = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff.-]"
PHONE = (
    rf"(?=[+(\d])(?:\+?\d{{1,3}}{_GAP}?)?(?:\(\d{{2,4}}\){_GAP}?)?\d{{3,4}}{_GAP}?\d{{3,4}}"
    rf"(?:{_GAP}?\d{{2,4}})?"
)
URL = r"""(?i)https?://[^\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff<>"')]+"""
NOT_PERSONAL = r"(?i)github\.com|linkedin\.com|mailto:|\.png|\.jpe?g"

# Fixed value: profiles carry their contacts at the top; the bound of the original service, for callers that want it.
HEAD_CHARS = 3000


def phone(head: Column) -> Column:
    """First phone-like run with 8 to 15 digits that is not an eight-digit date."""
    def check(candidate: Column) -> Column:
        digits = F.regexp_replace(candidate, "[^0-9]", "")
        plausible = F.length(digits).between(8, 15) & ~digits.rlike(r"\A(19|20)\d{6}\z")
        return F.when(plausible, trim_ws(candidate))

    # Most texts lack three digits in a row and are done here.
    return F.when(head.rlike("[0-9]{3}"), let(first_match(head, PHONE), check))


def personal_url(text: Column) -> Column:
    """The first link, unless it is a known profile host or an image."""
    return let(first_match(text, URL), lambda u: F.when(~u.rlike(NOT_PERSONAL), u))


def _if_has(text: Column, needle: str, found: Column) -> Column:
    """Search only texts that hold a literal part of the pattern (a plain byte scan)."""
    return F.when(F.contains(text, F.lit(needle)), found)


def contacts(text: Column, head_chars: int | None = None) -> Column:
    """Struct of email, phone, github, linkedin and url, from the whole text.

    With ``head_chars``, email and phone are looked for in that many first characters.
    """
    def search(low: Column) -> Column:
        head = text if head_chars is None else F.substring(text, 1, head_chars)
        return F.struct(
            _if_has(head, "@", first_match(head, EMAIL)).alias("email"),
            phone(head).alias("phone"),
            _if_has(low, "github.com/", first_match(text, GITHUB)).alias("github"),
            _if_has(low, "linkedin.com/in/", first_match(text, LINKEDIN)).alias("linkedin"),
            _if_has(low, "://", personal_url(text)).alias("url"),
        )

    return let(F.lower(text), search)

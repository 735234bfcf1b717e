"""Text building blocks shared by every operator.

All helpers take and return Columns, so they stay in the JVM and fuse into the
surrounding stage.  Patterns are written once here with an explicit whitespace
class and an explicit ASCII word boundary, because the regex dialects involved
disagree about both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode-aware whitespace (Java's \s alone misses no-break and ideographic spaces).
WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
NOT_WS = r"[^\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
WS_CHARS = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Whitespace runs that are not already one plain space.
UNEVEN_WS = rf"[\t\n\x0B\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]{WS}*| {WS}+"

# ASCII word boundary: newer and older JVMs treat accented letters differently in \b.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and evaluate ``body`` on it.

    Keeps long rule chains from repeating an expensive input expression.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """First regex match, or null (Spark's own function returns an empty string)."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def trim_ws(text: Column) -> Column:
    """Looks at the ends only, however long the text is."""
    return F.trim(text, F.lit(WS_CHARS))


def collapse_ws(text: Column) -> Column:
    """Every whitespace run becomes one plain space, ends trimmed."""
    return F.trim(F.regexp_replace(text, UNEVEN_WS, " "))


def is_blank(text: Column) -> Column:
    return ~text.rlike(NOT_WS)


def normalize_text(text: Column) -> Column:
    """Lower case, single spaces, trimmed; null becomes the empty string."""
    return F.coalesce(collapse_ws(F.lower(text)), F.lit(""))


def strip_html(html: Column) -> Column:
    """Markup to plain text: tags, then entities in a fixed order, then spaces.

    ``&amp;`` is decoded before ``&lt;``, so a doubly escaped ``&amp;lt;`` ends
    as ``<``.  A result without any text is null.
    """
    text = F.regexp_replace(html, "<[^>]+>", " ")
    # The entities that are decoded, in this order.
    for entity, char in [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
                         ("&#39;", "'"), ("&apos;", "'"), ("&quot;", '"')]:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.nullif(collapse_ws(text), F.lit(""))


def words(pattern: str) -> str:
    """Case-sensitive pattern matching any of the alternatives as whole words."""
    return f"{EDGE}(?:{pattern}){EDGE}"


def round_half_up(value: Column, scale: int = 1) -> Column:
    """Round halves towards plus infinity at ``1/scale`` steps."""
    scaled = F.floor(value * F.lit(float(scale)) + F.lit(0.5))
    return scaled if scale == 1 else scaled / F.lit(float(scale))


def contains_ci(text: Column, needle: str) -> Column:
    """Case-insensitive containment; ``%`` and ``_`` in the needle act as wildcards."""
    return text.ilike(f"%{needle}%")

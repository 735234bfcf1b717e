"""License scans: notice phrases and identifier tags by one automaton, expressions by a shunting yard.

A text is brought down to its words, joined by single spaces, so one Aho-Corasick pass finds every
phrase wherever its words stand next to each other, whatever stands between them.  Behind an
identifier tag the raw line is read as an expression of identifiers, ``and``, ``or``, ``with`` and
brackets: a shunting yard puts it into postfix order and evaluates it.  Texts never leave their row
and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

# Phrases (words after lower-casing, joined by one space) and the labels they stand for.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "affero general public license": "agpl",
    "all rights reserved": "proprietary",
    "apache license version 2 0": "apache",
    "artistic license": "artistic",
    "boost software license": "boost",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "bsd license": "bsd",
    "cc by": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "dedicated to the public domain": "public-domain",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "gnu affero general public license": "agpl",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "licensed under the apache license": "apache",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "released under the mit license": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "zlib license": "zlib",
}
#: Tags in front of an expression; what follows the first one may also be an identifier not known here.
TAGS = ("spdx license identifier", "license expression", "license", "licence")
#: Families of identifiers: an identifier belongs to the longest name it equals or continues with ``-``.
#: The number says how freely such a text may be used, from 0 (not at all) to 1.
FAMILIES = {
    "0bsd": ("bsd", 1.0), "agpl": ("agpl", 0.2), "apache": ("apache", 0.9), "artistic": ("artistic", 0.7),
    "bsd": ("bsd", 1.0), "bsl": ("boost", 1.0), "cc-by": ("cc-by", 0.8), "cc-by-nc": ("cc-by-nc", 0.1),
    "cc-by-nc-nd": ("cc-by-nc-nd", 0.05), "cc-by-nc-sa": ("cc-by-nc-sa", 0.1), "cc-by-nd": ("cc-by-nd", 0.1),
    "cc-by-sa": ("cc-by-sa", 0.5), "cc0": ("cc0", 1.0), "epl": ("epl", 0.6), "eupl": ("eupl", 0.5),
    "gpl": ("gpl", 0.3), "isc": ("isc", 1.0), "lgpl": ("lgpl", 0.5), "mit": ("mit", 1.0), "mpl": ("mpl", 0.6),
    "unlicense": ("unlicense", 1.0), "zlib": ("zlib", 1.0),
}
EXCEPTIONS = ("autoconf-exception", "bison-exception", "classpath-exception", "font-exception", "gcc-exception",
              "linux-syscall-note", "llvm-exception", "openjdk-assembly-exception", "swift-exception")
#: Labels without an identifier of their own, and what a text behind an exception may at least be used for.
OTHER_FREEDOM = {"proprietary": 0.0, "public-domain": 1.0, "boost": 1.0}
WITH_EXCEPTION = 0.6
UNKNOWN = "other"
EVIDENCE = {"base": 0.5, "notice": 0.8, "tag": 0.95}

_RANK = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(rb"[ \t]*(?:([A-Za-z0-9][A-Za-z0-9.+-]*)|([()]))")
_LEAD = re.compile(rb"[ \t:=\"']*")
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

FIND = StructType([
    StructField("word", LongType()), StructField("n", LongType()), StructField("kind", StringType()),
    StructField("labels", ArrayType(StringType())), StructField("expression", StringType()),
    StructField("freedom", DoubleType())])


def family(identifier: str) -> tuple[str, float] | None:
    """Label and freedom of a licence identifier, by its longest known beginning."""
    name = identifier.lower().rstrip("+")
    while name:
        if name in FAMILIES:
            return FAMILIES[name]
        name = name.rpartition("-")[0]
    return None


def to_postfix(tokens: Iterable[str]) -> list[str]:
    """Shunting yard: ``with`` binds before ``and``, that before ``or``; equal ones from the left.

    The longest beginning of ``tokens`` that is an expression counts: a second operand in a row or an
    unopened bracket ends it, an operator without an operand is dropped, open brackets are closed.
    """
    out, stack, operand = [], [], True  # operand: whether one is expected next
    for token in tokens:
        rank = _RANK.get(token.lower())
        if operand:
            if token == "(":
                stack.append(token)
            elif token == ")" or rank:
                break
            else:
                out.append(token)
                operand = False
        elif token == ")":
            if "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif rank:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= rank:
                out.append(stack.pop())
            stack.append(token.lower())
            operand = True
        else:
            break
    while operand and stack:  # an operator or bracket that nothing follows
        operand = stack.pop() == "("
    return out + [s for s in reversed(stack) if s != "("]


def evaluate(postfix: Iterable[str], strict: bool = False) -> tuple[set[str], float | None, str] | None:
    """(labels, freedom, expression with brackets) of a postfix expression.

    ``or`` leaves the choice, so the freer side counts; of ``and`` both bind, so the stricter one; a known
    exception lifts a copyleft licence.  Unknown identifiers are labelled ``other`` and bind nothing known;
    with ``strict`` an expression that starts with one is none.  None for no expression.
    """
    stack: list[tuple[set[str], float | None, deque[str]]] = []
    for token in postfix:
        if token not in _RANK:
            known = family(token)
            if known is None and strict and not stack:
                return None
            stack.append(({known[0] if known else UNKNOWN}, known[1] if known else None, deque([token])))
            continue
        (others, other_free, right), (labels, free, left) = stack.pop(), stack.pop()
        if token == "with":
            if free is not None and right[0].lower().startswith(EXCEPTIONS):
                free = max(free, WITH_EXCEPTION)
        else:
            labels = labels | others
            both = [f for f in (free, other_free) if f is not None]
            free = (max(both) if token == "or" else min(both)) if both else None
            left.appendleft("(")
            right.append(")")
        right.appendleft(f" {token.upper()} ")
        if len(right) > len(left):  # the shorter side moves, so long expressions take linear time
            right.extendleft(reversed(left))
            left = right
        else:
            left.extend(right)
        stack.append((labels, free, left))
    return (stack[0][0], stack[0][1], "".join(stack[0][2])) if stack else None


class Scanner:
    """The automaton and what its hits mean; built once per task."""

    def __init__(self, base: Mapping[str, str] = BASE, notices: Mapping[str, str] = NOTICES, tags: Iterable[str] = TAGS):
        import ahocorasick

        kinds: dict[str, list[tuple[str, str]]] = {}
        for kind, phrases in (("base", base), ("notice", notices), ("tag", {t: t for t in tags})):
            for phrase, label in phrases.items():
                kinds.setdefault(phrase, []).append((kind, label))
        self.first_tag = next(iter(tags), None)
        self.automaton = ahocorasick.Automaton()
        for phrase, means in kinds.items():
            self.automaton.add_word(f" {phrase} ", (phrase.count(" ") + 1, means))
        self.automaton.make_automaton()
        self.freedom = {label: free for label, free in FAMILIES.values()} | OTHER_FREEDOM

    def scan(self, raw: bytes) -> tuple[int, list[dict]]:
        """Number of words, and finds by position."""
        plain = np.frombuffer(b" " + raw.translate(_WORDS) + b" ", np.uint8)
        space = plain == 32
        ends = ~space[:-1] & space[1:]  # last bytes of words
        keep = ~space
        keep[1:] |= ends
        keep[0] = True
        n_words, line = int(np.count_nonzero(ends)), plain[keep].tobytes().decode()
        found, at, before = [], 0, 0
        for end, (n, means) in self.automaton.iter(line):
            before, at = before + line.count(" ", at, end), end
            found += [(before - n, n, kind, label) for kind, label in means]
        if not found:
            return n_words, []
        found.sort(key=lambda f: (f[0], -f[1]))
        out, reach, edges = [], -1, None
        for start, n, kind, label in found:
            if kind == "base":
                out.append(dict(word=start, n=n, kind=kind, labels=[label], expression=None,
                                freedom=self.freedom.get(label)))
            elif kind == "notice":
                if start + n > reach:  # else inside a longer notice
                    reach = start + n
                    out.append(dict(word=start, n=n, kind=kind, labels=[label], expression=None,
                                    freedom=self.freedom.get(label)))
            else:
                if edges is None:
                    edges = np.flatnonzero(ends)  # one byte stands before the text, so these are ends in ``raw``
                read = self._expression(raw, int(edges[start + n - 1]), label != self.first_tag)
                if read:
                    out.append(dict(word=start, n=n, kind=kind, labels=sorted(read[0]), expression=read[2],
                                    freedom=read[1]))
        return n_words, out

    @staticmethod
    def _expression(raw: bytes, at: int, strict: bool):
        lead = _LEAD.match(raw, at)
        if not re.search(rb"[:=]", lead[0]):
            return None

        def tokens() -> Iterator[str]:
            here = _TOKEN.match(raw, lead.end())
            while here:
                yield (here[1] or here[2]).decode().rstrip(".")
                here = _TOKEN.match(raw, here.end())

        return evaluate(to_postfix(tokens()), strict)


def scan_licenses(docs: DataFrame, text: str = "text", base: Mapping[str, str] = BASE,
                  notices: Mapping[str, str] = NOTICES, tags: Iterable[str] = TAGS) -> DataFrame:
    """Rows of ``docs`` without the text, with ``n_words`` and ``finds``.

    A find has its first ``word`` (from 0), its length ``n`` in words, its ``kind`` (``base``: a phrase of
    ``base`` at every place; ``notice``: a phrase of ``notices`` that lies in no longer one; ``tag``: a tag with
    the expression behind it on the same line), its ``labels``, the ``expression`` read and its ``freedom``
    from 0 to 1 (null: nothing known).  Words are runs of letters and digits, A-Z lower-cased, every character
    beyond ASCII counting as a letter.  Null and empty texts have no words and no finds; other columns may hold
    anything and stay; a column named like an added one is replaced; rows may repeat; an empty table gives none.
    """
    tags = tuple(tags)
    own = next(f.name for f in docs.schema if f.name == text)
    names = [f.name for f in docs.schema if f.name not in (own, "n_words", "finds")]
    schema = StructType([docs.schema[n] for n in names]
                        + [StructField("n_words", LongType()), StructField("finds", ArrayType(FIND))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        scanner, kind = Scanner(base, notices, tags), to_arrow_type(ArrayType(FIND))
        for batch in batches:
            texts = pc.fill_null(batch.column(own), "").cast(pa.large_binary())
            scanned = [scanner.scan(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array([n for n, _ in scanned], pa.int64()),
                 pa.array([f for _, f in scanned], kind)], names=[*names, "n_words", "finds"])

    return docs.mapInArrow(run, schema)


def of_kind(finds: Column, kind: str) -> Column:
    return F.filter(finds, lambda f: f["kind"] == kind)


def evidence(finds: Column) -> Column:
    """How surely a text carries a licence, 0 to 1: independent kinds of evidence add up, repeats do not."""
    left = F.lit(1.0)
    for kind, weight in EVIDENCE.items():
        labels = F.flatten(F.transform(of_kind(finds, kind), lambda f: f["labels"]))
        left = left * F.pow(F.lit(1.0 - weight), F.size(F.array_distinct(labels)))
    return F.round(F.lit(1.0) - left, 6)


def label_text(finds: Column) -> Column:
    """Distinct labels of finds, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(finds, lambda f: f["labels"])))), ",")


def license_digest(scanned: DataFrame) -> DataFrame:
    """Counts, labels and a score for rows of `scan_licenses`, in place of ``finds``."""
    finds = F.col("finds")
    base = of_kind(finds, "base")
    known = F.filter(F.transform(finds, lambda f: f["freedom"]), lambda x: x.isNotNull())
    names = [f.name for f in scanned.schema if f.name != "finds"]
    added = {
        "n_base": F.size(base).cast("long"),
        "first_word": F.array_min(F.transform(base, lambda f: f["word"])),
        "last_word": F.array_max(F.transform(base, lambda f: f["word"])),
        "base_labels": label_text(base),
        "labels": label_text(finds),
        "score": evidence(finds),
        "n_tags": F.size(of_kind(finds, "tag")).cast("long"),
        "freedom": F.array_min(known),
    }
    return scanned.select(*[F.col(f"`{n}`") for n in names if n not in added],
                          *[c.alias(n) for n, c in added.items()])

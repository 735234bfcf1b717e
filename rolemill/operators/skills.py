"""Dictionary terms in texts: whole-word, overlapping, collapsed to canonical names.

A text is cut into runs of word characters and the separators between them.  A
plain term occurs exactly where it equals the text from the start of one run to
the end of another, so candidates are phrases of one to n runs and matching is
an equi-join with the dictionary.  Terms ending in ``+`` or ``#`` may begin and
end inside a run; their candidates come from the few runs that hold such a character.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemill.functions.text import let
from rolemill.plans.broadcast import broadcast_if_small, is_small
from rolemill.plans.session import materialize
from rolemill.plans.skew import join_per_key

# Characters that belong to a word here.
WORD = "a-z0-9+#."
RUN = f"[{WORD}]+"
RUN_BREAK = f"(?<=[{WORD}])(?=[^{WORD}])|(?<=[^{WORD}])(?=[{WORD}])"
RUN_START = f"(?<![{WORD}])[{WORD}]"
OPENER_BITS = 1 << 16  # bits of the table that tells which runs may open a longer term

OUT_ROWS = 50_000  # rows of an output batch

DICTIONARY = "skills array<struct<canonical:string,aliases:array<string>>>"


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(term, canonical) from a JSON file ``{skills: [{canonical, aliases}]}``."""
    entries = spark.read.schema(DICTIONARY).json(path, multiLine=True)
    return dictionary(entries.select(F.posexplode("skills").alias("pos", "e"))
                      .select("pos", "e.canonical", "e.aliases"))


def dictionary(entries: DataFrame) -> DataFrame:
    """Lower-cased terms of (pos, canonical, aliases); the first entry of a term wins."""
    terms = entries.select("pos", "canonical", F.posexplode(F.concat(
        F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias_pos", "term"))
    return (
        terms.withColumn("term", F.lower("term"))
        .groupBy("term")
        .agg(F.min_by("canonical", F.struct("pos", "alias_pos")).alias("canonical"))
    )


def _entry(term: Column, symbol: bool, at: Column) -> Column:
    return F.struct(term.alias("term"), F.lit(symbol).alias("symbol"), (at + 1).cast("int").alias("run"))


def _may_open(terms: DataFrame) -> Callable[[Column], Column]:
    """Test whether a run may open some term of several runs: a bit per hash of their first runs.

    The table has a fixed size whatever the dictionary's; a run that only shares a bit costs a phrase in vain.
    """
    first = F.regexp_extract("term", rf"\A{RUN}", 0)
    bit = F.pmod(F.xxhash64(first), F.lit(OPENER_BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))
    found = (terms.select(F.shiftright(bit, 6).alias("word"), one.alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect())  # at most OPENER_BITS / 64 numbers
    words = [0] * (OPENER_BITS // 64)
    for row in found:
        words[row["word"]] = row["bits"]
    table = F.lit(words).cast("array<bigint>")

    def test(run: Column) -> Column:
        at = F.pmod(F.xxhash64(run), F.lit(OPENER_BITS))
        return F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1

    return test


def _joined(p: Column, k: Column, n: int) -> Column:
    """``n`` runs from number ``k`` on, with the text between them."""
    parts = [F.get(p["runs"], k)]
    for j in range(1, n):
        parts += [F.get(p["gaps"], k + j), F.get(p["runs"], k + j)]
    return F.concat(*parts)


def _phrases(p: Column, longest: int, opens: Callable[[Column], Column] | None) -> Column:
    """Array of (term, symbol, run): every run, and phrases of 2 to ``longest`` runs.

    Longer phrases are only built where a run may open some term of the dictionary,
    with their separators taken verbatim.
    """
    single = F.transform(p["runs"], lambda r, k: _entry(r, False, k))
    if opens is None:
        return single

    def longer(starts: Column) -> Column:
        def of(n: int) -> Column:
            fits = F.filter(starts, lambda k: k + n <= F.size(p["runs"]))
            return F.transform(fits, lambda k: _entry(_joined(p, k, n), False, k))

        return F.concat(*[of(n) for n in range(2, longest + 1)])

    starts = F.array_compact(F.transform(p["runs"], lambda r, k: F.when(opens(r), k)))
    return F.concat(single, let(starts, longer))


def _symbol_phrases(p: Column, longest: int, most: int) -> Column:
    """Array of (term, symbol, run) of everything that a term ending in ``+`` or ``#`` could be.

    Such a term may begin inside a run, behind ``+``, ``#`` or ``.``, and end inside one; only runs that hold
    ``+`` or ``#`` are looked at, and nothing longer than ``most`` characters is built.
    """
    def ends(run: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.length(run)), lambda e: F.substring(run, e, F.lit(1)).isin("+", "#"))

    def starts(k: Column) -> Column:
        run = F.get(p["runs"], k)
        return F.filter(F.sequence(F.lit(1), F.length(run)), lambda s: F.when(
            s == 1, ~F.endswith(F.get(p["gaps"], k), F.lit("_"))).otherwise(
                F.substring(run, s - 1, F.lit(1)).isin("+", "#", ".")))

    def of(n: int) -> Column:
        def at(k: Column) -> Column:  # the term ends in run k
            j = k - (n - 1)
            body = F.concat(_joined(p, j, n - 1), F.get(p["gaps"], k)) if n > 1 else F.lit("")
            last = F.get(p["runs"], k)

            def from_start(s: Column) -> Column:
                low = s if n == 1 else F.lit(1)  # with one run, the end lies behind the start
                fits = F.filter(ends(last), lambda e: (e >= low) & (
                    F.length(body) + e - s + 1 <= most))
                whole = F.concat(body, last)
                return F.transform(fits, lambda e: _entry(
                    F.substring(whole, s, F.length(body) + e - s + 1), True, j))

            return F.flatten(F.transform(starts(j), from_start))

        held = F.array_compact(F.transform(p["runs"], lambda r, k: F.when(
            (F.contains(r, F.lit("+")) | F.contains(r, F.lit("#"))) & (k >= n - 1), k)))
        return F.flatten(F.transform(held, at))

    return F.concat(*[of(n) for n in range(1, longest + 1)])


def match_terms(df: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, canonical, occurrences, first_run) for every dictionary hit.

    ``first_run`` is the ordinal of the word run where the name first occurs.
    Texts are read once and never shuffled; only counted hits are.  The dictionary may be of
    any size: a small one travels to the texts, a large one meets their runs by join, hot runs split.
    """
    terms = materialize(terms.withColumn("symbol", F.col("term").rlike(r"[+#]\z")), "terms")
    runs = F.regexp_count("term", F.lit(RUN_START))
    plain, symbol = F.col("symbol") == F.lit(False), F.col("symbol")
    several = plain & F.col("term").rlike(f"[^{WORD}]")
    shape = terms.agg(
        F.max(F.when(several, runs)).alias("longest"), F.max(F.when(symbol, runs)).alias("symbol_runs"),
        F.max(F.when(symbol, F.length("term"))).alias("symbol_chars")).first()
    opens = _may_open(terms.where(several)) if shape["longest"] else None
    between = shape["longest"] or (shape["symbol_runs"] or 0) > 0
    low = F.lower(text)
    # Gap k is the text before run k; the first one may be empty.
    parts = F.struct(F.regexp_extract_all(low, F.lit(RUN), F.lit(0)).alias("runs"),
                     (F.split(low, RUN) if between else F.array(F.lit(""))).alias("gaps"))

    def spotted(p: Column) -> Column:
        whole = _phrases(p, shape["longest"] or 1, opens)
        if not shape["symbol_runs"]:
            return whole
        # Most texts hold neither character and are done here.
        marked = F.contains(low, F.lit("+")) | F.contains(low, F.lit("#"))
        return F.when(marked, F.concat(whole, _symbol_phrases(p, shape["symbol_runs"], shape["symbol_chars"]))).otherwise(whole)

    spots = let(parts, spotted)
    # Symbol terms are found as symbol phrases only, all others as whole phrases only.
    found = df.select(key, F.inline(spots))
    if is_small(terms):
        hits = found.join(F.broadcast(terms), ["term", "symbol"]).withColumn("n", F.lit(1))
    else:
        counted = found.groupBy(key, "term", "symbol").agg(F.count("*").alias("n"), F.min("run").alias("run"))
        hits = join_per_key(counted, terms.withColumnRenamed("symbol", "_symbol"), "term", "inner", spread=[key]).where(
            F.col("symbol") == F.col("_symbol"))
    return hits.groupBy(key, "canonical").agg(
        F.sum("n").alias("occurrences"), F.min("run").alias("first_run"))


def skill_lists(matches: DataFrame, key: str) -> DataFrame:
    """One ordered array of (skill, occurrences) per key, at most one entry per canonical."""
    entry = F.struct((-F.col("occurrences")).alias("rank"), "first_run",
                     F.col("canonical").alias("skill"), F.col("occurrences").cast("int").alias("occurrences"))
    return matches.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(entry)),
                    lambda e: F.struct(e["skill"].alias("skill"), e["occurrences"].alias("occurrences"))
                    ).alias("skills"))


def canonicalize(df: DataFrame, column: str, terms: DataFrame, out: str) -> DataFrame:
    """Canonical name of a column's value, or the value itself when unknown."""
    known = broadcast_if_small(terms.select(F.col("term").alias("_term"), F.col("canonical").alias("_name")))
    return (df.join(known, F.trim(F.lower(column)) == F.col("_term"), "left")
            .withColumn(out, F.coalesce("_name", column)).drop("_term", "_name"))


def token_offsets(df: DataFrame, key: str, text: str) -> DataFrame:
    """Word runs of every text with their character offset; texts stay in their tasks."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(RUN)
        for batch in batches:
            at, found, offsets = [], [], []
            for n, value in enumerate(batch.column("_low").to_pylist()):
                for m in runs.finditer(value or ""):
                    at.append(n)
                    found.append(m[0])
                    offsets.append(m.start())
            for a in range(0, len(at), OUT_ROWS):
                b = a + OUT_ROWS
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(at[a:b], pa.int64())), pa.array(found[a:b], pa.string()),
                     pa.array(offsets[a:b], pa.int64())], names=[key, "run", "offset"])

    return df.select(key, F.lower(text).alias("_low")).mapInArrow(run, f"`{key}` {kind}, run string, offset bigint")

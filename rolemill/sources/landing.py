"""Landing-zone scan: whole JSON payloads to one row per raw record.

Layout: ``<landing>/source=<feed>/[board=<slug>/|country=<code>/page=<n>/]*.json``.
Selecting feeds selects folders, so other feeds' files are never listed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemill.schemas import FEEDS

CORRUPT = "_corrupt_record"
UNREADABLE = "unreadable payload"


def select_feeds(names: Iterable[str] | None = None) -> list[str]:
    """All feeds, or the known ones among ``names``; unknown names are dropped."""
    if names is None:
        return list(FEEDS)
    wanted = {n.strip() for n in names}
    return [n for n in FEEDS if n in wanted]


def read_payloads(spark: SparkSession, landing: str, feed: str, streaming: bool = False,
                  max_files: int | None = None) -> DataFrame:
    """One row per landed file: payload text, board, country and arrival.

    ``max_files`` bounds a micro-batch of the streaming form.
    """
    reader = spark.readStream if streaming else spark.read
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = (
        reader.format("text").option("wholetext", True).option("recursiveFileLookup", True)
        .schema("value string").load(f"{landing.rstrip('/')}/source={feed}")
    )
    path = F.col("_metadata.file_path")

    def folder(key: str):
        return F.url_decode(F.nullif(F.regexp_extract(path, rf"/{key}=([^/]+)/", 1), F.lit("")))

    return raw.select(
        F.col("value").alias("payload"),
        folder("board").alias("board"),
        folder("country").alias("country"),
        path.alias("file"),
        F.col("_metadata.file_modification_time").alias("arrived_at"),
    )


def parse_payloads(payloads: DataFrame, feed: str) -> DataFrame:
    """Explode payloads to raw records.

    Adds ``raw`` (the record struct) and ``arrival`` (time, file, position: a
    total order).  A payload that is no valid envelope gives one row whose
    ``reject_reason`` is set and whose ``raw`` is null.
    """
    spec = FEEDS[feed]
    # Root arrays are wrapped, so that both shapes parse with one envelope schema
    # and a payload that is not an array fails to parse instead of being coerced.
    field = spec.envelope or "records"
    body = (F.col("payload") if spec.envelope else
            F.concat(F.lit('{"records":'), F.col("payload"), F.lit("}")))
    is_array = F.lit(True) if spec.envelope else F.ltrim(F.col("payload")).startswith("[")
    parsed = payloads.withColumn("_env", F.from_json(
        body, f"{field} array<struct<{_as_struct(spec.record)}>>, {CORRUPT} string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    broken = (F.col("_env").isNull() | F.col(f"_env.{CORRUPT}").isNotNull() | ~is_array)
    records = F.when(broken, F.array(F.lit(None).cast(f"struct<{_as_struct(spec.record)}>"))).otherwise(
        F.coalesce(F.col(f"_env.{field}"), F.array()))
    return (
        parsed.withColumn("reject_reason", F.when(broken, F.lit(UNREADABLE)))
        .select("*", F.posexplode(records).alias("_pos", "raw"))
        .withColumn("arrival", F.struct(F.col("arrived_at").alias("at"), F.col("file").alias("file"),
                                        F.col("_pos").alias("pos")))
        .drop("payload", "_env", "_pos", "arrived_at", "file")
    )


def _as_struct(fields: str) -> str:
    """``a int, b string`` to the colon form used inside ``struct<...>``."""
    out, depth, expect_colon = [], 0, True
    for ch in fields:
        depth += (ch == "<") - (ch == ">")
        if depth == 0 and ch == " " and expect_colon and out and out[-1] not in " ,":
            out.append(":")
            expect_colon = False
            continue
        if depth == 0 and ch == ",":
            expect_colon = True
        out.append(ch)
    return "".join(out)


def read_source(spark: SparkSession, landing: str, feed: str, streaming: bool = False) -> DataFrame:
    """Raw records of one feed from the landing zone, batch or stream."""
    return parse_payloads(read_payloads(spark, landing, feed, streaming), feed)

"""Content-addressed WARC archive as two tables, and the records read back from it.

``payloads`` holds every distinct payload once under its SHA-256; ``headers`` holds the
exact header bytes of every record and the digest of its payload.  A record is its
header, its block (the payload, or nothing for a revisit) and two line ends; reading
joins the tables, recomputes the digests and stops at any that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemill.plans.session import materialize, shared_folder

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: Column) -> Column:
    """Base-32 text of a hexadecimal digest with a multiple of 5 digits (SHA-1 has 40)."""
    def four(i: int) -> Column:
        part = F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0")
        return F.translate(part, "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)

    return F.concat(*(four(i) for i in range(8)))


def _line(name: str, value: Column) -> Column:
    """One header line, absent when the value is null; line ends inside a value are percent-coded."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(name + ": "), clean, F.lit(END)), F.lit(""))


def write_archive(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html",
                  revisit_bytes: int = 0) -> None:
    """Write ``folder/payloads`` and ``folder/headers``, one record for every row of ``pages``.

    Of the rows with equal payloads of at least ``revisit_bytes`` bytes the one with the
    largest id is the response and the others revisit it; smaller payloads are all
    responses.  A null page has an empty payload.  Among rows that share the largest id,
    one is the response; a row without an id ranks below all others and its record id
    has an empty number.  Other columns are not archived.
    """
    payload = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    body = pages.select(F.col(id).cast("long").alias("id"), F.col(url).alias("url"), payload.alias("payload"))
    facts = materialize(
        body.select(F.monotonically_increasing_id().alias("row"), "id", "url", F.sha2("payload", 256).alias("digest"),
                    F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes")), "facts")
    first = facts.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("top"))
    body.select(F.sha2("payload", 256).alias("digest"), "payload").dropDuplicates(["digest"]).write.option(
        "compression", "zstd").parquet(f"{folder}/payloads")
    known = facts.join(first, "digest")
    again = (F.col("bytes") >= revisit_bytes) & (F.col("top.row") != F.col("row"))
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1" + END),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", named(F.col("id"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))),
        _line("WARC-Profile", F.when(again, PROFILE)),
        _line("WARC-Refers-To", F.when(again, named(F.col("top.id")))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit(END))
    known.select("digest", F.encode(header, "UTF-8").alias("header")).write.option(
        "compression", "zstd").parquet(f"{folder}/headers")


def _value(name: str) -> Column:
    found = F.regexp_extract(F.col("head"), rf"(?md)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """All records: ``record`` (the original bytes) with what its header says and ``payload_bytes``.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload, for revisits
    too.  Fails on a record whose payload is missing or differs from either digest.
    """
    payloads = spark.read.parquet(f"{folder}/payloads")
    known = payloads.select(
        "digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_of_hex(F.sha1("payload")).alias("payload_digest"),
        (F.sha2("payload", 256) == F.col("digest")).alias("same"))
    rows = (spark.read.parquet(f"{folder}/headers").join(known, "digest", "left")
            .withColumn("head", F.decode("header", "UTF-8")))
    number = lambda name: F.regexp_extract(_value(name), r"^<urn:page:(-?\d+)>$", 1)
    parsed = rows.select(
        F.when(number("WARC-Record-ID") != "", number("WARC-Record-ID")).cast("long").alias("page_id"),
        "payload_bytes", "payload_digest", _value("WARC-Type").alias("record_type"),
        F.when(number("WARC-Refers-To") != "", number("WARC-Refers-To")).cast("long").alias("refers_to"),
        _value("Content-Length").cast("long").alias("block_bytes"),
        _value("WARC-Payload-Digest").alias("claimed"), "header", "payload", "same")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    whole = (F.col("same") & (F.col("claimed") == F.concat(F.lit("sha1:"), "payload_digest"))
             & (F.octet_length(block) == F.col("block_bytes")))
    record = F.concat("header", block, F.encode(F.lit(END + END), "UTF-8"))
    return parsed.select(
        "page_id", F.when(whole, F.col("payload_bytes")).otherwise(
            F.raise_error(F.lit("a payload differs from its digest")).cast("long")).alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to", record.alias("record"))


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a fresh archive in the shared folder and read it back."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_archive(pages, folder)
    return read_archive(spark, folder)

"""Uploads decode a text once, in the tasks the files are dealt to, and look at its ends only."""

from pyspark.sql import functions as F

from rolemill.functions.contacts import contacts
from rolemill.functions.experience import target_role
from rolemill.functions.sections import sections
from rolemill.functions.text import WS, WS_CHARS, trim_ws
from rolemill.sources.documents import route_documents


def test_decoding_stays_behind_the_shuffle_that_deals_the_files(spark):
    files = spark.range(12).repartition(6).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("d"), "id", F.lit(".txt")).alias("filename"),
        F.lit("text/plain").alias("content_type"), F.lit(1).alias("size"),
        F.encode(F.when(F.col("id") < 9, F.rpad(F.concat(F.lit("　 text "), "id"), 60, "x")).otherwise(" "), "UTF-8").alias("content"))
    texts, rejected = route_documents(files, once=True)
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert "validate" not in plan and "Repartition" not in plan  # read back, not decoded again
    assert texts.columns == ["id", "filename", "content_type", "size", "raw_text"] and texts.count() == 9
    assert [r.raw_text for r in texts.where("id = '3'").collect()] == ["text 3".ljust(57 + 1, "x")]
    assert {r.reject_reason for r in rejected.collect()} == {"text too short"} and rejected.count() == 3
    plain, _ = route_documents(files)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, texts.collect()))


def test_trimming_and_guarded_patterns(spark):
    values = [f"{a}x{a} y{b}{a}" for a in ["", *WS_CHARS] for b in ["", "​", "\n"]] + ["", " \t　", None]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    pattern = rf"\A{WS}+|{WS}+\z"
    assert df.where(~trim_ws(F.col("t")).eqNullSafe(F.regexp_replace("t", pattern, ""))).count() == 0
    texts = ["Data Engineer here", "engineer", "Senior  Product\nManager", "Managers", "call 555 123 4567", "12 34 56 78 90", "+44 (20) 7946-0958", None]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(
        target_role(sections(F.lit("")), F.col("t")).alias("role"), contacts(F.col("t"))["phone"].alias("phone")).collect()
    assert [r.role for r in found] == ["Data Engineer", None, "Senior  Product\nManager", *[None] * 5]
    assert [r.phone for r in found] == [*[None] * 4, "555 123 4567", None, "+44 (20) 7946-0958", None]

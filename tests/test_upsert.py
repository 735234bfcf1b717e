"""Table changes: fold, upsert, insert-ignore, replace sets, retention, store."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolemill import schemas
from rolemill.operators import admin, upsert
from rolemill.plans import ingest
from rolemill.plans.session import shared_folder
from rolemill.plans.store import Store

P1, P2 = dt.datetime(2026, 8, 1), dt.datetime(2026, 8, 2)
T1, T2 = "2026-08-10 00:00:00", "2026-08-11 00:00:00"


def ts(text):
    return F.lit(text).cast("timestamp")


def postings(spark, rows):
    cols = ("title string, company string, location string, remote_allowed boolean, seniority string, "
            "salary_min int, salary_max int, salary_currency string, salary_period string, "
            "description string, url string, skills array<string>, posted_at timestamp, source string, "
            "source_job_id string, arrival int, hq_location string")
    base = dict(title="Data Engineer", company="Acme", location="Paris", remote_allowed=None, seniority="mid",
                salary_min=None, salary_max=None, salary_currency=None, salary_period=None, description="D1",
                url="u1", skills=["sql"], posted_at=P1, source="a", source_job_id="1", arrival=1, hq_location=None)
    names = [c.split(" ")[0] for c in cols.split(", ")]
    return ingest.enrich(spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], cols))


def test_seen_again(spark):
    empty = spark.createDataFrame([], schemas.JOBS)
    one = ingest.upsert_jobs(empty, postings(spark, [{}]), ts(T1))
    row = one.first()
    assert (row.title, row.posted_at, row.description, row.embedding_status) == ("Data Engineer", P1, "D1", "pending")
    embedded = one.withColumn("embedding_status", F.lit("embedded"))
    again = postings(spark, [dict(title="data  engineer", posted_at=None, description="D2", url="u2", source="b")])
    row = ingest.upsert_jobs(embedded, again, ts(T2)).collect()
    assert len(row) == 1
    row = row[0]
    assert (row.title, row.url, row.posted_at, row.description) == ("Data Engineer", "u1", P1, "D2")
    assert row.summary.startswith("data  engineer · ") and row.embedding_status == "embedded"
    assert row.last_seen_at == dt.datetime(2026, 8, 11) and row.updated_at == dt.datetime(2026, 8, 10)


def test_headquarters(spark):
    df = spark.createDataFrame([("Hybrid", "Berlin"), (None, "Berlin"), ("Paris", "Berlin"), ("", "Berlin"),
                                ("REMOTE", None)], "l string, h string")
    assert [r[0] for r in df.select(ingest.with_headquarters(F.col("l"), F.col("h"))).collect()] == [
        "Hybrid · Berlin", "Berlin", "Paris", "Berlin", "REMOTE"]


def test_earliest_posted(spark):
    empty = spark.createDataFrame([], schemas.JOBS)
    state = ingest.upsert_jobs(empty, postings(spark, [dict(posted_at=P2)]), ts(T1), earliest_posted=True)
    state = ingest.upsert_jobs(state, postings(spark, [dict(posted_at=P1)]), ts(T2), earliest_posted=True)
    assert state.first().posted_at == P1


RECORD = st.fixed_dictionaries({
    "title": st.sampled_from(["A b", "a  B", "C"]), "description": st.sampled_from([None, "x", "y"]),
    "posted_at": st.sampled_from([None, P1, P2]), "url": st.sampled_from(["u1", "u2"])})


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(RECORD, min_size=1, max_size=6), st.integers(0, 6))
def test_batch_split_does_not_matter(spark, records, cut):
    records = [dict(r, arrival=i) for i, r in enumerate(records)]
    empty = spark.createDataFrame([], schemas.JOBS)
    whole = ingest.upsert_jobs(empty, postings(spark, records), ts(T1))
    parts = empty
    for part in (records[:cut], records[cut:]):
        if part:
            parts = ingest.upsert_jobs(parts, postings(spark, part), ts(T1))
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    again = ingest.upsert_jobs(whole, postings(spark, records[-1:]), ts(T1))
    assert sorted(map(str, again.collect())) == sorted(map(str, ingest.upsert_jobs(
        again, postings(spark, records[-1:]), ts(T1)).collect()))


def test_insert_ignore(spark):
    state = spark.createDataFrame([("j", "a", "old")], "job string, source string, ref string")
    batch = spark.createDataFrame([("j", "a", "new", 1), ("j", "b", "late", 3), ("j", "b", "early", 2)],
                                  "job string, source string, ref string, arrival int")
    got = upsert.insert_ignore(state, batch, ["job", "source"]).collect()
    assert sorted(map(tuple, got)) == [("j", "a", "old"), ("j", "b", "early")]


def test_replace_sets(spark):
    state = spark.createDataFrame([("1", "x"), ("1", "y"), ("2", "z"), ("3", "k")], "job string, skill string")
    batch = spark.createDataFrame([("1", ["a", "b", "a"], 1), ("1", ["c", "c"], 2), ("2", [], 1), ("3", None, 1)],
                                  "job string, skills array<string>, arrival int")
    got = upsert.replace_sets(state, batch, "job", "skill", "skills").collect()
    assert sorted(map(tuple, got)) == [("1", "c"), ("2", "z"), ("3", "k")]


def test_retention(spark):
    jobs = spark.createDataFrame([("1", dt.datetime(2026, 7, 20)), ("2", dt.datetime(2026, 7, 21)), ("3", None)],
                                 "id string, last_seen_at timestamp")
    links = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "c")], "job_id string, source string")
    skills = spark.createDataFrame([("1", "s")], "job_id string, skill string")
    out = admin.retain(jobs, links, skills, ts("2026-08-20 00:00:00"))
    assert sorted(r.id for r in out["jobs"].collect()) == ["2", "3"]
    assert out["job_sources"].count() == 2 and out["job_skills"].count() == 0


def test_store(spark):
    store = Store(spark, shared_folder(spark, "store"), buckets=4,
                  tables={"t": ("k string, v int", "k")})
    assert store.read("t").count() == 0
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(20)], "k string, v int")
    store.append("t", rows)
    keys = spark.createDataFrame([("k3",), ("k4",)], "k string")
    store.change("t", keys, lambda s: s.withColumn("v", F.when(F.col("k").isin("k3", "k4"), -1).otherwise(F.col("v"))))
    got = {r.k: r.v for r in store.read("t").collect()}
    assert len(got) == 20 and got["k3"] == got["k4"] == -1 and got["k5"] == 5
    store.change("t", rows, lambda s: s.where(F.col("k") == "k7"))
    assert [r.k for r in store.read("t").collect()] == ["k7"]


def test_error_rollup(spark):
    rows = [("g", f"b{i:04d}", "x" * 20) for i in range(500)] + [("l", "z", "dead")]
    df = spark.createDataFrame(rows, "name string, board string, msg string")
    got = {r.name: r.last_error for r in admin.roll_up_errors(df, "name", "board", "msg").collect()}
    full = "; ".join(f"{b}: {m}" for n, b, m in rows if n == "g")[:1000]
    assert got == {"g": full, "l": "z: dead"}


def test_error_rollup_of_empty_parts(spark):
    rows = [("k", None, "x")] * 400
    got = admin.roll_up_errors(spark.createDataFrame(rows, "name string, part string, message string"), "name", "part", "message")
    assert got.first()["last_error"] == "; ".join(["x"] * 400)[:1000]


@pytest.mark.parametrize("max_chars", [1000, 7, 8])
def test_error_rollup_cuts_in_tasks_first(spark, max_chars):
    rows = [("hot", None, None)] * 300 + [("hot", None, "")] * 400 + [("hot", "b", str(i % 9)) for i in range(900)] + [("l", "z", None)]
    df = spark.createDataFrame(rows, "name string, part string, message string").repartition(5)
    rolled = admin.roll_up_errors(df, "name", "part", "message", max_chars)
    assert "WindowGroupLimit" in rolled._jdf.queryExecution().optimizedPlan().toString()
    hot = [""] * 700 + [f"b: {i}" for i in sorted(str(i % 9) for i in range(900))]
    assert {r.name: r.last_error for r in rolled.collect()} == {"hot": "; ".join(hot)[:max_chars], "l": "z"[:max_chars]}


def test_store_keeps_its_bucket_count(spark):
    root = shared_folder(spark, "store")
    names = spark.createDataFrame([(f"n{i}",) for i in range(40)], "name string")
    shape = Store(spark, root, buckets=16, tables={"t": ("name string, n int", "name")})
    shape.append("t", names.withColumn("n", F.lit(1)))
    other = Store(spark, root, buckets=64, tables={"t": ("name string, n int", "name")})
    other.change("t", names, lambda state: state.withColumn("n", F.lit(2)))
    assert other.bucket_count("t") == 16
    assert [(r["n"], r["count"]) for r in other.read("t").groupBy("n").count().collect()] == [(2, 40)]

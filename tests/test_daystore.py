"""Postings by day: the same table as the bucketed form, batches that cost what they bring, folders dropped whole."""

import os
import random
import string

import pytest
from pyspark.sql import functions as F

from rolemill import schemas
from rolemill.operators.embedding import hashed_token_encoder
from rolemill.plans.daystore import DayStore, current, embed, read_jobs, read_links, retire, sight
from rolemill.plans.ingest import enrich, upsert_jobs
from rolemill.plans.session import shared_folder
from rolemill.operators.upsert import replace_sets

COLUMNS = ("title string, company string, location string, remote_allowed boolean, seniority string, salary_min bigint, "
           "salary_max bigint, salary_currency string, salary_period string, description string, url string, skills array<string>, "
           "posted_at string, hq_location string, source string, source_job_id string, arrival bigint")


def at(text):
    return F.lit(text).cast("timestamp")


@pytest.fixture
def store(spark):
    return DayStore(spark, shared_folder(spark, "days"))


def batch(spark, rows):
    return enrich(spark.createDataFrame(rows, COLUMNS).withColumn("posted_at", F.col("posted_at").cast("timestamp")))


def posting(r, i, arrival, text=None):
    return (f"Title {i}", "Acme", r.choice(["Paris", "Remote", None]), r.choice([True, None]), r.choice(["mid", None]), r.choice([1, None]),
            None, None, None, text if text is not None else r.choice(["same", "other", None, ""]), f"u{arrival}",
            [r.choice("abc")] if r.random() < 0.5 else [], r.choice(["2026-01-01 00:00:00", None]), None, r.choice(["x", "y"]), str(arrival), arrival)


def same(a, b):
    names = sorted(c for c in a.columns)
    return sorted(map(str, a.select(*names).collect())) == sorted(map(str, b.select(*names).collect()))


def test_equals_the_bucketed_upsert(spark, store):
    r = random.Random(3)
    jobs, skills = spark.createDataFrame([], schemas.JOBS), spark.createDataFrame([], schemas.JOB_SKILLS)
    for day in range(4):
        # Location is part of a posting's identity, so it is the same in all sightings of a title.
        rows = [posting(random.Random(i), i, day * 100 + n, r.choice(["same", f"text {day}", None]))
                for n, i in enumerate(r.choices(range(12), k=20))]
        now, new = at(f"2026-08-0{day + 1} 12:00:00"), batch(spark, rows)
        jobs = spark.createDataFrame(upsert_jobs(jobs, new, now).collect(), schemas.JOBS)
        sets = replace_sets(skills, new.select(F.col("id").alias("job_id"), F.col("skills").alias("s"), "arrival"), "job_id", "skill", "s")
        skills = spark.createDataFrame(sets.collect(), schemas.JOB_SKILLS)
        before = current(store).count()
        counts = sight(store, new, now)
        assert counts["inserted"] == jobs.count() - before
        assert same(read_jobs(store), jobs) and same(read_links(store)[1], skills)
    assert same(read_jobs(store, wide=False), jobs.drop("description", "summary", "embedding"))
    assert sight(store, batch(spark, []), now) == {"inserted": 0, "updated": 0, "texts": 0}
    assert same(read_jobs(store), jobs)


def size(store, *skip):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(store.root) for f in names
               if f.endswith(".parquet") and not any(s in d for s in skip))


def test_a_batch_costs_what_it_brings(spark, store):
    r = random.Random(1)
    text = lambda i: "".join(random.Random(i).choices(string.ascii_letters, k=3000))  # noqa: E731 - does not compress
    sight(store, batch(spark, [posting(random.Random(i), i, i, text(i)) for i in range(2000)]), at("2026-08-01 00:00:00"))
    again = batch(spark, [posting(random.Random(i), i, 5000 + i, text(i)) for i in r.sample(range(2000), 200)]).coalesce(1)
    again.write.parquet(f"{store.root}/_batch")
    whole, brought = size(store, "_batch"), size(store) - size(store, "_batch")
    assert sight(store, again, at("2026-08-02 00:00:00"))["texts"] == 0
    wrote = size(store, "_batch") - whole
    assert wrote < brought / 2 < whole / 10, (wrote, brought, whole)
    embed(store, lambda: hashed_token_encoder(8), at("2026-08-02 01:00:00"), 8)
    assert size(store, "_batch") - whole - wrote < whole / 10  # a drain writes no text again
    assert read_jobs(store).where("embedding_status = 'embedded' and size(embedding) = 8").count() == 2000


def test_a_change_that_dies_is_finished(spark, store, monkeypatch):
    rows = batch(spark, [posting(random.Random(i), i, i, f"text {i}") for i in range(10)])
    real = DayStore.append_once

    def dies(self, name, *args):
        if name == "postings":
            raise RuntimeError("gone")
        return real(self, name, *args)

    monkeypatch.setattr(DayStore, "append_once", dies)
    with pytest.raises(RuntimeError):
        sight(store, rows, at("2026-08-01 00:00:00"), tag="t1")
    assert read_jobs(store).count() == 0
    monkeypatch.setattr(DayStore, "append_once", real)
    for _ in range(2):
        sight(store, rows, at("2026-08-01 00:00:00"), tag="t1")
    links, _ = read_links(store)
    assert read_jobs(store).count() == 10 and links.count() == 10


def test_retention_drops_folders_and_moves_what_is_used(spark, store, monkeypatch):
    every = [posting(random.Random(i), i, i, f"text {i}") for i in range(20)]
    sight(store, batch(spark, every), at("2026-06-01 00:00:00"))
    embed(store, lambda: hashed_token_encoder(4), at("2026-06-01 01:00:00"), 4)
    sight(store, batch(spark, every[:8]), at("2026-06-20 00:00:00"))
    sight(store, batch(spark, every[8:12]), at("2026-07-01 00:00:00"))
    real = DayStore.drop_days

    def dies(self, name, days):
        real(self, name, days)
        if name == "posting_vectors":
            raise RuntimeError("gone")

    monkeypatch.setattr(DayStore, "drop_days", dies)
    with pytest.raises(RuntimeError):
        retire(store, at("2026-07-10 00:00:00"), 30)
    monkeypatch.setattr(DayStore, "drop_days", real)
    retire(store, at("2026-07-10 00:00:00"), 30)
    kept = read_jobs(store)
    assert sorted(x.description for x in kept.collect()) == sorted(f"text {i}" for i in range(12))
    assert kept.where("embedding_status = 'embedded' and size(embedding) = 4").count() == 12
    assert "2026-06-01" not in sum((store.days(n) for n in ("postings", "posting_texts", "posting_vectors", "posting_sources")), [])
    assert read_links(store)[0].count() == 12
    # Exactly as old as the limit stays; a moment older goes, and comes back as a new posting.
    retire(store, at("2026-07-20 00:00:00"), 30)
    assert read_jobs(store).count() == 12
    retire(store, at("2026-07-20 00:00:01"), 30)
    assert read_jobs(store).count() == 4 and read_links(store)[0].count() == 4
    assert sight(store, batch(spark, every[:1]), at("2026-07-21 00:00:00"))["inserted"] == 1
    row = read_jobs(store).where("title = 'Title 0'").first()
    assert row.fetched_at == row.last_seen_at and row.description == "text 0"

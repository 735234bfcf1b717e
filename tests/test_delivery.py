"""Micro-batches that die half way and come again, and boards that fail inside them."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolemill.operators.embedding import EncodeError, hashed_token_encoder
from rolemill.plans import ingest as plan
from rolemill.plans.files import Files
from rolemill.plans.session import shared_folder
from rolemill.plans.store import Store
from rolemill.streaming.commits import Commits, stream_id
from rolemill.streaming.ingest import ingest_stream, log_batches, upsert_stream
from rolemill.streaming.queue import drain_batches

def as_of():
    return F.lit("2026-08-20 00:00:00").cast("timestamp")


class Dies(Exception):
    pass


@pytest.fixture
def store(spark):
    return Store(spark, shared_folder(spark, "state"), buckets=2)


def dying(store, name, at):
    """The store's method raises at its ``at``-th call."""
    calls, method = [], getattr(Store, name)

    def call(self, *args, **kwargs):
        calls.append(1)
        if len(calls) == at:
            raise Dies(name)
        return method(self, *args, **kwargs)

    return call


def test_small_files_are_written_once(spark, tmp_path):
    files, path = Files(spark), str(tmp_path / "a" / "b.json")
    assert files.read(path) is None and files.names(str(tmp_path / "a")) == []
    assert files.write_once(path, "é 1") == "é 1" == files.write_once(path, "other") == files.read(path)
    assert files.names(str(tmp_path / "a")) == ["b.json"]


def test_append_once(spark, store, monkeypatch):
    rows = spark.createDataFrame([(f"j{i}", "s", str(i)) for i in range(50)], "job_id string, source string, source_job_id string"
                                 ).withColumn("first_seen_at", as_of())
    assert store.append_once("job_sources", rows, "q-0") and not store.append_once("job_sources", rows, "q-0")
    assert store.read("job_sources").count() == 50
    # The run dies when half of the files have been moved: the next one moves the rest, from what was staged.
    real, moved = Store._fs, []

    def few(self, folder):
        if "q-1-part" in folder:
            moved.append(folder)
            if len(moved) == 2:
                raise Dies
        return real(self, folder)

    monkeypatch.setattr(Store, "_fs", few)
    with pytest.raises(Dies):
        store.append_once("job_sources", rows, "q-1")
    monkeypatch.setattr(Store, "_fs", real)
    nothing = rows.where(F.raise_error(F.lit("looked at again")).isNull())
    assert store.append_once("job_sources", nothing, "q-1")
    assert store.read("job_sources").count() == 100


def landing(root):
    def put(rel, payload):
        os.makedirs(os.path.dirname(f"{root}/{rel}"), exist_ok=True)
        with open(f"{root}/{rel}", "w") as f:
            json.dump(payload, f)

    put("source=arbeitnow/1.json", {"data": [dict(id=i, title=f"T{i % 3}", company_name="Acme", tags=["SQL"]) for i in range(5)]})


@pytest.mark.parametrize("method,at", [("change", 1), ("append_once", 1), ("change", 2), ("change", 3)])
def test_ingest_batch_dies_and_comes_again(spark, store, tmp_path, monkeypatch, method, at):
    root, checkpoint = str(tmp_path / "landing"), str(tmp_path / "cp")
    landing(root)
    run = lambda: ingest_stream(spark, root, store, "arbeitnow", as_of(), checkpoint).awaitTermination()
    with monkeypatch.context() as patch:
        patch.setattr(Store, method, dying(store, method, at))
        with pytest.raises(Exception, match="Dies|change|append"):
            run()
    run()
    assert store.read("jobs").count() == 3 and store.read("job_sources").count() == 3 and store.read("job_skills").count() == 3
    log = store.read("sources").first()
    assert (log.last_status, log.jobs_fetched, log.last_error) == ("ok", 5, None)
    commits = Commits(store, stream_id(spark, checkpoint))
    assert commits.totals() == {"fetched": 5, "inserted": 3, "updated": 0, "rejected": 0}  # as counted before the first try
    assert commits.totals(since=1) == {}


def jobs(spark, store, n):
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"),
        F.concat(F.lit("T"), F.col("id") % 4).alias("title"), F.lit("pending").alias("embedding_status"),
        F.lit(0).alias("embedding_retry_count"))
    from workload.state import completed
    store.append("jobs", completed(store, "jobs", rows))


def test_drain_counts_a_failure_once(spark, store, monkeypatch):
    jobs(spark, store, 8)
    checkpoint, source = shared_folder(spark, "cp"), shared_folder(spark, "notices")
    notices = spark.range(8).select(F.lit("job").alias("kind"), F.col("id").cast("string").alias("id"))
    notices.unionByName(notices).coalesce(1).write.parquet(source)  # the same notice twice

    def flaky():
        encode = hashed_token_encoder(4)

        def run(texts):
            if any("T3" in t for t in texts):
                raise EncodeError("no")
            return encode(texts) if len(texts) == 1 else np.concatenate([encode([t]) for t in texts])

        return run

    def start():
        once = drain_batches(store, flaky, as_of(), checkpoint, 4)
        upsert_stream(spark.readStream.schema(notices.schema).parquet(source), once, checkpoint).awaitTermination()

    with monkeypatch.context() as patch:  # dies between the write-back and the marker
        patch.setattr(Commits, "commit", lambda *a: (_ for _ in ()).throw(Dies()))
        with pytest.raises(Exception):
            start()
    start()
    got = store.read("jobs").groupBy("embedding_status", "embedding_retry_count").count().collect()
    failed = sum(r["count"] for r in got if r["embedding_status"] == "failed")
    assert failed and all(r["embedding_retry_count"] == (r["embedding_status"] == "failed") for r in got)
    totals = Commits(store, stream_id(spark, checkpoint)).totals()
    assert totals["processed"] == 8 and totals["failed"] == failed == 8 - totals["embedded"]
    assert store.read("embedding_cache").count() == 4 - len({"T3"}) or failed > 2


def test_log_batches_and_empty_batches(spark, store):
    checkpoint, source = shared_folder(spark, "cp"), shared_folder(spark, "usage")
    rows = spark.range(20).select(F.col("id").cast("string").alias("id"), F.lit("u").alias("user_key"), F.lit("m").alias("model"),
                                  F.lit(1).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"), F.lit(False).alias("cached"),
                                  F.lit(5).alias("latency_ms"), as_of().alias("created_at"))
    once = log_batches(store, "chat_usage", checkpoint)
    for part in (rows, rows.where("false"), rows):
        part.coalesce(1).write.mode("append").parquet(source)
        upsert_stream(spark.readStream.schema(rows.schema).parquet(source), lambda b, n: (once(b, n), once(b, n)),
                      checkpoint).awaitTermination()
    assert store.read("chat_usage").count() == 40


def test_boards_fail_alone(spark, store):
    boards = spark.createDataFrame([(str(i), f"B{i}", "lever", f"b{i}", None, i != 4) for i in range(6)],
                                   "id string, name string, ats_type string, board_slug string, hq_location string, enabled boolean")
    store.append("companies", boards.withColumns({"created_at": as_of(), "updated_at": as_of()}))
    pages = spark.createDataFrame([(json.dumps([dict(id=str(i), text=f"Title {i}")]), f"b{i}") for i in range(6)]
                                  + [("{broken", "b5")], "payload string, board string")
    broken = F.when(F.col("board").isin("b2", "b4"), F.raise_error(F.concat(F.lit("no "), "board"))).otherwise(F.col("payload"))
    pages = pages.select(broken.alias("payload"), "board", F.lit(None).cast("string").alias("country"), F.col("board").alias("file"),
                         as_of().alias("arrived_at"))
    run = plan.ingest_payloads(store, lambda feed: pages, ["lever", "arbeitnow"], as_of())
    assert (run[0].fetched, run[0].inserted) == (4, 4)
    assert run[0].error == "b2: no b2; b5: unreadable payload"  # a disabled board is nobody's error
    assert sorted(r.source for r in store.read("job_sources").collect()) == [f"lever:b{i}" for i in (0, 1, 3, 5)]
    # Every board fails: the feed has failed, and so has nothing else.
    all_bad = pages.withColumn("payload", F.raise_error(F.lit("down")).cast("string"))
    run = plan.ingest_payloads(store, lambda feed: all_bad, ["lever"], as_of())
    assert run[0].error == "down" and store.read("job_sources").count() == 4

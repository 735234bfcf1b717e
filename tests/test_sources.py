"""Feeds: scan, normalize, quarantine, full ingest from a landing zone (batch and stream)."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from rolemill.plans import ingest as plan
from rolemill.plans.session import shared_folder
from rolemill.plans.store import Store
from rolemill.sources import adapters, boards, documents, landing
from rolemill.streaming.ingest import ingest_stream

UTC = dt.datetime


def payloads(spark, *rows):
    return spark.createDataFrame(
        [(json.dumps(p) if not isinstance(p, str) else p, b, c, f"f{i}", UTC(2026, 8, 1, i))
         for i, (p, b, c) in enumerate(rows)],
        "payload string, board string, country string, file string, arrived_at timestamp")


def registry(spark):
    return spark.createDataFrame(
        [("1", "Acme", "greenhouse", "acme", "Berlin", True), ("2", "Acme", "lever", "acme", None, True),
         ("3", "Off", "lever", "off", None, False), ("4", "Ash", "ashby", "ash", None, True)],
        "id string, name string, ats_type string, board_slug string, hq_location string, enabled boolean"
    ).withColumns({"created_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp")})


def run(spark, feed, *rows):
    return plan.scan_feed(payloads(spark, *rows), feed, registry(spark)).orderBy("arrival").collect()


def test_arbeitnow(spark):
    full = dict(id=7, title="Senior Dev", company_name="Co", location="Berlin", remote=True,
                description="<p>A &amp; B</p>", url="http://x", tags=["SQL", "Go"], created_at=1786516800,
                salary="€50,000 - 60,000")
    bare = dict(id="b", title="Dev", company_name="Co", company_slug="co", slug="dev", created_at="2026-08-01T10:00:00Z")
    ms = dict(id=1, title="Dev", company_name="Co", slug="dev", created_at=1786516800000)
    bad = dict(id=2, company_name="Co")
    odd = dict(id=3, title="T", company_name="C", created_at="soon")
    a, b, c, d, e = run(spark, "arbeitnow", ({"data": [full, bare, ms, bad, odd], "meta": 1}, None, None))
    assert (a.source, a.source_job_id, a.description, a.skills, a.seniority) == (
        "arbeitnow", "7", "A & B", ["sql", "go"], "senior")
    assert a.posted_at == UTC(2026, 8, 12, 6, 40) and c.posted_at == a.posted_at
    assert (a.salary_min, a.salary_max, a.salary_currency, a.salary_period) == (50000, 60000, "EUR", "yearly")
    assert b.url == "https://www.arbeitnow.com/jobs/co/dev" and b.remote_allowed is None and b.skills == []
    assert b.posted_at == UTC(2026, 8, 1, 10) and c.url == "https://www.arbeitnow.com"
    assert d.reject_reason == "missing title" and a.reject_reason is None
    assert e.posted_at is None and e.reject_reason is None


def test_remotive(spark):
    (a,) = run(spark, "remotive", ({"00-warning": "x", "jobs": [dict(
        id=1, title="T", company_name="C", tags=["A"], category="Dev Ops", publication_date="2026-08-16T10:09:41",
        candidate_required_location="EU", salary="$90k")]}, None, None))
    assert (a.skills, a.remote_allowed, a.location, a.salary_min) == (["a", "dev ops"], True, "EU", 90000)
    assert a.posted_at == UTC(2026, 8, 16, 10, 9, 41) and a.url == "https://remotive.com/remote-jobs"


def test_remoteok(spark):
    got = run(spark, "remoteok", ([{"legal": "notice"}, dict(
        id=5, position="P", company="C", epoch=1786516800, salary_min=60000, salary_max=90000.5, slug="s"), dict(
        slug="only-slug", position="P", company="C", date="2026-08-01T00:00:00+02:00", salary_min=1)], None, None))
    assert [r.source_job_id for r in got] == ["5", "only-slug"]
    assert (got[0].salary_min, got[0].salary_max, got[0].salary_period) == (60000, 90001, "yearly")
    assert got[0].url == "https://remoteok.com/remote-jobs/s" and got[0].posted_at == UTC(2026, 8, 12, 6, 40)
    assert got[1].posted_at == UTC(2026, 7, 31, 22) and got[1].salary_min is None


def test_adzuna(spark):
    got = run(spark, "adzuna", ({"results": [
        dict(id=1, title="Remote Dev", redirect_url="u", location=dict(display_name="d", area=["Australia", "NSW", "Sydney"]),
             salary_min=100000, salary_max=120000.9),
        dict(id=2, title="Dev", redirect_url="u", company=dict(display_name="X"), location=dict(display_name="SG", area=["Mars"]),
             salary_max=5),
        dict(id=3, title="Dev", redirect_url="u")]}, None, "au"))
    assert [(r.source_job_id, r.location, r.company, r.remote_allowed, r.salary_currency, r.salary_period) for r in got] == [
        ("au:1", "Sydney, Australia", "Confidential Employer", True, "AUD", "yearly"),
        ("au:2", "SG", "X", None, None, "yearly"),
        ("au:3", None, "Confidential Employer", None, None, None)]


def test_boards(spark):
    g = run(spark, "greenhouse", ({"jobs": [
        dict(id=1, title="T", location=dict(name="Remote EU"), updated_at="2026-08-01T00:00:00-04:00"),
        dict(id=2, title="T", company_name="Own")]}, "acme", None), ({"jobs": [dict(id=9, title="T")]}, "nobody", None))
    assert [(r.source, r.company, r.remote_allowed, r.url, r.hq_location) for r in g] == [
        ("greenhouse:acme", "Acme", True, "https://job-boards.greenhouse.io/1", "Berlin"),
        ("greenhouse:acme", "Own", None, "https://job-boards.greenhouse.io/2", "Berlin")]
    assert g[0].posted_at == UTC(2026, 8, 1, 4)
    l = run(spark, "lever", ([dict(id="x", text="T", company="Raw", createdAt=1786516800000, categories=dict(location="Paris"))],
                             "acme", None), ({"error": "no board"}, "acme", None), ([dict(id="y", text="T")], "off", None))
    assert [(r.source, r.company, r.remote_allowed, r.reject_reason) for r in l] == [
        ("lever:acme", "Acme", False, None), ("lever:acme", "Acme", None, "unreadable payload")]
    a = run(spark, "ashby", ({"jobs": [dict(id="1", title="T", location="x remote", isRemote=False, applyUrl="ap"),
                                       dict(id="2", title="T", location="x REMOTE", company="C")]}, "ash", None))
    assert [(r.company, r.remote_allowed, r.url) for r in a] == [
        ("Ash", False, "ap"), ("C", True, "https://jobs.ashbyhq.com/2")]


def test_broken_payload(spark):
    got = run(spark, "arbeitnow", ("{not json", None, None), ({"data": [dict(id=1, title="T", company_name="C")]}, None, None),
              ({"other": 1}, None, None))
    assert [(r.reject_reason, r.title) for r in got] == [("unreadable payload", None), (None, "T")]


def test_select_feeds():
    assert landing.select_feeds(["lever", "nope", " adzuna"]) == ["adzuna", "lever"]
    assert len(landing.select_feeds()) == 7


def write_landing(root):
    def put(rel, payload):
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(payload if isinstance(payload, str) else json.dumps(payload))

    same = dict(title="Data Engineer", company_name="Acme", location="Paris", tags=["SQL"])
    put("source=arbeitnow/1.json", {"data": [dict(same, id=1, salary="$90k"), dict(same, id=2, title="Other"), dict(id=3)]})
    put("source=remotive/1.json", {"jobs": [dict(id=1, title="data engineer", company_name="ACME", tags=["sql"],
                                                 candidate_required_location="paris", description="<b>new</b>")]})
    put("source=greenhouse/board=acme/1.json", {"jobs": [dict(id=1, title="Lead", location=dict(name="Hybrid"))]})
    put("source=lever/board=acme/1.json", {"not": "a list"})


def test_ingest_batch_and_stream_agree(spark, tmp_path):
    root = str(tmp_path / "landing")
    write_landing(root)
    as_of = F.lit("2026-08-20 00:00:00").cast("timestamp")
    feeds = ["arbeitnow", "remotive", "greenhouse", "lever", "adzuna"]
    stores = []
    for mode in ("batch", "stream"):
        store = Store(spark, shared_folder(spark, "state"), buckets=2)
        store.append("companies", registry(spark))
        if mode == "batch":
            runs = {r.feed: r for r in plan.ingest(spark, root, store, as_of, feeds)}
            assert (runs["arbeitnow"].fetched, runs["arbeitnow"].inserted, runs["arbeitnow"].rejected) == (3, 2, 1)
            assert runs["lever"].fetched == 0
            assert (runs["remotive"].inserted, runs["remotive"].updated) == (0, 1)
            assert runs["adzuna"].error and "unreadable" in runs["lever"].error
        else:
            for feed in feeds[:4]:
                ingest_stream(spark, root, store, feed, as_of, shared_folder(spark, "cp")).awaitTermination()
        stores.append(store)
    tables = []
    for store in stores:
        jobs = store.read("jobs").orderBy("title").collect()
        assert [(r.title, r.description, r.salary_min, r.location) for r in jobs] == [
            ("Data Engineer", "new", 90000, "paris"), ("Lead", None, None, "Hybrid · Berlin"),
            ("Other", None, None, "Paris")]
        links = sorted((r.source, r.source_job_id) for r in store.read("job_sources").collect())
        assert links == [("arbeitnow", "1"), ("arbeitnow", "2"), ("greenhouse:acme", "1"), ("remotive", "1")]
        log = {r.name: r.last_status for r in store.read("sources").collect()}
        assert log["lever"] == "error" and log["arbeitnow"] == "ok"
        tables.append([sorted(map(str, store.read(t).collect())) for t in ("jobs", "job_sources", "job_skills")])
    assert tables[0] == tables[1]
    # The same files again change nothing.
    plan.ingest(spark, root, stores[0], as_of, feeds)
    assert tables[0] == [sorted(map(str, stores[0].read(t).collect())) for t in ("jobs", "job_sources", "job_skills")]


def test_board_registry(spark):
    as_of = F.lit("2026-08-20 00:00:00").cast("timestamp")
    requests = spark.createDataFrame(
        [(" Acme ", "greenhouse", " new ", " Rome ", None, 1), ("Zed", "lever", "zed", "", False, 2),
         ("", "lever", "x", None, None, 3), ("A", "other", "x", None, None, 4), ("A", "lever", "", None, None, 5)],
        "name string, ats_type string, board_slug string, hq_location string, enabled boolean, arrival int")
    checked = boards.check_boards(requests)
    assert [r.reject_reason for r in checked.orderBy("arrival").collect()] == [
        None, None, "invalid name", "invalid board type", "invalid board slug"]
    good = checked.where("reject_reason is null").drop("reject_reason")
    now = boards.upsert_boards(registry(spark), good, as_of)
    rows = {(r.name, r.ats_type): r for r in now.collect()}
    assert len(rows) == 5 and rows["Acme", "greenhouse"].board_slug == "new"
    assert rows["Acme", "greenhouse"].id == "1" and rows["Zed", "lever"].enabled is False
    off = boards.disable_boards(now, ["1"], as_of).where("id = '1'").first()
    assert off.enabled is False
    assert boards.delete_boards(now, ["1"]).count() == 4
    links = spark.createDataFrame([("j1", "greenhouse:new"), ("j2", "greenhouse:new"), ("gone", "lever:acme")],
                                  "job_id string, source string")
    jobs = spark.createDataFrame([("j1",), ("j2",)], "id string")
    counts = {(r.name, r.ats_type): r.job_count for r in boards.boards_with_counts(now, links, jobs).collect()}
    assert counts["Acme", "greenhouse"] == 2 and counts["Acme", "lever"] == 0


def test_documents(spark, tmp_path):
    text = "Jane Doe\nSenior Data Engineer\n\nEXPERIENCE\nAcme: 2020 - 2023\n\nSkills:\nReact and Kafka, C++\n"
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.md").write_text("short")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.bin").write_bytes(b"\x00")
    (tmp_path / "e.txt").write_text("nothing to see in this document, only plain prose without any signals at all")
    good, bad = documents.route_documents(documents.read_documents(spark, str(tmp_path)))
    assert {r.filename: r.reject_reason for r in bad.collect()} == {
        "b.md": "text too short", "c.pdf": "pdf needs a decoder", "d.bin": "unsupported type"}
    terms = spark.createDataFrame([("react", "React"), ("kafka", "Kafka"), ("c++", "C++")], "term string, canonical string")
    as_of = F.lit("2026-08-20 00:00:00").cast("timestamp")
    parsed = documents.parse_profiles(good, terms, as_of)
    by_name = {r.filename: r for r in parsed.collect()}
    assert by_name["e.txt"].reject_reason and by_name["a.txt"].reject_reason is None
    profiles, skills = documents.profile_rows(parsed, as_of)
    row = profiles.first()
    assert row.target_role == "Senior Data Engineer" and row.estimated_years_experience == 3.0
    assert sorted((r.skill, r.occurrences) for r in skills.collect()) == [("C++", 1), ("Kafka", 1), ("React", 1)]
    kinds = spark.createDataFrame([("application/pdf", "x.txt"), ("", "x.docx"), ("application/msword", "x"),
                                   ("text/html", "x"), ("", "README.MD"), ("", "noext"), (None, None)], "c string, f string")
    assert [r[0] for r in kinds.select(documents.document_kind(F.col("c"), F.col("f"))).collect()] == [
        "pdf", "docx", "docx", "text", "text", "unsupported", "unsupported"]


def test_profiles_queue_and_retention_in_the_store(spark, tmp_path):
    from rolemill.operators.embedding import hashed_token_encoder
    from rolemill.operators.match import match
    from rolemill.operators.search import profile_detail
    from rolemill.operators.skills import read_dictionary
    from rolemill.plans import maintenance

    book = tmp_path / "dict.json"
    book.write_text(json.dumps({"version": 1, "skills": [
        {"canonical": "SQL", "aliases": ["Postgres"]}, {"canonical": "Go", "aliases": []}, {"canonical": "Late", "aliases": ["sql"]}]}))
    terms = read_dictionary(spark, str(book))
    assert {(r.term, r.canonical) for r in terms.collect()} == {("sql", "SQL"), ("postgres", "SQL"), ("go", "Go"), ("late", "Late")}

    docs, root = tmp_path / "docs", str(tmp_path / "landing")
    docs.mkdir()
    (docs / "cv.txt").write_text("Jane\nData Engineer\n\nSKILLS\nsql, Go and more things to fill the line\n")
    (docs / "bad.txt").write_text("tiny")
    write_landing(root)
    as_of = F.lit("2026-08-20 00:00:00").cast("timestamp")
    store = Store(spark, shared_folder(spark, "state"), buckets=2)
    store.append("companies", registry(spark))
    plan.ingest(spark, root, store, as_of, ["arbeitnow", "remotive", "greenhouse"])
    for _ in range(2):
        rejected = maintenance.upload(store, documents.read_documents(spark, str(docs)), terms, as_of)
        assert [r.reject_reason for r in rejected.collect()] == ["text too short"]
    assert store.read("cv_profiles").count() == 1 and store.read("cv_skills").count() == 2

    stats = maintenance.drain(store, lambda: hashed_token_encoder(16), as_of, 16)
    assert stats == {"processed": 4, "embedded": 4, "cached": 0, "failed": 0}
    assert maintenance.drain(store, lambda: hashed_token_encoder(16), as_of, 16)["processed"] == 0
    assert store.read("embedding_cache").count() == 4
    cv = store.read("cv_profiles").first()
    best = match(store.read("jobs"), store.read("cv_profiles"), cv.id, as_of, limit=2).collect()
    assert best[0].title == "Data Engineer" and best[0].score >= best[1].score
    assert profile_detail(store.read("cv_profiles"), cv.id).first().target_role == "Data Engineer"

    maintenance.remove_stale(store, F.lit("2026-10-01 00:00:00").cast("timestamp"))
    assert [store.read(t).count() for t in ("jobs", "job_sources", "job_skills")] == [0, 0, 0]

    log = spark.createDataFrame([("p", "hi", "m", 1), ("p", "later", "m", 2)],
                                "prompt_hash string, response_text string, model string, arrival int").withColumn("created_at", as_of)
    for _ in range(2):
        maintenance.record(store, "chat_cache", log, ["prompt_hash"])
    assert [r.response_text for r in store.read("chat_cache").collect()] == ["hi"]


def test_stream_takes_only_new_files(spark, tmp_path):
    root = str(tmp_path / "landing")
    write_landing(root)
    store = Store(spark, shared_folder(spark, "state"), buckets=2)
    checkpoint = shared_folder(spark, "cp")
    days = [F.lit(d).cast("timestamp") for d in ("2026-08-20 00:00:00", "2026-08-21 00:00:00")]
    ingest_stream(spark, root, store, "arbeitnow", days[0], checkpoint).awaitTermination()
    # A late record of a known posting, and a new one.
    with open(os.path.join(root, "source=arbeitnow", "2.json"), "w") as f:
        json.dump({"data": [dict(id=9, title="DATA engineer", company_name="acme", location="Paris", tags=["sql"],
                                 description="late"), dict(id=10, title="New", company_name="Acme")]}, f)
    ingest_stream(spark, root, store, "arbeitnow", days[1], checkpoint).awaitTermination()
    rows = {r.title: r for r in store.read("jobs").collect()}
    assert sorted(rows) == ["Data Engineer", "New", "Other"]
    assert rows["Data Engineer"].description == "late" and rows["Data Engineer"].last_seen_at == UTC(2026, 8, 21)
    assert rows["Other"].last_seen_at == UTC(2026, 8, 20)
    assert store.read("sources").first().jobs_fetched == 2

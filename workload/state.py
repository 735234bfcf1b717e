"""Runs over state tables: what they leave behind, also when parts fail or arrive twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolemill.operators import prompts
from rolemill.operators.embedding import hashed_token_encoder
from rolemill.plans.daystore import DayStore, embed, read_jobs, read_links, retire, sight
from rolemill.operators.skills import read_dictionary
from rolemill.plans import maintenance
from rolemill.plans.ingest import ingest_payloads, scan_feed
from rolemill.plans.session import shared_folder
from rolemill.plans.store import Store
from rolemill.sources.landing import select_feeds
from rolemill.streaming.commits import Commits, stream_id
from rolemill.streaming.ingest import ingest_batches, log_batches, upsert_stream
from rolemill.streaming.queue import drain_batches
from rolemill.functions.identity import text_key
from rolemill.functions.text import normalize_text
from workload import sql as S
from workload.common import SQL, Tables, query
from workload.feeds import adzuna_pages, arbeitnow_pages, greenhouse_pages, registry, remotive_pages
from workload.feeds import pages as feed_pages
from workload import operations  # noqa: F401 - registers the SQL that a query below continues
from workload.texts import MATCHES, WORDS

AS_OF = "2026-08-20 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def fresh_store(t: Tables, **tables: DataFrame) -> Store:
    """A store of its own in the shared folder, holding the given rows."""
    store = Store(t.spark, shared_folder(t.spark, "state"), buckets=4)
    for name, rows in tables.items():
        store.append(name, completed(store, name, rows))
    return store


def completed(store: Store, name: str, rows: DataFrame) -> DataFrame:
    """Rows with the table's other columns as null."""
    have = set(rows.columns)
    return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name)
                              for f in T.StructType.fromDDL(store.tables[name][0]) if f.name not in have])


def arriving(t: Tables, rows: DataFrame, second: Column, apply: Callable[[str], Callable[[DataFrame, int], None]]) -> str:
    """Rows as a stream of two micro-batches, each delivered twice; returns the checkpoint."""
    folder, checkpoint = shared_folder(t.spark, "arriving"), shared_folder(t.spark, "checkpoint")
    once = apply(checkpoint)

    def twice(batch: DataFrame, number: int) -> None:
        once(batch, number)
        once(batch, number)

    for part in (rows.where(~second), rows.where(second)):
        part.write.mode("append").parquet(folder)
        upsert_stream(t.spark.readStream.schema(rows.schema).parquet(folder), twice, checkpoint).awaitTermination()
    return checkpoint


def totals(store: Store, checkpoint: str) -> dict:
    return Commits(store, stream_id(store.spark, checkpoint)).totals()


def counted(t: Tables, counts: dict) -> DataFrame:
    return t.spark.createDataFrame([(k, int(v)) for k, v in counts.items()], "name string, n bigint")


# Isolation of boards

FAILING = ["NATION_3", "NATION_7"]
PAGES = ("(SELECT n_name, 'greenhouse:' || n_name AS source, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE c_mktsegment END AS posting, "
         "c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 4)")


def broken_pages(t: Tables) -> DataFrame:
    """Pages of which those of two boards raise when a task reads them."""
    cut = F.raise_error(F.concat(F.lit("page of "), "board", F.lit(" is cut off")))
    return greenhouse_pages(t).withColumn("payload", F.when(F.col("board").isin(FAILING), cut).otherwise(F.col("payload")))


def links_and_log(store: Store) -> DataFrame:
    links = store.read("job_sources").groupBy(F.col("source").alias("name")).agg(
        F.count("*").alias("n"), F.lit(None).cast("string").alias("error"))
    log = store.read("sources").select("name", F.col("jobs_fetched").alias("n"), F.col("last_error").alias("error"))
    return links.unionByName(log)


ISOLATED = f"""SELECT source AS name, count(DISTINCT posting) AS n, CAST(NULL AS VARCHAR) AS error FROM {PAGES}
      WHERE n_name NOT IN ('NATION_3', 'NATION_7') GROUP BY 1
    UNION ALL SELECT 'greenhouse', count(*) FILTER (n_name NOT IN ('NATION_3', 'NATION_7')),
      string_agg(DISTINCT n_name || ': page of ' || n_name || ' is cut off', '; ' ORDER BY n_name || ': page of ' || n_name || ' is cut off')
        FILTER (n_name IN ('NATION_3', 'NATION_7')) FROM {PAGES}"""


@query(ISOLATED)
def ingest_isolated(t: Tables) -> DataFrame:
    """Two boards raise in tasks: all others are written, and the run log names the two."""
    store = fresh_store(t, companies=registry(t, "greenhouse"))
    ingest_payloads(store, lambda feed: broken_pages(t), ["greenhouse"], as_of())
    return links_and_log(store)


@query(ISOLATED)
def stream_ingest_once(t: Tables) -> DataFrame:
    """The same pages as two micro-batches, each delivered twice: links and run log count once."""
    store = fresh_store(t, companies=registry(t, "greenhouse"))
    rows = greenhouse_pages(t)
    cut = F.raise_error(F.concat(F.lit("page of "), "board", F.lit(" is cut off")))

    def apply(checkpoint: str):
        once = ingest_batches(store, "greenhouse", as_of(), checkpoint)
        return lambda batch, n: once(batch.withColumn(
            "payload", F.when(F.col("board").isin(FAILING), cut).otherwise(F.col("payload"))), n)

    checkpoint = arriving(t, rows, F.pmod(F.xxhash64("file"), F.lit(2)) == 1, apply)
    done = totals(store, checkpoint)
    log = store.read("sources").select("name", F.lit(done["fetched"]).cast("bigint").alias("n"), F.col("last_error").alias("error"))
    return links_and_log(store).where(F.col("name") != "greenhouse").unionByName(log)


@query("""SELECT 'remotive' AS name, 'ok' AS last_status, count(*) AS jobs_fetched FROM customer
    UNION ALL SELECT 'adzuna', 'ok', count(*) FROM supplier""")
def ingest_selected(t: Tables) -> DataFrame:
    """Only the feeds that were named run; unknown names are dropped."""
    store, pages = fresh_store(t), {"remotive": remotive_pages, "adzuna": adzuna_pages, "arbeitnow": arbeitnow_pages}
    ingest_payloads(store, lambda feed: pages[feed](t), select_feeds([" adzuna", "nope", "remotive", "Arbeitnow"]), as_of())
    return store.read("sources").select("name", "last_status", "jobs_fetched")


@query("""WITH r AS (SELECT o_orderkey // 100 AS page, CASE WHEN o_orderkey % 7 = 0 THEN 'missing title'
        WHEN o_orderkey % 11 = 0 THEN 'missing company' ELSE 'accepted' END AS outcome FROM orders)
    SELECT outcome, count(*) AS n FROM r WHERE page % 5 <> 0 GROUP BY 1
    UNION ALL SELECT 'unreadable payload', count(DISTINCT page) FROM r WHERE page % 5 = 0""")
def record_quarantine(t: Tables) -> DataFrame:
    """Records without a title or company, and pages cut off in the middle, are set aside one by one."""
    n = F.col("o_orderkey")
    record = F.struct(n.alias("id"), F.when(n % 7 != 0, F.col("o_orderpriority")).alias("title"),
                      F.when(n % 11 != 0, F.concat(F.lit("C"), n)).alias("company_name"))
    whole = feed_pages(t.orders, record, n, "data")
    number = F.substring_index("file", "/", -1).cast("bigint")
    cut = whole.withColumn("payload", F.when(number % 5 == 0, F.expr("left(payload, length(payload) - 3)")).otherwise(F.col("payload")))
    return scan_feed(cut, "arbeitnow").groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(
        F.count("*").alias("n"))


# Profiles

@query(MATCHES + """, c AS (SELECT doc_id, canonical, count(*) AS n FROM h GROUP BY doc_id, canonical)
    SELECT 'd' || doc_id || '.txt' AS filename, 'text/plain' AS content_type, n_chars, count(canonical) AS n_skills,
      CAST(coalesce(sum(n), 0) AS BIGINT) AS occurrences, 'pending' AS embedding_status
    FROM documents JOIN c USING (doc_id) WHERE length(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 40 GROUP BY ALL""")
def store_profiles(t: Tables) -> DataFrame:
    """Documents uploaded twice, with a dictionary file: profiles and their skills are stored once."""
    folder = shared_folder(t.spark, "dictionary")
    entries = F.array(*[F.struct(F.lit(c).alias("canonical"), F.array(*map(F.lit, a)).alias("aliases")) for c, a in WORDS])
    t.spark.range(1).select(entries.alias("skills")).write.json(folder)
    terms = read_dictionary(t.spark, folder)
    files = t.spread("documents").select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("filename"),
        F.lit("text/plain").alias("content_type"), F.lit(1).alias("size"), F.encode("text", "UTF-8").alias("content"))
    store = fresh_store(t)
    for _ in range(2):
        maintenance.upload(store, files, terms, as_of())
    skills = store.read("cv_skills").groupBy(F.col("cv_id").alias("id")).agg(
        F.count("*").alias("n_skills"), F.sum("occurrences").alias("occurrences"))
    sizes = t.documents.select(F.col("doc_id").cast("string").alias("id"), "n_chars")
    return store.read("cv_profiles").join(skills, "id").join(sizes, "id").select(
        "filename", "content_type", "n_chars", "n_skills", "occurrences", "embedding_status")


# Prompts

@query(f"""WITH p AS ({SQL["prompt_contexts"]}),
      m AS (SELECT p.*, o_orderstatus AS status, row_number() OVER (PARTITION BY prompt_hash ORDER BY o_orderkey) AS nth,
            bool_or(o_orderkey % 50 = 0) OVER (PARTITION BY prompt_hash) AS stored
          FROM p JOIN orders USING (o_orderkey) WHERE reject_reason IS NULL)
    SELECT o_orderkey AS id, nth > 1 OR stored AS cached, CASE WHEN nth > 1 OR stored THEN 0 ELSE length(content) END::INTEGER AS prompt_tokens,
      sha256(CASE WHEN stored THEN 'stored' ELSE 're: ' || content END) AS answer FROM m""")
def prompt_run(t: Tables) -> DataFrame:
    """Orders as prompts against a cache that knows some: usage has tokens for the first of its kind only."""
    from workload.operations import SYSTEM, prompt_tables
    asks, cvs, jobs = prompt_tables(t)
    asked = asks.withColumns({"id": F.col("o_orderkey"), "user_key": F.lit("u"), "created_at": as_of()})
    known = prompts.with_context(asked.where(F.col("id") % 50 == 0), cvs, jobs, SYSTEM).where("reject_reason is null")
    cache = known.select("prompt_hash", F.lit("stored").alias("response_text")).distinct()

    def reply(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"response_text": F.concat(F.lit("re: "), "content"), "prompt_tokens": F.length("content"),
                                 "completion_tokens": F.lit(1), "latency_ms": F.lit(5)})

    out = prompts.run_prompts(asked, cvs, jobs, cache, SYSTEM, reply)
    store = fresh_store(t)
    store.append("chat_usage", out.usage)
    text = out.answers.select(F.col("id").cast("string").alias("id"), F.sha2("response_text", 256).alias("answer"))
    return store.read("chat_usage").join(text, "id").select(F.col("id").cast("bigint").alias("id"), "cached", "prompt_tokens", "answer")


# The embedding queue

TITLE = "left(text, 12)"


def waiting_jobs(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").cast("string").alias("id"), F.sha2(F.col("doc_id").cast("string"), 256).alias("content_hash"),
        F.left("text", F.lit(12)).alias("title"), F.col("lang").alias("company"), F.lit("pending").alias("embedding_status"),
        F.lit(0).alias("embedding_retry_count"))


@query(f"""WITH d AS (SELECT doc_id, {TITLE} AS title, lang, doc_id % 2 AS part FROM documents),
      b AS (SELECT d.*, EXISTS (SELECT 1 FROM d e WHERE e.part = 0 AND d.part = 1 AND e.title IS NOT DISTINCT FROM d.title
            AND e.lang IS NOT DISTINCT FROM d.lang) AS cached FROM d)
    SELECT 'processed' AS name, count(*) AS n FROM b UNION ALL SELECT 'embedded', count(*) FROM b
    UNION ALL SELECT 'cached', count(*) FILTER (cached) FROM b UNION ALL SELECT 'failed', 0
    UNION ALL SELECT 'jobs embedded', count(*) FROM b UNION ALL SELECT 'retries', 0
    UNION ALL SELECT 'cache rows', count(*) FROM (SELECT DISTINCT title, lang FROM b)""")
def stream_drain(t: Tables) -> DataFrame:
    """Documents wait for vectors; notices arrive in two micro-batches, each delivered twice."""
    store = fresh_store(t, jobs=waiting_jobs(t))
    notices = t.documents.select(F.lit("job").alias("kind"), F.col("doc_id").cast("string").alias("id"))
    checkpoint = arriving(t, notices, F.col("id").cast("bigint") % 2 == 1, lambda checkpoint: drain_batches(
        store, lambda: hashed_token_encoder(16), as_of(), checkpoint, 16))
    done = store.read("jobs").agg(F.count_if(F.col("embedding_status") == "embedded").alias("jobs embedded"),
                                  F.sum("embedding_retry_count").alias("retries")).first().asDict()
    return counted(t, totals(store, checkpoint) | done | {"cache rows": store.read("embedding_cache").count()})


@query("""SELECT event_type AS model, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS calls, CAST(sum(event_id) AS BIGINT) AS sum_prompt_tokens,
    avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END) AS cached_rate, max(CAST(floor(value) AS INT)) AS max_latency FROM events GROUP BY 1, 2""")
def stream_usage_once(t: Tables) -> DataFrame:
    """Usage rows arrive in two micro-batches, each delivered twice, and are counted once."""
    store = fresh_store(t)
    usage = t.events.select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_key"),
        F.col("event_type").alias("model"), F.col("event_id").cast("int").alias("prompt_tokens"), F.lit(0).alias("completion_tokens"),
        (F.col("value") < 50).alias("cached"), F.floor("value").cast("int").alias("latency_ms"), F.col("ts").alias("created_at"))
    arriving(t, usage, F.col("prompt_tokens") % 3 == 0, lambda checkpoint: log_batches(store, "chat_usage", checkpoint))
    log = store.read("chat_usage").withColumn("day", F.to_date("created_at").cast("string"))
    out = prompts.usage_rollup(log, ["model", "day"], ["prompt_tokens"], "cached", "latency_ms")
    return out.drop("avg_latency")


# Postings by day

KEYED = f"(SELECT *, sha256({S.norm('text')}) AS k FROM documents)"
DAYS = ["2026-07-01 06:00:00", "2026-07-20 06:00:00", "2026-08-01 06:00:00"]


def sightings(t: Tables) -> DataFrame:
    """Documents as enriched postings keyed by their text; a third of the ids belongs to each of three days."""
    none = {c: F.lit(None).cast(k) for c, k in {
        "remote_allowed": "boolean", "seniority": "string", "salary_min": "bigint", "salary_max": "bigint",
        "salary_currency": "string", "salary_period": "string"}.items()}
    key = text_key(normalize_text(F.col("text")))
    return t.spread("documents").select(
        key.alias("content_hash"), key.alias("id"), F.col("source").alias("title"), F.lit("c").alias("company"),
        F.col("doc_id").cast("string").alias("url"), F.col("lang").alias("location"), F.col("text").alias("description"),
        F.col("n_chars").cast("string").alias("summary"), F.when(F.col("n_chars") > 300, F.timestamp_seconds("doc_id")).alias("posted_at"),
        *[v.alias(c) for c, v in none.items()], F.array("lang").alias("skills"), F.lit("docs").alias("source"),
        F.col("doc_id").cast("string").alias("source_job_id"), F.col("doc_id").alias("arrival"))


def part(rows: DataFrame, n: int) -> DataFrame:
    return rows.where(F.col("arrival") % 3 == n)


def day_store(t: Tables) -> DayStore:
    return DayStore(t.spark, shared_folder(t.spark, "days"))


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


ORDERED = "(doc_id % 3, doc_id)"
JOBS = f"""SELECT k, arg_min(source, {ORDERED}) AS title, arg_max(lang, {ORDERED}) AS location, arg_max(n_chars, {ORDERED})::VARCHAR AS summary,
    arg_max(doc_id, {ORDERED}) FILTER (n_chars > 300) AS posted_s, arg_max(sha256(text), {ORDERED}) AS text_sha,
    arg_min(doc_id, {ORDERED})::VARCHAR AS url, max(doc_id % 3) AS last_part, min(doc_id % 3) AS first_part FROM {KEYED} GROUP BY k"""


def jobs_out(store: DayStore) -> DataFrame:
    return read_jobs(store).select(
        F.col("content_hash").alias("k"), "title", "location", "summary", "url", F.unix_seconds("posted_at").alias("posted_s"),
        F.sha2("description", 256).alias("text_sha"), F.unix_seconds("last_seen_at").alias("seen_s"),
        F.unix_seconds("fetched_at").alias("fetched_s"), "embedding_status")


SECONDS = "CAST(epoch([TIMESTAMP '2026-07-01 06:00:00', TIMESTAMP '2026-07-20 06:00:00', TIMESTAMP '2026-08-01 06:00:00'][{} + 1]) AS BIGINT)"


@query(f"""SELECT k, title, location, summary, url, posted_s, text_sha, {SECONDS.format("last_part")} AS seen_s,
    {SECONDS.format("first_part")} AS fetched_s, 'pending' AS embedding_status FROM ({JOBS})""")
def store_upsert_twice(t: Tables) -> DataFrame:
    """Three days of sightings over existing state, the second one delivered twice."""
    store, rows = day_store(t), sightings(t)
    for n, day in enumerate(DAYS):
        sight(store, part(rows, n), at(day), tag=f"day-{n}")
        if n == 1:
            sight(store, part(rows, n), at(day), tag=f"day-{n}")
    return jobs_out(store)


@query(f"""WITH j AS ({JOBS}), p AS (SELECT unnest([0, 1, 2])::INTEGER AS part),
      texts AS (SELECT DISTINCT k, doc_id % 3 AS part, arg_max(coalesce(sha256(text), '') || '|' || coalesce(n_chars, -1), doc_id) OVER (PARTITION BY k, doc_id % 3) AS sha FROM {KEYED}),
      changed AS (SELECT part, count(*) FILTER (sha IS DISTINCT FROM old) AS n FROM (
        SELECT *, lag(sha) OVER (PARTITION BY k ORDER BY part) AS old FROM texts) GROUP BY part)
    SELECT 'inserted' AS name, part, count(*) FILTER (first_part = part) AS n FROM j, p GROUP BY part
    UNION ALL SELECT 'updated', part, (SELECT count(*) FROM texts t JOIN j USING (k) WHERE t.part = p.part AND first_part < p.part) FROM p
    UNION ALL SELECT 'texts', part::INTEGER, n FROM changed
    UNION ALL SELECT 'links', 3, count(*) FROM j UNION ALL SELECT 'skills', 3, count(location) FROM j""")
def store_sinks(t: Tables) -> DataFrame:
    """What each day's sightings wrote: new rows, repeats, changed texts; links and skills at the end."""
    store, rows, out = day_store(t), sightings(t).withColumn("skills", F.array_compact("skills")), []
    for n, day in enumerate(DAYS):
        out += [(k, n, v) for k, v in sight(store, part(rows, n), at(day)).items()]
    links, skills = read_links(store)
    out += [("links", 3, links.count()), ("skills", 3, skills.count())]
    return t.spark.createDataFrame(out, "name string, part int, n bigint")


@query(f"""SELECT k, title, location, summary, url, posted_s, text_sha, {SECONDS.format("last_part")} AS seen_s,
    {SECONDS.format("first_part")} AS fetched_s, 'embedded' AS embedding_status FROM ({JOBS}) WHERE last_part > 0""")
def store_retention(t: Tables) -> DataFrame:
    """What was last seen on the first day is gone a month later; the rest is whole, vectors included."""
    store, rows = day_store(t), sightings(t)
    for n, day in enumerate(DAYS):
        sight(store, part(rows, n), at(day))
        embed(store, lambda: hashed_token_encoder(8), at(day), 8)
    for late in ("2026-08-01 06:00:00", "2026-08-04 06:00:00"):
        retire(store, at(late), 30)
    return jobs_out(store)


@query(f"""WITH j AS (SELECT k, arg_min(source, {ORDERED}) AS title, min(doc_id % 3) AS first_part FROM {KEYED} GROUP BY k),
      d AS (SELECT k, first_part AS part, title, (SELECT arg_max(lang, doc_id) FROM {KEYED} x WHERE x.k = j.k AND x.doc_id % 3 = j.first_part) AS lang FROM j),
      w AS (SELECT part, title, lang, EXISTS (SELECT 1 FROM d e WHERE e.part < d.part AND e.title IS NOT DISTINCT FROM d.title
            AND e.lang IS NOT DISTINCT FROM d.lang) AS cached FROM d)
    SELECT 'processed' AS name, part::INTEGER AS part, count(*) AS n FROM w GROUP BY part
    UNION ALL SELECT 'embedded', part::INTEGER, count(*) FROM w GROUP BY part
    UNION ALL SELECT 'cached', part::INTEGER, count(*) FILTER (cached) FROM w GROUP BY part
    UNION ALL SELECT 'failed', part::INTEGER, 0 FROM w GROUP BY part""")
def store_drain(t: Tables) -> DataFrame:
    """After each day's sightings only new postings wait; texts known from earlier days come from the cache."""
    store, rows, out = day_store(t), sightings(t), []
    for n, day in enumerate(DAYS):
        sight(store, part(rows, n), at(day))
        out += [(k, n, v) for k, v in embed(store, lambda: hashed_token_encoder(8), at(day), 8).items()]
    return t.spark.createDataFrame(out, "name string, part int, n bigint")

"""Limits, lockouts, spans, prompt cache and usage, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.functions.identity import text_key
from rolemill.functions.text import normalize_text
from rolemill.operators import limits, prompts, spans
from rolemill.plans.session import shared_folder
from rolemill.streaming.ingest import fold_stream, read_folded
from rolemill.streaming.limits import cache_hits_stream, lockout_stream, rate_limit_stream
from workload.changes import FOLD, fold_documents, keyed
from workload.common import SQL, Tables, query

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query("""WITH s AS (SELECT user_id, epoch_us(ts) AS s, max(epoch_us(ts) + CAST(floor(value * 60e6) AS BIGINT)) AS e FROM events
      WHERE floor(value * 60e6) > 0 GROUP BY 1, 2),
    r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
    SELECT user_id, count(*) FILTER (reach IS NULL OR s > reach) AS islands,
      CAST(sum(greatest(e - greatest(s, coalesce(reach, s)), 0)) AS BIGINT) AS covered_us FROM r GROUP BY user_id""")
def span_union(t: Tables) -> DataFrame:
    """Each event covers ``value`` minutes; covered time per user."""
    end = F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 60e6))
    return spans.span_union(t.events.withColumn("until", end), "user_id", "ts", "until")


@query(SQL["span_union"].replace("SELECT user_id, epoch_us(ts)", "SELECT 7 AS user_id, epoch_us(ts)").replace(
    "SELECT user_id, count(*)", "SELECT CAST(user_id AS BIGINT) AS user_id, count(*)"))
def span_union_one_key(t: Tables) -> DataFrame:
    """All events under one key, cut into ranges of their start."""
    end = F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 60e6))
    one = t.events.withColumn("until", end).withColumn("user_id", F.lit(7).cast("bigint"))
    return spans.span_union(one, "user_id", "ts", "until", parts=16)


LOCK = """SELECT user_id, epoch_us(ts) AS us, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW) AS n
    FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'error')"""


def errors(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type") == "error")


@query(f"SELECT user_id, CAST(us AS BIGINT) AS us, n AS failures, n > 2 AS locked FROM ({LOCK})")
def lockout(t: Tables) -> DataFrame:
    """Errors per user: locked above two within a day."""
    return limits.lockout(errors(t), "user_id", "ts", 2, 86_400).select(
        "user_id", F.unix_micros("ts").alias("us"), "failures", "locked")


@query(f"SELECT CAST(user_id AS BIGINT) AS user_id, CAST(us AS BIGINT) AS us, n AS failures, n > 2 AS locked FROM ({LOCK})"
       .replace("DISTINCT user_id, ts FROM", "DISTINCT user_id % 2 AS user_id, ts FROM"))
def lockout_hot(t: Tables) -> DataFrame:
    """All errors under two keys, counted by rank."""
    rows = errors(t).select((F.col("user_id") % 2).alias("user_id"), "ts")
    return limits.lockout(rows, "user_id", "ts", 2, 86_400, hot_rows=1).select(
        "user_id", F.unix_micros("ts").alias("us"), "failures", "locked")


HOUR = 3_600_000_000
RATE = f"""WITH RECURSIVE h AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    w AS (SELECT user_id, us, i, TRUE AS allowed, CAST(2 AS BIGINT) AS remaining, CAST(0 AS BIGINT) AS retry, [us] AS kept FROM h WHERE i = 1
      UNION ALL
      SELECT user_id, us, i, len(live) < 3, CASE WHEN len(live) < 3 THEN 2 - len(live) ELSE 0 END,
        CASE WHEN len(live) < 3 THEN 0 ELSE greatest(1, CAST(ceil((live[1] + {24 * HOUR} - us) / 1e6) AS BIGINT)) END,
        CASE WHEN len(live) < 3 THEN list_append(live, us) ELSE live END
      FROM (SELECT h.user_id, h.us, h.i, list_filter(w.kept, lambda x: x >= h.us - {25 * HOUR}) AS live
            FROM w JOIN h ON h.user_id = w.user_id AND h.i = w.i + 1))"""


@query(RATE + " SELECT user_id, CAST(us AS BIGINT) AS us, allowed, CAST(remaining AS INT) AS remaining, CAST(retry AS BIGINT) AS retry_after_s FROM w")
def rate_limit(t: Tables) -> DataFrame:
    """Events as hits, three per user and day."""
    hits = t.events.select("user_id", "ts", "event_id")
    return limits.rate_limit(hits, "user_id", "ts", limit=3, tie="event_id").select(
        "user_id", F.unix_micros("ts").alias("us"), "allowed", "remaining", "retry_after_s")


HALF = "(SELECT epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 2 FROM events)"


def halves(t: Tables, key) -> tuple[DataFrame, DataFrame]:
    """Hits of the first and the second half of the time covered."""
    hits = t.events.select(key.alias("user_id"), "ts", "event_id")
    ends = hits.agg(F.unix_micros(F.min("ts")).alias("lo"), F.unix_micros(F.max("ts")).alias("hi")).first()
    late = F.unix_micros("ts") >= ends["lo"] + (ends["hi"] - ends["lo"]) // 2
    return hits.where(~late), hits.where(late)


def continued(t: Tables, key, **options) -> DataFrame:
    """Decide the first half, store what was accepted, decide the second half on top of it."""
    first, second = halves(t, key)
    before = limits.rate_limit(first, "user_id", "ts", limit=3, tie="event_id", **options)
    stored = before.where("allowed").select("user_id", "ts")
    return limits.rate_limit(second, "user_id", "ts", limit=3, tie="event_id", stored=stored, **options).select(
        "user_id", F.unix_micros("ts").alias("us"), "allowed", "remaining", "retry_after_s")


DECIDED = "SELECT user_id, CAST(us AS BIGINT) AS us, allowed, CAST(remaining AS INT) AS remaining, CAST(retry AS BIGINT) AS retry_after_s FROM w"


@query(f"{RATE} {DECIDED} WHERE us >= {HALF}")
def rate_limit_stored(t: Tables) -> DataFrame:
    """Hits on top of stored ones: the same decisions as over the whole time."""
    return continued(t, F.col("user_id"))


@query(RATE.replace("SELECT user_id, epoch_us(ts)", "SELECT user_id % 7 AS user_id, epoch_us(ts)").replace(
    "PARTITION BY user_id ORDER", "PARTITION BY user_id % 7 ORDER") + f" {DECIDED} WHERE us >= {HALF}")
def rate_limit_hot(t: Tables) -> DataFrame:
    """Seven busy callers with stored hits, decided from their packed instants."""
    return continued(t, F.col("user_id") % 7, hot_hits=1)


@query(f"""{RATE.replace("FROM events)", "FROM events WHERE event_type <> 'click')")}
    SELECT event_type, allowed, n FROM (
      SELECT 'limited' AS event_type, allowed, count(*) AS n FROM w GROUP BY allowed
      UNION ALL SELECT 'exempt', TRUE, count(*) FROM events WHERE event_type = 'click')""")
def rate_limit_exempt(t: Tables) -> DataFrame:
    """Clicks come from callers without a limit; they pass and use nothing up."""
    hits = t.events.select("user_id", "ts", "event_id", "event_type")
    out = limits.rate_limit(hits, "user_id", "ts", limit=3, tie="event_id", exempt=F.col("event_type") == "click")
    kind = F.when(F.col("event_type") == "click", "exempt").otherwise("limited")
    return out.groupBy(kind.alias("event_type"), "allowed").agg(F.count("*").alias("n"))


def run_once(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    """Drain a stream into the shared folder and read the result."""
    out = shared_folder(t.spark, name)
    q = (stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/cp")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{out}/rows")


def event_stream(t: Tables) -> DataFrame:
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)


@query(RATE + " SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(us AS BIGINT) AS us, allowed, CAST(retry AS BIGINT) AS retry_after_s FROM w")
def rate_limit_as_stream(t: Tables) -> DataFrame:
    out = run_once(t, rate_limit_stream(event_stream(t), "user_id", "ts", limit=3), "rate")
    return out.select(F.col("key").alias("user_id"), F.unix_micros("ts").alias("us"), "allowed", "retry_after_s")


@query(f"SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(us AS BIGINT) AS us, n > 2 AS locked FROM ({LOCK})")
def lockout_as_stream(t: Tables) -> DataFrame:
    failures = event_stream(t).where(F.col("event_type") == "error")
    out = run_once(t, lockout_stream(failures, "user_id", "ts", 2, 86_400), "lock")
    return out.select(F.col("key").alias("user_id"), F.unix_micros("ts").alias("us"), "locked")


@query(RATE + f" SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(us AS BIGINT) AS us, allowed, CAST(retry AS BIGINT) AS retry_after_s FROM w WHERE us >= {HALF}")
def rate_limit_stream_from_store(t: Tables) -> DataFrame:
    """The first half is decided in batch; a stream takes over its accepted hits and decides the second half."""
    first, second = halves(t, F.col("user_id"))
    before = limits.rate_limit(first, "user_id", "ts", limit=3, tie="event_id").where("allowed").select("user_id", "ts")
    folder = shared_folder(t.spark, "late")
    second.select("user_id", "ts").write.parquet(folder)
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    late = t.spark.readStream.schema(t.spark.read.parquet(folder).schema).parquet(folder)
    out = run_once(t, rate_limit_stream(late, "user_id", "ts", limit=3, stored=before, grace_s=90 * 86_400), "rate")
    return out.select(F.col("key").alias("user_id"), F.unix_micros("ts").alias("us"), "allowed", "retry_after_s")


PROMPT = "sha256(event_type || props)"
HITS = f"""SELECT event_id, {PROMPT} AS prompt_hash, epoch_us(ts) AS us, row_number() OVER (PARTITION BY {PROMPT} ORDER BY ts, event_id) > 1 AS cached FROM events"""


def asked(df: DataFrame) -> DataFrame:
    return df.select("event_id", "ts", text_key(F.concat("event_type", "props")).alias("prompt_hash"))


@query(f"SELECT event_id, prompt_hash, cached FROM ({HITS})")
def response_cache(t: Tables) -> DataFrame:
    """Every repeat of a prompt is a hit; a few prompts make up most rows."""
    return prompts.cache_hits(asked(t.events), "prompt_hash", ["ts", "event_id"]).select("event_id", "prompt_hash", "cached")


@query(f"SELECT prompt_hash, CAST(us AS BIGINT) AS us, cached FROM ({HITS})")
def response_cache_as_stream(t: Tables) -> DataFrame:
    out = run_once(t, cache_hits_stream(asked(event_stream(t)), "prompt_hash", "ts"), "cache")
    return out.select(F.col("key").alias("prompt_hash"), F.unix_micros("ts").alias("us"), "cached")


@query(f"""SELECT event_id, CASE WHEN event_type = 'view' THEN 'reply to ' || props END AS response_text FROM events""")
def cached_replies(t: Tables) -> DataFrame:
    """Prompts against a stored cache that knows the view prompts."""
    log = t.events.withColumn("prompt_hash", text_key(F.concat("event_type", "props")))
    cache = log.where(F.col("event_type") == "view").select(
        "prompt_hash", F.concat(F.lit("reply to "), "props").alias("response_text")).distinct()
    return prompts.cached_replies(log.select("event_id", "prompt_hash"), cache).select("event_id", "response_text")


SYSTEM = "Be brief."


@query(f"""SELECT o_orderkey, content, sha256('{SYSTEM}' || chr(31) || o_orderstatus || chr(31) || o_orderpriority || chr(31) ||
      CASE WHEN cv IS NULL THEN '' ELSE cv || '@' || CASE WHEN c_custkey IS NOT NULL THEN '2026-08-20T00:00:00.000Z' ELSE '' END END || chr(31) ||
      CASE WHEN job IS NULL THEN '' ELSE job || '@2026-08-20T00:00:00.000Z' END) AS prompt_hash,
      CASE WHEN cv IS NOT NULL AND c_custkey IS NULL THEN 'cv not found' END AS reject_reason
    FROM (SELECT *, CASE WHEN cvtext IS NULL AND jobtext IS NULL THEN o_orderpriority
        ELSE concat_ws(chr(10), cvtext, jobtext) || chr(10) || chr(10) || 'Question: ' || o_orderpriority END AS content
      FROM (SELECT o.*, c_custkey, cv, job,
          'User CV profile: target role ' || c_mktsegment || '; ' || c_nationkey || ' years experience; skills: ' || c_name || '.' AS cvtext,
          CASE WHEN job IS NOT NULL THEN 'Referenced job: ' || p_name || '.' END AS jobtext
        FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_orderpriority = '5-LOW' THEN 'x' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END END AS cv,
                CASE WHEN o_orderpriority = '1-URGENT' THEN '7' END AS job FROM orders) o
        LEFT JOIN customer ON cv = CAST(c_custkey AS VARCHAR) LEFT JOIN part ON job = CAST(p_partkey AS VARCHAR)))""")
def prompt_contexts(t: Tables) -> DataFrame:
    """Orders as prompts: a third has no profile, some refer to unknown ones, all urgent ones name one posting."""
    asks, cvs, jobs = prompt_tables(t)
    return prompts.with_context(asks, cvs, jobs, SYSTEM).select("o_orderkey", "content", "prompt_hash", "reject_reason")


def prompt_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    at = F.lit("2026-08-20 00:00:00").cast("timestamp")
    low = F.col("o_orderpriority") == "5-LOW"
    asks = t.orders.select(
        "o_orderkey", F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("message"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.when(low, "x").otherwise(""), "o_custkey")).alias("cv_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "7").alias("job_id"))
    cvs = t.customer.select(
        F.col("c_custkey").cast("string").alias("id"), at.alias("updated_at"), F.col("c_mktsegment").alias("target_role"),
        F.col("c_nationkey").cast("float").alias("estimated_years_experience"),
        F.array(F.struct(F.col("c_name").alias("skill"), F.lit(1).alias("occurrences"))).alias("skills"))
    jobs = t.part.select(F.col("p_partkey").cast("string").alias("id"), at.alias("updated_at"), F.col("p_name").alias("summary"))
    return asks, cvs, jobs


USAGE = "CASE WHEN user_id < 10 THEN 'admin' ELSE 'user' END"


@query(f"""SELECT {USAGE} AS tier, event_type AS model, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS calls, CAST(sum(event_id) AS BIGINT) AS sum_event_id,
    avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END) AS cached_rate, floor(avg(value) * 1e6 + 0.5) / 1e6 AS avg_latency, max(value) AS max_latency
    FROM events GROUP BY 1, 2, 3""")
def usage_rollup(t: Tables) -> DataFrame:
    log = t.events.select(F.when(F.col("user_id") < 10, "admin").otherwise("user").alias("tier"), F.col("event_type").alias("model"),
                          F.to_date("ts").cast("string").alias("day"), "event_id", "value", (F.col("value") < 50).alias("cached"))
    out = prompts.usage_rollup(log, ["tier", "model", "day"], ["event_id"], "cached", "value")
    return out.withColumn("avg_latency", F.floor(F.col("avg_latency") * 1e6 + 0.5) / 1e6)


@query(f"""WITH v AS (SELECT {USAGE} AS tier, event_type AS model, date_trunc('week', ts)::DATE::VARCHAR AS week, value FROM events)
    SELECT tier, model, week, count(*) AS calls, TRUE AS median_near, TRUE AS tail_near FROM v GROUP BY 1, 2, 3""")
def usage_percentiles(t: Tables) -> DataFrame:
    """Percentiles over a week from daily sketches lie within the sketch's error of the true ranks."""
    log = t.events.select(F.when(F.col("user_id") < 10, "admin").otherwise("user").alias("tier"), F.col("event_type").alias("model"),
                          F.to_date("ts").alias("day"), "value")
    week = F.to_date(F.date_trunc("week", "day")).cast("string")
    daily = prompts.latency_sketches(log, ["tier", "model", "day"], "value").withColumn("week", week)
    over = prompts.latency_over(daily, ["tier", "model", "week"], [0.5, 0.95])

    def near(share: float, value: str):
        # Ranks of the values equal to the answer reach from the share below it to the share up to it.
        below, upto = F.avg((F.col("value") < F.col(value)).cast("double")), F.avg((F.col("value") <= F.col(value)).cast("double"))
        return (below <= share + 0.02) & (upto >= share - 0.02)

    return (log.withColumn("week", week).join(over, ["tier", "model", "week"]).groupBy("tier", "model", "week")
            .agg(F.count("*").alias("calls"), near(0.5, "p50").alias("median_near"), near(0.95, "p95").alias("tail_near")))


@query("""SELECT event_id, user_id, event_type FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT 100) WHERE event_type = 'click'""")
def usage_oldest(t: Tables) -> DataFrame:
    """The oldest hundred entries, then only one caller's among them."""
    return prompts.usage_log(t.events, "click", order=("ts", "event_id"), user_column="event_type").select("event_id", "user_id", "event_type")


@query(FOLD)
def stream_fold(t: Tables) -> DataFrame:
    """Documents as a stream of two micro-batches, folded by content key; equals the batch fold."""
    from rolemill.operators.upsert import upsert
    docs = t.documents
    half = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    source, table, checkpoint = (shared_folder(t.spark, n) for n in ("docs", "fold", "checkpoint"))
    schema = fold_documents(keyed(t)).schema

    def merge(before, batch):
        return upsert(before, fold_documents(batch), ["k"], insert_only=["first_source", "first_doc"],
                      replace=["last_lang", "last_doc"], replace_if_given=["seen"])

    for part in (docs.where(F.col("doc_id") < half), docs.where(F.col("doc_id") >= half)):
        part.write.mode("append").parquet(source)
        stream = t.spark.readStream.schema(docs.schema).parquet(source).select(
            "doc_id", "source", "lang", text_key(normalize_text(F.col("text"))).alias("k"),
            F.when(F.col("n_chars") > 300, F.col("doc_id")).alias("seen"))
        fold_stream(stream, table, ["k"], schema, merge, checkpoint).awaitTermination()
    return read_folded(t.spark, table, ["k"], schema)

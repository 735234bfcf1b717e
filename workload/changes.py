"""Table changes: folds, upserts, insert-ignore, sets, retention, boards, run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.functions.identity import text_key
from rolemill.functions.text import normalize_text
from rolemill.operators import admin
from rolemill.operators.upsert import delete_with_children, fold, insert_ignore, replace_sets, upsert
from rolemill.plans.ingest import with_headquarters
from rolemill.sources import boards
from workload import sql as S
from workload.common import Tables, query

KEYED = f"(SELECT *, sha256({S.norm('text')}) AS k FROM documents)"


def keyed(t: Tables) -> DataFrame:
    """Documents keyed by their normalized text; ``seen`` is null for short ones."""
    return t.spread("documents").select(
        "doc_id", "source", "lang", text_key(normalize_text(F.col("text"))).alias("k"),
        F.when(F.col("n_chars") > 300, F.col("doc_id")).alias("seen"))


def fold_documents(df: DataFrame) -> DataFrame:
    renamed = df.select("k", "doc_id", "seen", F.col("source").alias("first_source"), F.col("doc_id").alias("first_doc"),
                        F.col("lang").alias("last_lang"), F.col("doc_id").alias("last_doc"))
    return fold(renamed, ["k"], first=["first_source", "first_doc"], last=["last_lang", "last_doc"],
                last_non_null=["seen"], order="doc_id")


FOLD = f"""SELECT k, arg_min(source, doc_id) AS first_source, min(doc_id) AS first_doc, arg_max(lang, doc_id) AS last_lang,
    max(doc_id) AS last_doc, max(CASE WHEN n_chars > 300 THEN doc_id END) AS seen FROM {KEYED} GROUP BY k"""


@query(FOLD)
def dedupe_fold(t: Tables) -> DataFrame:
    return fold_documents(keyed(t))


@query(FOLD.replace("min(doc_id) AS first_doc", "arg_min(doc_id, (source >= 'src5', doc_id)) AS first_doc")
       .replace("arg_min(source, doc_id)", "arg_min(source, (source >= 'src5', doc_id))")
       .replace("arg_max(lang, doc_id)", "arg_max(lang, (source >= 'src5', doc_id))")
       .replace("max(doc_id) AS last_doc", "arg_max(doc_id, (source >= 'src5', doc_id)) AS last_doc")
       .replace("max(CASE WHEN n_chars > 300 THEN doc_id END) AS seen",
                "arg_max(doc_id, (source >= 'src5', doc_id)) FILTER (n_chars > 300) AS seen"))
def upsert_two_batches(t: Tables) -> DataFrame:
    """Feeds below ``src5`` arrive first, the others later; the second batch meets the stored rows."""
    docs = keyed(t)
    state = fold_documents(docs.where(F.col("source") < "src5"))
    batch = fold_documents(docs.where(F.col("source") >= "src5"))
    return upsert(state, batch, ["k"], insert_only=["first_source", "first_doc"],
                  replace=["last_lang", "last_doc"], replace_if_given=["seen"])


@query(f"""WITH b AS (SELECT sha256({S.norm('text')}) AS k, min(item_id) AS ref FROM benchmark GROUP BY 1),
    d AS (SELECT k, min(doc_id) AS ref FROM {KEYED} GROUP BY k)
    SELECT k, ref, 'benchmark' AS origin FROM b UNION ALL SELECT k, ref, 'documents' FROM d WHERE k NOT IN (SELECT k FROM b)""")
def insert_new_only(t: Tables) -> DataFrame:
    """Benchmark items are stored; documents are inserted unless their text is there."""
    none = t.spark.createDataFrame([], "k string, ref bigint, origin string")
    items = t.benchmark.select(text_key(normalize_text(F.col("text"))).alias("k"), F.col("item_id").alias("ref"),
                               F.lit("benchmark").alias("origin"))
    docs = keyed(t).select("k", F.col("doc_id").alias("ref"), F.lit("documents").alias("origin"))
    return insert_ignore(insert_ignore(none, items, ["k"], "ref"), docs, ["k"], "ref")


@query("""WITH n AS (SELECT l_orderkey, l_shipmode FROM (SELECT l_orderkey, l_linestatus AS l_shipmode, l_shipdate FROM lineitem)
      WHERE l_shipdate >= DATE '1998-01-01' GROUP BY ALL)
    SELECT DISTINCT l_orderkey AS id, l_returnflag AS v FROM lineitem
      WHERE l_shipdate < DATE '1998-01-01' AND l_orderkey NOT IN (SELECT l_orderkey FROM n)
    UNION ALL SELECT l_orderkey, l_shipmode FROM n""")
def replace_link_sets(t: Tables) -> DataFrame:
    """Flags of early lines are stored; orders with later lines get their set replaced."""
    line = t.lineitem
    cut = F.lit("1998-01-01").cast("timestamp")
    state = line.where(F.col("l_shipdate") < cut).select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("v")).distinct()
    batch = (line.where(F.col("l_shipdate") >= cut).groupBy(F.col("l_orderkey").alias("id"))
             .agg(F.collect_set("l_linestatus").alias("vs")).withColumn("arrival", F.lit(1)))
    return replace_sets(state, batch, "id", "v", "vs")


@query("""SELECT 'orders' AS part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderdate >= DATE '1998-06-01'
    UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem
      WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < DATE '1998-06-01')""")
def retention_cascade(t: Tables) -> DataFrame:
    """Old orders leave with their lines."""
    out = delete_with_children(t.orders, F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp"), "o_orderkey",
                               {"lineitem": (t.lineitem, "l_orderkey")})
    return out["parent"].agg(F.lit("orders").alias("part"), F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).unionByName(
        out["lineitem"].agg(F.lit("lineitem").alias("part"), F.count("*").alias("n"), F.sum("l_orderkey").alias("keys")))


@query("""SELECT p_partkey, CASE WHEN hq IS NULL THEN loc WHEN loc IS NULL OR loc = '' THEN hq
      WHEN lower(loc) IN ('remote', 'hybrid', 'onsite') THEN loc || ' · ' || hq ELSE loc END AS location
    FROM (SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'Remote' WHEN 'LARGE' THEN 'HYBRID' WHEN 'SMALL' THEN '' WHEN 'MEDIUM' THEN NULL
      ELSE p_type END AS loc, CASE WHEN p_size > 20 THEN p_brand END AS hq FROM part)""")
def headquarters_location(t: Tables) -> DataFrame:
    kind = F.col("p_type")
    loc = (F.when(kind == "PROMO", "Remote").when(kind == "LARGE", "HYBRID").when(kind == "SMALL", "")
           .when(kind != "MEDIUM", kind))
    return t.part.select("p_partkey", with_headquarters(loc, F.when(F.col("p_size") > 20, F.col("p_brand"))).alias("location"))


def board_requests(t: Tables) -> DataFrame:
    """Registry requests from customers: names padded, some slugs empty, some types unknown."""
    seg = F.col("c_mktsegment")
    return t.customer.select(
        F.concat(F.lit("  N"), "c_nationkey", F.lit(" ")).alias("name"),
        F.when(seg == "BUILDING", "greenhouse").when(seg == "FURNITURE", "lever").when(seg == "MACHINERY", "ashby").otherwise("other").alias("ats_type"),
        F.when(F.col("c_acctbal") < 0, "  ").otherwise(F.col("c_name")).alias("board_slug"),
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit(" "), "c_name")).otherwise("").alias("hq_location"),
        F.when(F.col("c_acctbal") > 8000, F.lit(False)).alias("enabled"), F.col("c_custkey").alias("arrival"))


REASON = """CASE WHEN c_acctbal < 0 THEN 'invalid board slug' WHEN c_mktsegment NOT IN ('BUILDING', 'FURNITURE', 'MACHINERY')
    THEN 'invalid board type' END"""


@query(f"SELECT c_custkey AS arrival, {REASON} AS reject_reason FROM customer")
def board_checks(t: Tables) -> DataFrame:
    return boards.check_boards(board_requests(t)).select("arrival", "reject_reason")


@query(f"""SELECT 'N' || c_nationkey AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'greenhouse' WHEN 'FURNITURE' THEN 'lever' ELSE 'ashby' END AS ats_type,
    arg_max(c_name, c_custkey) AS board_slug, arg_max(CASE WHEN c_acctbal > 5000 THEN c_name ELSE '' END, c_custkey) AS hq,
    arg_max(c_acctbal <= 8000, c_custkey) AND c_mktsegment <> 'FURNITURE' AS enabled
    FROM customer WHERE {REASON} IS NULL GROUP BY c_nationkey, c_mktsegment""")
def board_upserts(t: Tables) -> DataFrame:
    """Valid requests upserted by (name, type), then all boards of one type disabled by id."""
    from rolemill import schemas
    as_of = F.lit("2026-08-20 00:00:00").cast("timestamp")
    good = boards.check_boards(board_requests(t)).where(F.col("reject_reason").isNull()).drop("reject_reason")
    now = boards.upsert_boards(t.spark.createDataFrame([], schemas.COMPANIES), good, as_of)
    import hashlib
    off = [hashlib.sha256(f"N{i}|lever".encode()).hexdigest() for i in range(25)]
    return boards.disable_boards(now, off, as_of).select(
        "name", "ats_type", "board_slug", F.coalesce("hq_location", F.lit("")).alias("hq"), "enabled")


@query("""SELECT n_name AS name, count(o_orderkey) AS job_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0
    LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name""")
def boards_with_counts(t: Tables) -> DataFrame:
    """Nations as boards; orders of their customers in credit as postings; nations without any are kept."""
    companies = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("lever").alias("ats_type"),
                                F.col("n_nationkey").cast("string").alias("board_slug"), F.lit(None).cast("timestamp").alias("updated_at"))
    rich = t.customer.where(F.col("c_acctbal") > 0)
    links = t.orders.join(rich, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("job_id"), F.concat(F.lit("lever:"), "c_nationkey").alias("source"))
    return boards.boards_with_counts(companies, links, t.orders.select(F.col("o_orderkey").alias("id"))).select("name", "job_count")


@query("""WITH r AS (SELECT user_id, max(event_id) AS last_id FROM events WHERE event_type <> 'view' GROUP BY user_id)
    SELECT CAST(e.user_id AS VARCHAR) AS name, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS last_status,
      CASE WHEN event_type = 'error' THEN props END AS last_error, event_id AS jobs_fetched
    FROM events e JOIN r ON e.event_id = r.last_id
    UNION ALL SELECT CAST(user_id AS VARCHAR), 'ok', NULL, max(event_id) FROM events WHERE user_id NOT IN (SELECT user_id FROM r) GROUP BY user_id""")
def run_log_upsert(t: Tables) -> DataFrame:
    """View events give the stored log, all other events the newer runs."""
    def runs(df: DataFrame) -> DataFrame:
        return fold(df.select(
            F.col("user_id").cast("string").alias("name"), F.col("ts").alias("last_run_at"),
            F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("last_status"),
            F.when(F.col("event_type") == "error", F.col("props")).alias("last_error"),
            F.col("event_id").alias("jobs_fetched"), F.lit(0).alias("embedding_pending_count"), "event_id"),
            ["name"], last=admin.RUN_COLUMNS, order="event_id")

    events = t.events
    log = admin.record_run(runs(events.where("event_type = 'view'")), runs(events.where("event_type <> 'view'")))
    return admin.source_health(log).select("name", "last_status", "last_error", "jobs_fetched")


@query("""SELECT event_type AS name, left(string_agg(u || ': ' || props, '; ' ORDER BY u, props), 1000) AS last_error
    FROM (SELECT event_type, CAST(user_id AS VARCHAR) AS u, props FROM events) GROUP BY event_type""")
def error_rollup(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("u"), "props")
    return admin.roll_up_errors(rows, "name", "u", "props")


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS embedded, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders""")
def stats_filtered(t: Tables) -> DataFrame:
    return admin.status_counts(t.orders, "o_orderstatus", {"embedded": "O", "pending": "P"})


@query("""SELECT CAST((SELECT count(*) FROM orders WHERE o_orderstatus = 'F') + (SELECT count(*) FROM lineitem WHERE l_linestatus = 'F') AS BIGINT) AS pending""")
def pending_over_tables(t: Tables) -> DataFrame:
    return admin.pending_total([t.orders.withColumnRenamed("o_orderstatus", "s"), t.lineitem.withColumnRenamed("l_linestatus", "s")], "s", "F")


@query(f"""SELECT k, first_doc, last_doc, CAST(row_number() OVER (ORDER BY last_doc DESC, k DESC) AS INT) AS position
    FROM ({FOLD}) ORDER BY last_doc DESC, k DESC LIMIT 100""")
def deduplicated_page(t: Tables) -> DataFrame:
    """Documents as postings: content key, duplicates folded, first page by last sighting."""
    from rolemill.operators.search import page
    folded = fold_documents(keyed(t))
    return page(folded, "last_doc", "k", 100).select("k", "first_doc", "last_doc", "position")

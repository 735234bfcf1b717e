"""Feeds: payloads derived from the tables, scanned and normalized.

Records are packed into JSON pages of about a hundred, as an API would deliver
them, then go through the same scan as landed files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.plans.ingest import enrich, scan_feed, upsert_jobs
from rolemill import schemas
from rolemill.sources.adapters import split_rejects, union_all
from workload import sql as S
from workload.common import Tables, query

PAGE = 100


def pages(rows: DataFrame, record: Column, by: Column, envelope: str | None, board: Column | None = None,
          country: Column | None = None) -> DataFrame:
    """Payload rows: one JSON page per group of ``by`` (at most a page of records each)."""
    none = F.lit(None).cast("string")
    keyed = rows.select(F.floor(by / PAGE).alias("page"), (board if board is not None else none).alias("board"),
                        (country if country is not None else none).alias("country"), record.alias("r"))
    packed = keyed.groupBy("page", "board", "country").agg(F.collect_list("r").alias("rs"))
    payload = F.to_json(F.struct(F.col("rs").alias(envelope))) if envelope else F.to_json("rs")
    return packed.select(payload.alias("payload"), "board", "country",
                         F.concat_ws("/", "board", "country", "page").alias("file"),
                         F.lit("2026-08-01 00:00:00").cast("timestamp").alias("arrived_at"))


def flat(df: DataFrame) -> DataFrame:
    return df.select(
        "source", "source_job_id", "title", "company", "location", "remote_allowed", "seniority", "salary_min",
        "salary_max", "salary_currency", "salary_period", "description", "url",
        F.array_join("skills", ",").alias("skills"), F.unix_millis("posted_at").alias("posted_ms"),
        "reject_reason")


OUT = ("source, source_job_id, title, company, location, remote_allowed, seniority, salary_min, salary_max, "
       "salary_currency, salary_period, description, url, skills, posted_ms, reject_reason")


def arbeitnow_pages(t: Tables) -> DataFrame:
    st, price = F.col("o_orderstatus"), F.col("o_totalprice")
    secs = F.unix_seconds("o_orderdate")
    record = F.struct(
        F.col("o_orderkey").alias("id"),
        F.concat("o_orderpriority", F.when(st == "O", " Senior Engineer").when(st == "F", " Staff Manager")
                 .otherwise(" Graduate Lead")).alias("title"),
        F.concat(F.lit("Customer "), "o_custkey").alias("company_name"),
        F.when(st != "F", st).alias("company_slug"), F.concat(F.lit("s"), "o_orderkey").alias("slug"),
        F.when(st == "O", F.concat(F.lit("http://x/"), "o_orderkey")).alias("url"),
        F.col("o_orderpriority").alias("location"), F.when(st != "P", st == "O").alias("remote"),
        F.concat(F.lit("<p>"), "o_orderpriority", F.lit("&nbsp;&amp;lt;"), "o_orderkey", F.lit("</p>")).alias("description"),
        F.array(st, "o_orderpriority").alias("tags"),
        F.when(st == "O", secs.cast("string")).when(st == "F", ((secs + 1_000_000_000) * 1000).cast("string"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("created_at"),
        F.concat(F.lit("$"), F.floor(price / 1000), F.lit("k - $"), F.floor(price / 500), F.lit("k")).alias("salary"))
    return pages(t.orders, record, F.col("o_orderkey"), "data")


ARBEITNOW = S.salary("""(SELECT 'arbeitnow' AS source, CAST(o_orderkey AS VARCHAR) AS source_job_id, title,
    'Customer ' || o_custkey AS company, o_orderpriority AS location,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'O' END AS remote_allowed, """ + S.seniority("title") + """ AS seniority,
    o_orderpriority || ' <' || o_orderkey AS description,
    CASE o_orderstatus WHEN 'O' THEN 'http://x/' || o_orderkey
      WHEN 'P' THEN 'https://www.arbeitnow.com/jobs/P/s' || o_orderkey ELSE 'https://www.arbeitnow.com' END AS url,
    lower(o_orderstatus || ',' || o_orderpriority) AS skills,
    CAST(epoch_ms(o_orderdate) + CASE WHEN o_orderstatus = 'F' THEN 1000000000000 ELSE 0 END AS BIGINT) AS posted_ms,
    CAST(NULL AS VARCHAR) AS reject_reason,
    '$' || CAST(floor(o_totalprice / 1000) AS BIGINT) || 'k - $' || CAST(floor(o_totalprice / 500) AS BIGINT) || 'k' AS txt
  FROM (SELECT *, o_orderpriority || CASE o_orderstatus WHEN 'O' THEN ' Senior Engineer' WHEN 'F' THEN ' Staff Manager'
        ELSE ' Graduate Lead' END AS title FROM orders))""", "txt",
    "source, source_job_id, title, company, location, remote_allowed, seniority, description, url, skills, posted_ms, reject_reason")


@query(ARBEITNOW)
def scan_arbeitnow(t: Tables) -> DataFrame:
    return flat(scan_feed(arbeitnow_pages(t), "arbeitnow"))


def remotive_pages(t: Tables) -> DataFrame:
    bal = F.col("c_acctbal")
    record = F.struct(
        F.col("c_custkey").cast("string").alias("id"), F.concat("c_mktsegment", F.lit(" Sr. Analyst")).alias("title"),
        F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("category"),
        F.when(bal > 0, F.array(F.lit("Remote"), F.lit("B2B"))).alias("tags"),
        F.date_format(F.timestamp_seconds(F.lit(1.7e9) + F.col("c_custkey") * 60), "yyyy-MM-dd'T'HH:mm:ss").alias("publication_date"),
        F.when(bal > 1000, F.lit("Europe")).alias("candidate_required_location"),
        F.concat(F.floor(F.abs(bal)).cast("string"), F.lit(" EUR per month")).alias("salary"))
    return pages(t.customer, record, F.col("c_custkey"), "jobs")


REMOTIVE = S.salary("""(SELECT 'remotive' AS source, CAST(c_custkey AS VARCHAR) AS source_job_id,
    c_mktsegment || ' Sr. Analyst' AS title, c_name AS company, CASE WHEN c_acctbal > 1000 THEN 'Europe' END AS location,
    TRUE AS remote_allowed, 'senior' AS seniority, CAST(NULL AS VARCHAR) AS description,
    'https://remotive.com/remote-jobs' AS url,
    CASE WHEN c_acctbal > 0 THEN 'remote,b2b,' ELSE '' END || lower(c_mktsegment) AS skills,
    CAST((1700000000 + c_custkey * 60) * 1000 AS BIGINT) AS posted_ms, CAST(NULL AS VARCHAR) AS reject_reason,
    CAST(floor(abs(c_acctbal)) AS BIGINT) || ' EUR per month' AS txt FROM customer)""", "txt",
    "source, source_job_id, title, company, location, remote_allowed, seniority, description, url, skills, posted_ms, reject_reason")


@query(REMOTIVE)
def scan_remotive(t: Tables) -> DataFrame:
    return flat(scan_feed(remotive_pages(t), "remotive"))


def remoteok_pages(t: Tables) -> DataFrame:
    size = F.col("p_size")
    record = F.struct(
        F.col("p_name").alias("slug"), F.when(size > 10, F.col("p_partkey")).alias("id"),
        F.when(size > 20, F.lit(1_600_000_000) + F.col("p_partkey")).alias("epoch"),
        F.lit("2020-01-02T03:04:05+00:00").alias("date"),
        F.when(F.col("p_type") != "PROMO", F.col("p_brand")).alias("company"), F.col("p_name").alias("position"),
        F.array("p_type").alias("tags"), F.col("p_retailprice").alias("salary_min"),
        F.when(size > 5, F.col("p_retailprice") * 2).alias("salary_max"))
    return pages(t.part, record, F.col("p_partkey"), None)


REMOTEOK = f"""SELECT 'remoteok' AS source, CASE WHEN p_size > 10 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END AS source_job_id,
    p_name AS title, p_brand AS company, CAST(NULL AS VARCHAR) AS location, TRUE AS remote_allowed,
    {S.seniority('p_name')} AS seniority,
    CASE WHEN p_size > 5 THEN CAST(floor(p_retailprice + 0.5) AS BIGINT) END AS salary_min,
    CASE WHEN p_size > 5 THEN CAST(floor(p_retailprice * 2 + 0.5) AS BIGINT) END AS salary_max,
    CAST(NULL AS VARCHAR) AS salary_currency, CASE WHEN p_size > 5 THEN 'yearly' END AS salary_period,
    CAST(NULL AS VARCHAR) AS description, 'https://remoteok.com/remote-jobs/' || p_name AS url, lower(p_type) AS skills,
    CASE WHEN p_size > 20 THEN CAST((1600000000 + p_partkey) * 1000 AS BIGINT) ELSE CAST(1577934245000 AS BIGINT) END AS posted_ms,
    CAST(NULL AS VARCHAR) AS reject_reason FROM part WHERE p_type <> 'PROMO'"""


@query(REMOTEOK)
def scan_remoteok(t: Tables) -> DataFrame:
    return flat(scan_feed(remoteok_pages(t), "remoteok"))


def adzuna_pages(t: Tables) -> DataFrame:
    nation = F.col("s_nationkey")
    country = F.when(nation < 8, "Australia").when(nation < 16, "Singapore").otherwise("Elsewhere")
    record = F.struct(
        F.col("s_suppkey").alias("id"),
        F.concat("s_name", F.when(nation < 5, " (Remote)").otherwise("")).alias("title"),
        F.concat(F.lit("http://a/"), "s_suppkey").alias("redirect_url"),
        F.struct(F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("display_name")).alias("company"),
        F.struct(F.lit("somewhere").alias("display_name"),
                 F.when(nation < 12, F.array(country, F.lit("State"), F.lit("City"))).otherwise(F.array(country)).alias("area")
                 ).alias("location"),
        F.when(F.col("s_acctbal") > 500, F.floor("s_acctbal").cast("double")).alias("salary_min"))
    return pages(t.supplier, record, F.col("s_suppkey"), "results",
                 country=F.when(nation < 8, "au").otherwise("sg"))


ADZUNA = f"""SELECT 'adzuna' AS source, CASE WHEN s_nationkey < 8 THEN 'au' ELSE 'sg' END || ':' || s_suppkey AS source_job_id,
    title, CASE WHEN s_acctbal > 0 THEN s_name ELSE 'Confidential Employer' END AS company,
    CASE WHEN s_nationkey < 12 THEN 'City, ' || country ELSE 'somewhere' END AS location,
    CASE WHEN s_nationkey < 5 THEN TRUE END AS remote_allowed, {S.seniority('title')} AS seniority,
    CASE WHEN s_acctbal > 500 THEN CAST(floor(s_acctbal) AS BIGINT) END AS salary_min, CAST(NULL AS BIGINT) AS salary_max,
    CASE WHEN s_acctbal > 500 THEN CASE country WHEN 'Australia' THEN 'AUD' WHEN 'Singapore' THEN 'SGD' END END AS salary_currency,
    CASE WHEN s_acctbal > 500 THEN 'yearly' END AS salary_period, CAST(NULL AS VARCHAR) AS description,
    'http://a/' || s_suppkey AS url, '' AS skills, CAST(NULL AS BIGINT) AS posted_ms, CAST(NULL AS VARCHAR) AS reject_reason
  FROM (SELECT *, s_name || CASE WHEN s_nationkey < 5 THEN ' (Remote)' ELSE '' END AS title,
        CASE WHEN s_nationkey < 8 THEN 'Australia' WHEN s_nationkey < 16 THEN 'Singapore' ELSE 'Elsewhere' END AS country
        FROM supplier)"""


@query(ADZUNA)
def scan_adzuna(t: Tables) -> DataFrame:
    return flat(scan_feed(adzuna_pages(t), "adzuna"))


def registry(t: Tables, kind: str) -> DataFrame:
    """Board registry from the nation table; every third region is disabled."""
    return t.nation.select(
        F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("Board of "), "n_name").alias("name"),
        F.lit(kind).alias("ats_type"), F.col("n_name").alias("board_slug"),
        F.when(F.col("n_regionkey") > 1, F.concat(F.lit("HQ "), "n_name")).alias("hq_location"),
        (F.col("n_regionkey") != 4).alias("enabled"))


def greenhouse_pages(t: Tables) -> DataFrame:
    seg = F.col("c_mktsegment")
    record = F.struct(
        F.col("c_custkey").alias("id"), F.concat(seg, F.lit(" Head of Data")).alias("title"),
        F.when(seg == "BUILDING", F.col("c_name")).alias("company_name"),
        F.struct(F.when(seg == "FURNITURE", "Remote - EU").when(seg == "MACHINERY", "Hybrid").alias("name")).alias("location"),
        F.lit("2026-01-02T00:00:00Z").alias("updated_at"))
    return pages(t.customer, record, F.col("c_custkey"), "jobs", board=F.concat(F.lit("NATION_"), "c_nationkey"))


GREENHOUSE = """SELECT 'greenhouse:' || n_name AS source, CAST(c_custkey AS VARCHAR) AS source_job_id,
    c_mktsegment || ' Head of Data' AS title, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE 'Board of ' || n_name END AS company,
    CASE c_mktsegment WHEN 'FURNITURE' THEN 'Remote - EU' WHEN 'MACHINERY' THEN 'Hybrid' END AS location,
    CASE c_mktsegment WHEN 'FURNITURE' THEN TRUE WHEN 'MACHINERY' THEN FALSE END AS remote_allowed, 'manager' AS seniority,
    CAST(NULL AS BIGINT) AS salary_min, CAST(NULL AS BIGINT) AS salary_max, CAST(NULL AS VARCHAR) AS salary_currency,
    CAST(NULL AS VARCHAR) AS salary_period, CAST(NULL AS VARCHAR) AS description,
    'https://job-boards.greenhouse.io/' || c_custkey AS url, '' AS skills, CAST(1767312000000 AS BIGINT) AS posted_ms,
    CAST(NULL AS VARCHAR) AS reject_reason
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 4"""


def scan_board(t: Tables, feed: str, payloads: DataFrame) -> DataFrame:
    return flat(scan_feed(payloads, feed, registry(t, feed)))


@query(GREENHOUSE)
def scan_greenhouse(t: Tables) -> DataFrame:
    return scan_board(t, "greenhouse", greenhouse_pages(t))


def lever_pages(t: Tables) -> DataFrame:
    record = F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("text"),
        F.unix_millis("o_orderdate").alias("createdAt"),
        F.struct(F.when(F.col("o_orderstatus") == "O", "Fully remote").alias("location")).alias("categories"),
        F.col("o_orderstatus").alias("descriptionPlain"))
    slug = F.when(F.col("o_orderpriority") == "1-URGENT", "NATION_1").when(
        F.col("o_orderpriority") == "2-HIGH", "NATION_2").otherwise("NATION_3")
    return pages(t.orders, record, F.col("o_orderkey"), None, board=slug)


LEVER = """SELECT 'lever:' || n_name AS source, CAST(o_orderkey AS VARCHAR) AS source_job_id, o_orderpriority AS title,
    'Board of ' || n_name AS company, CASE WHEN o_orderstatus = 'O' THEN 'Fully remote' END AS location,
    CASE WHEN o_orderstatus = 'O' THEN TRUE END AS remote_allowed, 'mid' AS seniority,
    CAST(NULL AS BIGINT) AS salary_min, CAST(NULL AS BIGINT) AS salary_max, CAST(NULL AS VARCHAR) AS salary_currency,
    CAST(NULL AS VARCHAR) AS salary_period, o_orderstatus AS description, 'https://jobs.lever.co/' || o_orderkey AS url,
    '' AS skills, CAST(epoch_ms(o_orderdate) AS BIGINT) AS posted_ms, CAST(NULL AS VARCHAR) AS reject_reason
  FROM orders JOIN nation ON n_name = CASE o_orderpriority WHEN '1-URGENT' THEN 'NATION_1' WHEN '2-HIGH' THEN 'NATION_2' ELSE 'NATION_3' END
  WHERE n_regionkey <> 4"""


@query(LEVER)
def scan_lever(t: Tables) -> DataFrame:
    return scan_board(t, "lever", lever_pages(t))


def ashby_pages(t: Tables) -> DataFrame:
    seg = F.col("c_mktsegment")
    record = F.struct(
        F.col("c_name").alias("id"), F.concat(F.lit("Chief "), seg).alias("title"),
        F.when(seg == "BUILDING", F.col("c_name")).alias("company"),
        F.when(seg != "HOUSEHOLD", F.concat(seg, F.lit(" / REMOTE"))).alias("location"),
        F.when(seg == "FURNITURE", F.lit(False)).alias("isRemote"),
        F.when(seg == "MACHINERY", F.lit("http://apply")).alias("applyUrl"),
        F.when(F.col("c_acctbal") > 0, "2026-03-04T05:06:07.000+02:00").otherwise("not a date").alias("publishedAt"))
    return pages(t.customer, record, F.col("c_custkey"), "jobs", board=F.concat(F.lit("NATION_"), "c_nationkey"))


ASHBY = """SELECT 'ashby:' || n_name AS source, c_name AS source_job_id, 'Chief ' || c_mktsegment AS title,
    CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE 'Board of ' || n_name END AS company,
    CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment || ' / REMOTE' END AS location,
    CASE c_mktsegment WHEN 'FURNITURE' THEN FALSE WHEN 'HOUSEHOLD' THEN NULL ELSE TRUE END AS remote_allowed, 'director+' AS seniority,
    CAST(NULL AS BIGINT) AS salary_min, CAST(NULL AS BIGINT) AS salary_max, CAST(NULL AS VARCHAR) AS salary_currency,
    CAST(NULL AS VARCHAR) AS salary_period, CAST(NULL AS VARCHAR) AS description,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'http://apply' ELSE 'https://jobs.ashbyhq.com/' || c_name END AS url, '' AS skills,
    CASE WHEN c_acctbal > 0 THEN CAST(1772593567000 AS BIGINT) END AS posted_ms, CAST(NULL AS VARCHAR) AS reject_reason
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 4"""


@query(ASHBY)
def scan_ashby(t: Tables) -> DataFrame:
    return scan_board(t, "ashby", ashby_pages(t))


def all_feeds(t: Tables) -> DataFrame:
    plain = {"arbeitnow": arbeitnow_pages, "remotive": remotive_pages, "remoteok": remoteok_pages, "adzuna": adzuna_pages}
    boards = {"greenhouse": greenhouse_pages, "lever": lever_pages, "ashby": ashby_pages}
    return union_all([
        *[scan_feed(make(t), feed) for feed, make in plain.items()],
        *[scan_feed(make(t), feed, registry(t, feed)) for feed, make in boards.items()]])


ALL = " UNION ALL ".join(f"SELECT {OUT} FROM ({s})" for s in (ARBEITNOW, REMOTIVE, REMOTEOK, ADZUNA, GREENHOUSE, LEVER, ASHBY))


@query(f"""SELECT split_part(source, ':', 1) AS family, count(*) AS postings, count(DISTINCT source) AS sources,
    count(posted_ms) AS dated, CAST(sum(coalesce(salary_min, 0)) AS BIGINT) AS sum_min FROM ({ALL}) GROUP BY 1""")
def union_of_feeds(t: Tables) -> DataFrame:
    from rolemill.functions.display import source_label
    return all_feeds(t).groupBy(source_label(F.col("source")).alias("family")).agg(
        F.count("*").alias("postings"), F.countDistinct("source").alias("sources"),
        F.count("posted_at").alias("dated"), F.sum(F.coalesce("salary_min", F.lit(0))).alias("sum_min"))


HASH = ("sha256(" + S.norm("company") + " || '|' || " + S.norm("title") + " || '|' || " + S.norm("location")
        + " || '|' || array_to_string(list_sort(list_filter(string_split(skills, ','), lambda x: x <> '')), ','))")


@query(f"""WITH a AS (SELECT {OUT}, {HASH} AS content_hash FROM ({ALL}))
    SELECT content_hash, count(*) AS sightings FROM a GROUP BY content_hash""")
def feed_identities(t: Tables) -> DataFrame:
    """Content hashes over all feeds: the same posting from two places is one."""
    good, _ = split_rejects(all_feeds(t))
    return enrich(good).groupBy("content_hash").agg(F.count("*").alias("sightings"))


@query(f"""WITH a AS (SELECT {OUT}, {HASH} AS content_hash FROM ({ALL}))
    SELECT count(*) AS jobs, count(DISTINCT title) AS titles, CAST(sum(CASE WHEN embedding_status = 'pending' THEN 1 ELSE 0 END) AS BIGINT) AS pending
    FROM (SELECT content_hash, min(title) AS title, 'pending' AS embedding_status FROM a GROUP BY content_hash)""")
def ingest_all_feeds(t: Tables) -> DataFrame:
    """Scan, normalize, hash and upsert every feed into an empty job table."""
    good, _ = split_rejects(all_feeds(t))
    as_of = F.lit("2026-08-20 00:00:00").cast("timestamp")
    jobs = upsert_jobs(t.spark.createDataFrame([], schemas.JOBS), enrich(good), as_of)
    return jobs.agg(F.count("*").alias("jobs"), F.countDistinct(F.col("title")).alias("titles"),
                    F.count_if(F.col("embedding_status") == "pending").alias("pending"))

"""Search pages, filters, suggestions, detail and display columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.functions import display
from rolemill.functions.identity import job_id, text_key, user_key
from rolemill.operators import search
from rolemill.operators.search import JobFilter
from workload.common import Tables, query


def as_of(text: str = "2001-08-01 00:00:00"):
    return F.lit(text).cast("timestamp")


DATE = "CASE WHEN o_orderstatus <> 'P' OR o_orderpriority <> '1-URGENT' THEN o_orderdate END"
PAGE = """SELECT o_orderkey, posted, CAST(row_number() OVER (ORDER BY posted DESC NULLS FIRST, o_orderkey DESC) AS INT) AS position,
    CASE WHEN row_number() OVER (ORDER BY posted DESC NULLS FIRST, o_orderkey DESC) = {n} THEN
      coalesce(strftime(posted, '%Y-%m-%dT%H:%M:%S.%fZ'), '') || '|' || o_orderkey END AS next_cursor
    FROM (SELECT o_orderkey, """ + DATE + """ AS posted FROM orders) WHERE {cond} ORDER BY posted DESC NULLS FIRST, o_orderkey DESC LIMIT {n}"""


def dated_orders(t: Tables) -> DataFrame:
    """Orders with a posting date that urgent pending ones lack."""
    shown = F.when((F.col("o_orderstatus") != "P") | (F.col("o_orderpriority") != "1-URGENT"), F.col("o_orderdate"))
    return t.orders.select("o_orderkey", shown.alias("posted"))


@query(PAGE.format(n=100, cond="TRUE"))
def first_page(t: Tables) -> DataFrame:
    return search.page(dated_orders(t), "posted", "o_orderkey", 100)


@query(PAGE.format(n=100, cond="posted < TIMESTAMP '1999-06-15' OR (posted = TIMESTAMP '1999-06-15' AND o_orderkey < 300)"))
def next_page(t: Tables) -> DataFrame:
    return search.page(dated_orders(t), "posted", "o_orderkey", 100, "1999-06-15T00:00:00.000000Z|300")


@query(PAGE.format(n=50, cond="posted IS NOT NULL OR o_orderkey < 40"))
def page_after_undated(t: Tables) -> DataFrame:
    """The cursor row has no date: the rest of the undated rows, then the dated ones."""
    return search.page(dated_orders(t), "posted", "o_orderkey", 50, "|40")


JOBS = """SELECT p_partkey AS id, p_name AS title, p_brand AS company,
    CASE WHEN p_size < 40 THEN p_type || CASE WHEN p_size < 10 THEN ' Remote' WHEN p_size < 20 THEN ' hybrid' ELSE '' END END AS location,
    CASE WHEN p_brand < 'Brand#15' THEN TRUE WHEN p_brand < 'Brand#20' THEN FALSE END AS remote_allowed,
    CASE WHEN p_size < 10 THEN 'junior' WHEN p_size < 30 THEN 'mid' ELSE 'senior' END AS seniority,
    CASE WHEN p_type <> 'PROMO' THEN CAST(floor(p_retailprice) AS INT) END AS salary_max,
    CASE WHEN p_type <> 'SMALL' THEN TIMESTAMP '2001-08-01' - to_days(p_size) END AS posted_at,
    p_name || ' with VISA' || p_size AS description, p_brand || ' ' || p_type AS summary FROM part"""


def parts_as_jobs(t: Tables) -> DataFrame:
    size, brand = F.col("p_size"), F.col("p_brand")
    return t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), brand.alias("company"),
        F.when(size < 40, F.concat("p_type", F.when(size < 10, " Remote").when(size < 20, " hybrid").otherwise(""))).alias("location"),
        F.when(brand < "Brand#15", True).when(brand < "Brand#20", False).alias("remote_allowed"),
        F.when(size < 10, "junior").when(size < 30, "mid").otherwise("senior").alias("seniority"),
        F.when(F.col("p_type") != "PROMO", F.floor("p_retailprice").cast("int")).alias("salary_max"),
        F.when(F.col("p_type") != "SMALL", as_of() - F.make_dt_interval(size)).alias("posted_at"),
        F.concat("p_name", F.lit(" with VISA"), "p_size").alias("description"),
        F.concat("p_brand", F.lit(" "), "p_type").alias("summary"))


@query(f"""SELECT id, title FROM ({JOBS}) WHERE location ILIKE '%a%' AND remote_allowed AND seniority IN ('mid', 'senior')
    AND salary_max >= 910 AND posted_at >= TIMESTAMP '2001-08-01' - INTERVAL 35 DAY AND description ILIKE '%visa%'
    AND (title ILIKE '%Ro%' OR company ILIKE '%Ro%' OR summary ILIKE '%Ro%')""")
def compound_filter(t: Tables) -> DataFrame:
    f = JobFilter(q="Ro", location="a", remote=True, seniority="mid, senior,", salary_min=910, posted_within=35, visa=True)
    conds = search.conditions(f, as_of())
    return parts_as_jobs(t).where(reduce(lambda a, b: a & b, conds)).select("id", "title")


def _kind(k: str) -> str:
    return {
        "remote": "coalesce(remote_allowed, FALSE) OR coalesce(location ILIKE '%remote%', FALSE)",
        "hybrid": "coalesce(location ILIKE '%hybrid%', FALSE)",
        "onsite": """(remote_allowed IS NULL OR NOT remote_allowed) AND (location IS NULL OR location NOT ILIKE '%remote%')
            AND (location IS NULL OR location NOT ILIKE '%hybrid%')""",
    }[k]


@query(f"""SELECT id, {', '.join(f'({_kind(k)}) AS is_{k}' for k in ('remote', 'hybrid', 'onsite'))},
    CASE WHEN coalesce(location ILIKE '%hybrid%', FALSE) THEN 'Hybrid' WHEN coalesce(remote_allowed, FALSE) OR coalesce(location ILIKE '%remote%', FALSE) THEN 'Remote'
      WHEN remote_allowed IS NOT NULL OR coalesce(location, '') <> '' THEN 'On-site' ELSE '—' END AS label FROM ({JOBS})""")
def workplace_cases(t: Tables) -> DataFrame:
    jobs = parts_as_jobs(t)
    return jobs.select("id", *[search.workplace_is(k).alias(f"is_{k}") for k in ("remote", "hybrid", "onsite")],
                       display.workplace_label(F.col("remote_allowed"), F.col("location"))["label"].alias("label"))


@query("""SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND lower(l_returnflag) = 'r')
    AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND lower(l_returnflag) = 'n')""")
def linked_to_all(t: Tables) -> DataFrame:
    return search.having_all(t.orders, "o_orderkey", t.lineitem, "l_orderkey", "l_returnflag", ["R", "n"]).select("o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND split_part(o_orderpriority, '-', 1) = '1')""")
def linked_to_source(t: Tables) -> DataFrame:
    links = t.orders.select("o_custkey", F.regexp_replace("o_orderpriority", "-", ":").alias("source"))
    return search.having_source(t.customer, "c_custkey", links, "o_custkey", "1", family=True).select("c_custkey")


@query("""SELECT c_custkey, coalesce((SELECT array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') FROM orders WHERE o_custkey = c_custkey), '') AS sources
    FROM customer""")
def source_lists(t: Tables) -> DataFrame:
    rows = search.with_links(t.customer.select("c_custkey"), "c_custkey", t.orders, "o_custkey", "o_orderpriority", "sources")
    return rows.withColumn("sources", F.array_join("sources", ","))


VISIBLE = """SELECT c_custkey AS id, c_name AS title, c_mktsegment AS company, 'L' || c_nationkey AS location, last_date AS posted_at,
    last_date AS last_seen_at FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_date FROM orders GROUP BY 1) ON o_custkey = c_custkey"""


@query(f"""WITH j AS ({VISIBLE}) SELECT id, title, CAST(row_number() OVER (ORDER BY posted_at DESC NULLS FIRST, id DESC) AS INT) AS position,
      (SELECT array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') FROM orders WHERE o_custkey = id) AS sources
    FROM j WHERE last_seen_at >= TIMESTAMP '2001-08-01' - INTERVAL 400 DAY AND company <> 'BUILDING' AND location ILIKE '%1%'
      AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = id AND o_orderpriority = '1-URGENT')
      AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = id AND o_orderpriority = '5-LOW')
      AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = id AND o_orderstatus = 'O')
    ORDER BY posted_at DESC NULLS FIRST, id DESC LIMIT 100""")
def search_page(t: Tables) -> DataFrame:
    """A full search: visibility, filters, two skills, one source, first page with its source lists."""
    seen = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("posted_at"))
    none = F.lit(None)
    jobs = t.customer.join(seen, F.col("c_custkey") == F.col("k"), "left").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("company"),
        F.concat(F.lit("L"), "c_nationkey").alias("location"), "posted_at", F.col("posted_at").alias("last_seen_at"),
        F.when(F.col("c_mktsegment") == "BUILDING", "pending").otherwise("embedded").alias("embedding_status"),
        none.cast("boolean").alias("remote_allowed"), none.cast("string").alias("seniority"), none.cast("int").alias("salary_min"),
        none.cast("int").alias("salary_max"), none.cast("string").alias("salary_currency"), F.lit("s").alias("summary"),
        F.lit("u").alias("url"))
    skills = t.orders.select(F.col("o_custkey").alias("job_id"), F.col("o_orderpriority").alias("skill"))
    sources = t.orders.select(F.col("o_custkey").alias("job_id"), F.col("o_orderstatus").alias("source"))
    f = JobFilter(location="1", skills=["1-urgent", "5-LOW"], source="O")
    found = search.search(jobs, skills, sources, f, as_of(), limit=100, stale_days=400)
    return found.select("id", "title", "position", F.array_join("sources", ",").alias("sources"))


@query("""SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand ILIKE '%RAND#1%' GROUP BY 1 ORDER BY n DESC, value LIMIT 8""")
def suggest_frequent(t: Tables) -> DataFrame:
    return search.frequent_values(t.part, "p_brand", "RAND#1")


@query("""SELECT * FROM (SELECT value FROM (SELECT DISTINCT p_name AS value FROM part WHERE p_name ILIKE '%ar%' ORDER BY 1 LIMIT 8)
    UNION SELECT value FROM (SELECT DISTINCT p_type AS value FROM part WHERE p_type ILIKE '%ar%' ORDER BY 1 LIMIT 8) ORDER BY 1 LIMIT 8) WHERE lower(value) <> 'large'""")
def suggest_from_two(t: Tables) -> DataFrame:
    top = search.suggest_union([(t.part, "p_name"), (t.part, "p_type")], "ar")
    return search.without_echo(top, "large")


@query("""SELECT DISTINCT p_type AS value FROM part WHERE p_type ILIKE '%a%' ORDER BY 1 LIMIT 8""")
def suggest_distinct(t: Tables) -> DataFrame:
    return search.suggest_union([(t.part, "p_type")], "a")


LOOKUP = "d4735e3a-265e-16ee-e03f-59718b9b5d03"  # id of order 2


@query("""SELECT o_orderkey, o_orderpriority, (SELECT array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') FROM lineitem WHERE l_orderkey = o_orderkey) AS skills
    FROM orders WHERE o_orderkey = 2""")
def detail_by_id(t: Tables) -> DataFrame:
    """One row by its id with its links."""
    def uid(c):
        return job_id(text_key(F.col(c).cast("string")))

    rows = search.detail(t.orders.withColumn("id", uid("o_orderkey")), LOOKUP,
                         t.lineitem.withColumn("job_id", uid("l_orderkey")), "job_id", "l_returnflag")
    return rows.select("o_orderkey", "o_orderpriority", F.array_join("skills", ",").alias("skills"))


@query("""SELECT p_partkey, CASE WHEN lo IS NULL AND hi IS NULL THEN NULL ELSE CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN f1 || ' – ' || f2
      WHEN lo IS NOT NULL THEN f1 || '+' ELSE f2 || '-' END || CASE p_type WHEN 'PROMO' THEN '/hr' WHEN 'LARGE' THEN '/mo' WHEN 'SMALL' THEN '/yr' ELSE '' END END AS pay,
      CAST(floor(p_retailprice / 20000 * 100 + 0.5) AS INT) AS percent
    FROM (SELECT *, sign || CASE WHEN lo >= 1000 THEN CAST(floor(lo / 1000.0 + 0.5) AS BIGINT) || 'k' ELSE CAST(lo AS VARCHAR) END AS f1,
        sign || CASE WHEN hi >= 1000 THEN CAST(floor(hi / 1000.0 + 0.5) AS BIGINT) || 'k' ELSE CAST(hi AS VARCHAR) END AS f2 FROM
      (SELECT *, CASE WHEN p_size > 15 THEN CAST(floor(p_retailprice) AS INT) END AS lo, CASE WHEN p_size < 40 AND p_size > 5 THEN CAST(floor(p_retailprice * 3) AS INT) END AS hi,
        CASE p_brand WHEN 'Brand#1' THEN '$' WHEN 'Brand#2' THEN '€' WHEN 'Brand#3' THEN '£' WHEN 'Brand#4' THEN 'SGD' ELSE '' END AS sign FROM part))""")
def pay_display(t: Tables) -> DataFrame:
    size, price, brand, kind = F.col("p_size"), F.col("p_retailprice"), F.col("p_brand"), F.col("p_type")
    code = F.when(brand == "Brand#1", "USD").when(brand == "Brand#2", "EUR").when(brand == "Brand#3", "GBP").when(brand == "Brand#4", "SGD")
    period = F.when(kind == "PROMO", "hourly").when(kind == "LARGE", "monthly").when(kind == "SMALL", "yearly")
    return t.part.select(
        "p_partkey",
        display.format_salary(F.when(size > 15, F.floor(price).cast("int")), F.when((size < 40) & (size > 5), F.floor(price * 3).cast("int")),
                              code, period).alias("pay"),
        display.match_percent(price / 20000).alias("percent"))


@query("""SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago'
      WHEN s < 86400 * 30 THEN CAST(floor(s / 86400) AS BIGINT) || 'd ago' ELSE CAST(floor(floor(s / 86400) / 30) AS BIGINT) || 'mo ago' END AS age,
      substr(sha256('10.0.0.' || user_id || ':8'), 1, 16) AS who, event_type AS family
    FROM (SELECT *, floor((epoch_us(TIMESTAMP '2024-02-05') - epoch_us(ts)) / 1e6) AS s FROM events)""")
def event_display(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", display.time_ago(F.col("ts"), as_of("2024-02-05 00:00:00")).alias("age"),
        user_key(F.concat(F.lit(" 10.0.0."), "user_id", F.lit(" , 9.9.9.9")), F.lit(None).cast("string"), F.lit("8")).alias("who"),
        display.source_label(F.concat("event_type", F.lit(":"), "user_id")).alias("family"))


@query(f"""SELECT id, title, CAST(row_number() OVER (ORDER BY posted_at DESC NULLS FIRST, id DESC) AS INT) AS position
    FROM ({JOBS}) WHERE company = 'Brand#13' ORDER BY posted_at DESC NULLS FIRST, id DESC LIMIT 7""")
def company_page(t: Tables) -> DataFrame:
    """One company's postings; the page size is the leading number of what was sent."""
    conds = search.conditions(JobFilter(company="Brand#13"), as_of())
    rows = parts_as_jobs(t).where(reduce(lambda a, b: a & b, conds))
    return search.page(rows, "posted_at", "id", search.clamp_limit("7.9 rows")).select("id", "title", "position")


@query(f"""WITH j AS ({JOBS})
    SELECT 'Brand#1' AS prefix, company AS value FROM (SELECT company, count(*) AS n FROM j WHERE company ILIKE '%Brand#1%' GROUP BY 1 ORDER BY n DESC, company LIMIT 8)
    UNION ALL SELECT '#13', company FROM (SELECT DISTINCT company FROM j WHERE company = 'Brand#13')""")
def suggest_guarded(t: Tables) -> DataFrame:
    """Inputs of fewer than two characters, blanks aside, suggest nothing; the rest is unguarded."""
    jobs = parts_as_jobs(t)
    none = jobs.select(F.lit("").alias("skill"))
    frames = [search.suggest(jobs, none, "company", text).select(F.lit(text.strip()).alias("prefix"), "value")
              for text in ("B", " B ", "", "Brand#1", " #13 ")]
    return reduce(lambda a, b: a.unionByName(b), frames)

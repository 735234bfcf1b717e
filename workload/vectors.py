"""Vectors: norms, literals, matching, encoding, the embedding queue."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill import schemas
from rolemill.functions import vectors as V
from rolemill.functions.identity import text_key
from rolemill.operators import embedding, lists, match
from workload.common import SQL, Tables, query

DIM = 64
ENCODER = partial(embedding.hashed_token_encoder, DIM)
K = 5


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * label) AS v FROM embeddings),
    n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM e)
    SELECT vec_id, floor(len * 1e6 + 0.5) / 1e6 AS len_before, floor(CASE WHEN len = 0 THEN 0 ELSE v[1] / len END * 1e6 + 0.5) / 1e6 AS first_unit FROM n""")
def l2_normalize(t: Tables) -> DataFrame:
    """Vectors scaled by their label (label 0 gives zero vectors) back to unit length."""
    scaled = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * F.col("label")).alias("v"))
    return scaled.select(
        "vec_id", (F.floor(V.norm(F.col("v")) * 1e6 + 0.5) / 1e6).alias("len_before"),
        (F.floor(V.l2_normalize(F.col("v"))[0] * 1e6 + 0.5) / 1e6).alias("first_unit"))


@query("""SELECT vec_id, CAST(len(embedding) AS INT) AS n, floor(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) * 1e5 + 0.5) / 1e5 AS total,
    TRUE AS same FROM embeddings""")
def vector_literals(t: Tables) -> DataFrame:
    """Vectors to their text form and back."""
    back = V.parse_vector(V.vector_literal(F.col("embedding")))
    total = F.aggregate(back, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return t.embeddings.select("vec_id", F.size(back).alias("n"), (F.floor(total * 1e5 + 0.5) / 1e5).alias("total"),
                               (back == F.col("embedding")).alias("same"))


@query("SELECT vec_id, label < 5 AS fits FROM embeddings")
def dimension_guard(t: Tables) -> DataFrame:
    """Vectors of high labels lose their last element and fail the check."""
    cut = F.when(F.col("label") < 5, F.col("embedding")).otherwise(F.slice("embedding", 1, DIM - 1))
    return t.embeddings.select("vec_id", V.has_dim(cut, DIM).alias("fits"))


UNIT = "CAST(embedding AS DOUBLE[])"


@query(f"""SELECT vec_id, floor(s * 1000 + 0.5) / 1000 AS score FROM (SELECT vec_id, list_cosine_similarity({UNIT},
    (SELECT {UNIT} FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings WHERE label <> 3) ORDER BY s DESC, vec_id LIMIT 20""")
def nearest_to_one(t: Tables) -> DataFrame:
    """Top 20 for the first vector under a filter."""
    cvs = t.embeddings.select(F.col("vec_id").alias("id"), F.lit("embedded").alias("embedding_status"), "embedding")
    best = match.nearest(t.embeddings.where(F.col("label") != 3), match.query_vector(cvs, 0), 20, "vec_id", "embedding")
    return best.select("vec_id", V.score(F.col("distance")).alias("score"))


@query(f"""SELECT query_id, item_id, CAST(rank AS INT) AS rank, floor((1 - d) * 1000 + 0.5) / 1000 AS score FROM (
    SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(1 - list_cosine_similarity(q.e, i.e), 12) AS d,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(q.e, i.e), 12), i.vec_id) AS rank
    FROM (SELECT vec_id, {UNIT} AS e FROM embeddings) q JOIN (SELECT vec_id, {UNIT} AS e FROM embeddings) i ON q.vec_id <> i.vec_id)
    WHERE rank <= {K}""")
def nearest_for_all(t: Tables) -> DataFrame:
    """Top 5 others for every vector, exact."""
    e = t.embeddings
    best = match.top_k(e, e, K, "vec_id", "vec_id", skip_same_id=True)
    return best.select("query_id", "item_id", "rank", V.score(F.col("distance")).alias("score"))


JOBS = f"""SELECT vec_id, label, {UNIT} AS e, CASE WHEN vec_id % 4 < 3 THEN vec_id % 4 = 0 END AS remote_allowed,
      CASE WHEN label <> 2 THEN 1000 + vec_id END AS salary_max, vec_id % 9 <> 5 AS fresh FROM embeddings"""


@query(f"""SELECT vec_id::VARCHAR AS id, 'T' || vec_id AS title, floor(s * 1000 + 0.5) / 1000 AS score FROM (
      SELECT vec_id, list_cosine_similarity(e, (SELECT {UNIT} FROM embeddings WHERE vec_id = 1)) AS s FROM ({JOBS})
      WHERE remote_allowed AND salary_max >= 1040 AND fresh AND label % 2 = 0)
    ORDER BY s DESC, vec_id::VARCHAR LIMIT 12""")
def match_filtered(t: Tables) -> DataFrame:
    """Best postings for one profile: embedded, fresh, remote, paid enough, with two skills."""
    as_of = F.lit("2026-08-20 00:00:00").cast("timestamp")
    n, old = F.col("vec_id"), F.make_dt_interval(F.when(F.col("vec_id") % 9 == 5, 31).otherwise(30))
    jobs = t.embeddings.select(
        n.cast("string").alias("id"), F.concat(F.lit("T"), n).alias("title"), "embedding", F.lit("embedded").alias("embedding_status"),
        F.when(n % 4 < 3, n % 4 == 0).alias("remote_allowed"), F.when(F.col("label") != 2, 1000 + n).alias("salary_max"),
        (as_of - old).alias("last_seen_at"), *[F.lit(None).cast("string").alias(c) for c in (
            "company", "location", "seniority", "salary_min", "salary_currency", "summary", "url", "posted_at")])
    skills = t.embeddings.select(n.cast("string").alias("job_id"), F.explode(
        F.when(F.col("label") % 2 == 0, F.array(F.lit("SQL"), F.lit("Go"))).otherwise(F.array(F.lit("sql")))).alias("skill"))
    cvs = t.embeddings.where(n == 1).select(F.lit("cv").alias("id"), F.lit("embedded").alias("embedding_status"), "embedding")
    best = match.match(jobs, cvs, "cv", as_of, skills, "12.5", remote=True, skills=["go", "SQL"], salary_min=1040)
    return best.select("id", "title", "score")


NEAREST_SQL = SQL["nearest_for_all"]


@query(NEAREST_SQL)
def nearest_for_all_blocks(t: Tables) -> DataFrame:
    """The same in small blocks, so that both sides are cut into cells."""
    e = t.embeddings
    best = match.top_k(e, e, K, "vec_id", "vec_id", skip_same_id=True, block=200)
    return best.select("query_id", "item_id", "rank", V.score(F.col("distance")).alias("score"))


SHARE = 0.85  # of all vectors whose codes are looked at: these vectors have no clusters, the best cosines lie at 0.3 to 0.4


def approximate(t: Tables) -> DataFrame:
    e = t.embeddings
    return lists.search_lists(e, lists.file_vectors(e, DIM, "vec_id"), K, SHARE, "vec_id", skip_same_id=True)


@query()
def nearest_for_all_approximate(t: Tables) -> DataFrame:
    """Top 5 others for every vector from the codes of its closest lists, with what was looked at and compared."""
    return approximate(t)


@query("SELECT (SELECT count(*) FROM embeddings) AS queries, TRUE AS enough, TRUE AS few_compared")
def approximate_recall(t: Tables) -> DataFrame:
    """Whether at least nine in ten of the exact top 5 are found while under a fiftieth of all full pairs is compared."""
    e = t.embeddings
    exact = match.top_k(e, e, K, "vec_id", "vec_id", skip_same_id=True).select("query_id", "item_id")
    found = approximate(t).select("query_id", "item_id", "compared", F.lit(1).alias("hit"))
    per_query = exact.join(found, ["query_id", "item_id"], "left").groupBy("query_id").agg(
        F.count("hit").alias("hits"), F.count("*").alias("wanted"), F.max("compared").alias("compared"))
    return per_query.agg(F.count("*").alias("queries"), (F.sum("hits") >= 0.9 * F.sum("wanted")).alias("enough"),
                         (F.avg("compared") < F.count("*") / 50).alias("few_compared"))


@query(NEAREST_SQL)
def nearest_for_all_lists(t: Tables) -> DataFrame:
    """Every list visited: exact, from one byte a component and a short list of full vectors."""
    e = t.embeddings
    best = lists.search_lists(e, lists.file_vectors(e, DIM, "vec_id"), K, 1.0, "vec_id", skip_same_id=True, block=300)
    return best.select("query_id", "item_id", "rank", V.score(F.col("distance")).alias("score"))


@query(SQL["nearest_to_one"])
def nearest_to_one_filed(t: Tables) -> DataFrame:
    """Top 20 for the first vector under a filter, list by list in order of the smallest possible angle."""
    index = lists.file_vectors(t.embeddings, DIM, "vec_id", keep=["label"])
    vector = t.embeddings.where("vec_id = 0").first()["embedding"]
    best, _ = lists.search_one(index, vector, 20, F.col("label") != 3)
    return best.select(F.col("_id").alias("vec_id"), V.score(F.col("distance")).alias("score"))


TOKENS = f"""SELECT doc_id, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % {DIM} AS b FROM
    (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS tok FROM documents)"""


@query(f"""WITH c AS (SELECT doc_id, b, count(*) AS n FROM ({TOKENS}) GROUP BY doc_id, b),
    l AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM c),
    f AS (SELECT doc_id, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x FROM l)
    SELECT doc_id, CAST(count(*) AS INT) AS filled, floor(sum(x) * 1e3 + 0.5) / 1e3 AS total, floor(max(x) * 1e4 + 0.5) / 1e4 AS top FROM f GROUP BY doc_id""")
def hashed_encoding(t: Tables) -> DataFrame:
    """Encode every document; summary of each vector."""
    coded = embedding.encode(t.spread("documents").select("doc_id", "text"), "text", ENCODER, DIM, keep=["doc_id"])
    vec = F.transform("embedding", lambda x: x.cast("double"))
    total = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x)
    return coded.select(
        "doc_id", F.size(F.filter("embedding", lambda x: x > 0)).alias("filled"),
        (F.floor(total * 1e3 + 0.5) / 1e3).alias("total"), (F.floor(F.array_max(vec) * 1e4 + 0.5) / 1e4).alias("top"))


@query("""WITH d AS (SELECT sha256(text) AS hash, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1),
    c AS (SELECT DISTINCT sha256(text) AS hash FROM documents WHERE lang = 'fr' UNION SELECT sha256(text) FROM benchmark)
    SELECT hash, hash IN (SELECT hash FROM c) AS hit FROM d""")
def cache_split(t: Tables) -> DataFrame:
    """Distinct document texts against a cache of all French texts and the benchmark."""
    keyed = t.documents.select("text", text_key(F.col("text")).alias("hash"))
    known = t.documents.where(F.col("lang") == "fr").select("text").unionByName(t.benchmark.select("text"))
    cache = known.select(text_key(F.col("text")).alias("content_hash")).distinct().withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>"))
    hits, misses = embedding.split_by_cache(keyed, cache)
    return hits.select("hash", F.lit(True).alias("hit")).unionByName(misses.select("hash", F.lit(False).alias("hit")))


def queue_tables(t: Tables):
    none = F.lit(None)
    state = dict(embedding=none.cast("array<float>"), embedding_status=F.when(F.col("o_orderstatus") == "F", "failed").otherwise("pending"),
                 embedding_retry_count=F.when(F.col("o_orderpriority") == "5-LOW", 6).otherwise(0),
                 embedding_last_attempt_at=none.cast("timestamp"), updated_at=none.cast("timestamp"))
    jobs = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"),
                           F.col("o_orderstatus").alias("company"), none.cast("string").alias("location"), F.lit("mid").alias("seniority"),
                           *[c.alias(n) for n, c in state.items()])
    cvs = t.customer.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("target_role"),
        F.array().cast("array<struct<skill:string,occurrences:int>>").alias("skills"), none.cast("float").alias("estimated_years_experience"),
        none.cast("array<float>").alias("embedding"), F.lit("pending").alias("embedding_status"), F.lit(0).alias("embedding_retry_count"),
        none.cast("timestamp").alias("embedding_last_attempt_at"), none.cast("timestamp").alias("updated_at"))
    skills = t.spark.createDataFrame([], schemas.JOB_SKILLS)
    cache = t.customer.where(F.col("c_acctbal") > 0).select(
        text_key(F.col("c_name")).alias("content_hash"), F.array_repeat(F.lit(0.125), DIM).cast("array<float>").alias("embedding"),
        F.lit("m").alias("model"), F.lit(DIM).alias("dim"), none.cast("timestamp").alias("created_at"))
    return jobs, skills, cvs, cache


@query("""WITH q AS (SELECT 'job' AS kind, o_orderstatus = 'F' AND o_orderpriority = '5-LOW' AS dead, FALSE AS cached FROM orders
      UNION ALL SELECT 'cv', FALSE, c_acctbal > 0 FROM customer)
    SELECT kind, CASE WHEN dead THEN 'failed' ELSE 'embedded' END AS status, count(*) AS n, count(*) FILTER (cached) AS from_cache FROM q GROUP BY 1, 2""")
def queue_drain(t: Tables) -> DataFrame:
    """Drain a queue where few texts repeat over very many rows."""
    jobs, skills, cvs, cache = queue_tables(t)
    as_of = F.lit("2026-08-20 00:00:00").cast("timestamp")
    out = embedding.drain_queue(jobs, skills, cvs, cache, ENCODER, as_of, DIM)
    # Cached vectors are flat, encoded ones are not.
    flat = F.coalesce(F.array_max("embedding") == F.array_min("embedding"), F.lit(False))
    def part(df, kind):
        return df.groupBy(F.lit(kind).alias("kind"), F.col("embedding_status").alias("status")).agg(
            F.count("*").alias("n"), F.count_if(flat).alias("from_cache"))
    return part(out.jobs, "job").unionByName(part(out.cvs, "cv"))


@query("""SELECT CAST((SELECT count(*) FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')) + (SELECT count(*) FROM customer) AS BIGINT) AS processed,
    CAST((SELECT count(*) FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')) + (SELECT count(*) FROM customer) AS BIGINT) AS embedded,
    (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS cached, CAST(0 AS BIGINT) AS failed""")
def queue_stats(t: Tables) -> DataFrame:
    jobs, skills, cvs, cache = queue_tables(t)
    as_of = F.lit("2026-08-20 00:00:00").cast("timestamp")
    return embedding.drain_queue(jobs, skills, cvs, cache, ENCODER, as_of, DIM).stats

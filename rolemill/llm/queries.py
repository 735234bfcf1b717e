"""One query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemill.llm.jaccard import JaccardJoin
from rolemill.llm.language_id import fit, identify
from rolemill.llm.language_model import score_texts
from rolemill.llm.lexical import search_ranked
from rolemill.llm.licenses import license_digest, scan_licenses
from rolemill.llm.mixing import mix_sources
from rolemill.llm.pieces import encode_texts
from rolemill.llm.registry import QUERIES, SQL, query, table
from rolemill.llm.substring import remove_repeats
from rolemill.llm.token_counts import count_tokens
from rolemill.llm.topk import top_k
from rolemill.llm.turn_trie import prefix_trie, sequences, with_shared_heads
from rolemill.llm.vectors_near import near_vectors
from rolemill.llm.warc import archive

__all__ = ["QUERIES", "SQL"]


@query("""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS ws
           FROM documents),
     p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w WHERE len(ws) >= 35),
     h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM p),
     r AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
     c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM h JOIN r USING (k)),
     g AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(ws, lambda x, j: js IS NULL OR NOT list_contains(js, j)), ' '), ''))
           AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
""")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


@query()
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(table(spark, sf_dir, "documents").select("doc_id", "text")).result()


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


@query("""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     h AS (SELECT page_id, b, sha1(b) AS hex, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                              ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (5 * (3 - i % 4))) & 31) + 1, 1)
                       for i in range(32)], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM h
""")
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).drop("record")


@query("""
WITH s AS (SELECT source, sum(octet_length(encode(coalesce(text, ''))))::DOUBLE AS size FROM documents GROUP BY source),
     r AS (SELECT source, (SELECT sum(size) FROM s) * sqrt(size) / (SELECT sum(sqrt(size)) FROM s) / size AS rate
           FROM s WHERE size > 0),
     k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM r),
     l AS (SELECT source, k, -rate + k * ln(rate) - sum(CASE WHEN k = 0 THEN 0 ELSE ln(greatest(k, 1)) END)
                  OVER (PARTITION BY source ORDER BY k) AS lp FROM k),
     c AS (SELECT source, sum(exp(lp)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM l),
     t AS (SELECT source, list(cdf) AS steps FROM c GROUP BY source),
     d AS (SELECT *, ('0x' || substr(md5('mix-1|' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
           FROM documents),
     n AS (SELECT d.*, len([x for x in steps if x <= u]) AS n FROM d JOIN t USING (source))
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, md5('mix-1|' || doc_id || '|' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM n WHERE n > 0)
""")
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS vec FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.vec, v.vec)::BIGINT AS score
           FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS vec FROM embeddings),
     e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
           AND list_cosine_similarity(a.vec, b.vec) >= 0.93),
     c(a, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.a, c.root FROM c JOIN e ON e.b = c.a),
     m AS (SELECT a AS vec_id, min(root) AS component_id FROM c GROUP BY a),
     n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM m LEFT JOIN n USING (vec_id)
""")
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def remainder(id: str, by: int):
    """crc32 of an id as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))) % by


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, remainder("doc_id", 4) != 2)
    return identify(docs.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "text"), model).drop("text")


@query()
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), remainder("doc_id", 10) != 0)
    return scored.withColumn("held_out", ~F.col("trained")).drop("trained")


@query()
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query(r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
     i AS (SELECT row_number() OVER () AS q, item_id,
                  unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
     c AS (SELECT count(*)::BIGINT AS N, sum(len(ts))::BIGINT AS L FROM d WHERE len(ts) > 0),
     p AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
     w AS (SELECT t, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
           FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
     s AS (SELECT q, r, sum(again * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(ts)::BIGINT * c.N) // c.L))))::BIGINT
                  AS score
           FROM (SELECT q, t, count(*) AS again FROM i GROUP BY q, t) JOIN p USING (t) JOIN w USING (t) JOIN d USING (r), c
           GROUP BY q, r),
     k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank
           FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k JOIN (SELECT DISTINCT q, item_id FROM i) USING (q) WHERE rank <= 10
""")
def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_ranked(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query()
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query(r"""
WITH t AS (SELECT conv_id, list({'r': r, 's': s} ORDER BY turn NULLS FIRST, sha256(octet_length(encode(r)) || ':' || r || s)) AS own
           FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS s FROM conversations)
           WHERE conv_id IS NOT NULL GROUP BY conv_id),
     h AS (SELECT conv_id, own, (xor(list_reduce(flatten([[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]
                                                for x in string_split(conv_id::VARCHAR, '')])::BIGINT[],
                                        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
                                                          ELSE xor(a >> 1, 3988292384 * (a & 1)) END,
                                        4294967295::BIGINT), 4294967295) % 4)::INTEGER AS h FROM t),
     b AS (SELECT h.conv_id, list_concat(coalesce(t.own[1:h.h], []), h.own[h.h + 1:]) AS path
           FROM h LEFT JOIN t ON t.conv_id = h.conv_id - h.conv_id % 20),
     n AS (SELECT path[1:d] AS p, d, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs,
                  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = d), '')) AS ends_sha256
           FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM b) GROUP BY p, d),
     v AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(p[d].s, '[^\x20\x09-\x0D]+')) END AS own
           FROM n),
     c AS (SELECT p[1:d - 1] AS p, count(*)::BIGINT AS n_children FROM n WHERE d > 0 GROUP BY ALL),
     l AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN c USING (p)),
     s AS (SELECT a.p, count(*) FILTER (x.n_children = 0)::BIGINT AS n_leaves, sum(x.own)::BIGINT AS saved_tokens
           FROM l a JOIN l x ON x.d >= a.d AND x.p[1:a.d] = a.p GROUP BY a.p)
SELECT l.conv_id, l.d::BIGINT AS depth, u.conv_id AS parent_conv_id, l.n_convs, l.n_children, n_leaves, saved_tokens,
       l.ends_sha256
FROM l JOIN s ON s.p = l.p LEFT JOIN n u ON l.d > 0 AND u.d = l.d - 1 AND u.p = l.p[1:l.d - 1]
""")
def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_heads(sequences(table(spark, sf_dir, "conversations"))))

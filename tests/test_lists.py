"""Inverted lists: exact where every list is visited, few full vectors compared, far lists never read."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolemill.operators import lists, match


def table(spark, mat, start=0):
    rows = [(start + n, [float(x) for x in v], n % 3) for n, v in enumerate(mat)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, label int").repartition(3)


def clustered(n=600, dim=24, centres=12, seed=0):
    r = np.random.default_rng(seed)
    middle = r.standard_normal((centres, dim)) * 6
    return (middle[r.integers(0, centres, n)] + r.standard_normal((n, dim))).astype(np.float32)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.item_id, round(r.distance, 9)))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def test_every_list_is_exact(spark):
    mat = clustered(300)
    mat[100:250] = mat[7]  # half of all vectors in one list, all at the same distance
    df = table(spark, mat)
    odd = spark.createDataFrame([(900, None, 1), (901, [], 1), (902, [0.0] * 24, 1), (903, [1.0] * 23, 1), (904, [float("nan")] + [1.0] * 23, 1),
                                 (905, [float("inf")] * 24, 1), (906, [None] + [1.0] * 23, 1)], df.schema)
    index = lists.file_vectors(df.unionByName(odd), 24)
    assert index.rows.count() == 300 == index.sizes.sum() and len(index.centres) == 17
    got = lists.search_lists(df.unionByName(odd), index, 4, 1.0, skip_same_id=True, block=40)
    assert found(got) == found(match.top_k(df, df, 4, skip_same_id=True))
    few = lists.search_lists(df.limit(3), index, 400, 1.0)
    assert few.groupBy("query_id").count().select("count").distinct().collect()[0][0] == 300


def test_few_lists_and_few_full_vectors(spark):
    df = table(spark, clustered())
    index = lists.file_vectors(df, 24, lists=12)
    got = lists.search_lists(df, index, 5, 0.15, skip_same_id=True)
    exact = found(match.top_k(df, df, 5, skip_same_id=True))
    near = found(got)
    hits = sum(len({i for i, _ in exact[q]} & {i for i, _ in near.get(q, [])}) for q in exact)
    assert hits > 0.95 * 5 * 600
    cost = got.groupBy("query_id").agg(F.max("scanned").alias("s"), F.max("compared").alias("c")).agg(F.avg("s"), F.avg("c")).first()
    assert cost[0] < 0.35 * 600 and cost[1] < 12, cost


def test_codes_bound_what_they_miss():
    r = np.random.default_rng(2)
    unit = r.standard_normal((200, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    centres = lists.fit_centres(unit, 9)
    near = np.argmax(unit @ centres.T, axis=1)
    codes, scale, err = lists.encode_residuals(unit, centres, near)
    about = unit @ (centres[near] + codes * scale[:, None]).T
    assert (np.abs(about - unit @ unit.T) <= err + 1e-12).all() and err.max() < 0.01
    assert len(lists.fit_centres(unit[:3], 9)) == 3


@pytest.mark.parametrize("filtered", [False, True])
def test_one_query_skips_far_lists(spark, filtered):
    df = table(spark, clustered(400, seed=3))
    index = lists.file_vectors(df, 24, lists=12, keep=["label"])
    query = df.where("id = 5").first()["embedding"]
    where, want = (F.col("label") == 1, df.where("label = 1")) if filtered else (None, df)
    got, read = lists.search_one(index, query, 10, where, ["label"])
    best = [(r.id, round(r.distance, 9)) for r in match.nearest(want, query, 10, "id", "embedding").collect()]
    assert [(r["_id"], round(r.distance, 9)) for r in got.collect()] == best
    assert read < 12
    everything, read = lists.search_one(index, query, 1000, where)
    assert everything.count() == want.count() and read == 12


def test_nothing_filed(spark):
    df = table(spark, clustered(5))
    index = lists.file_vectors(df.where("false"), 24)
    assert lists.search_lists(df, index, 3, 1.0).count() == 0
    assert lists.search_one(index, [1.0] * 24, 3)[0].count() == 0
    full = lists.file_vectors(df, 24)
    assert lists.search_lists(df.where("false"), full, 3, 1.0).count() == 0


def test_exact_search_over_mixed_lengths(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).standard_normal(3 + i % 3)]) for i in range(30)] + [(99, []), (98, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    parts = [df.where(F.size("embedding") == n) for n in (3, 4, 5)]
    want = {}
    for part in parts:
        want |= found(match.top_k(part, part, 4, skip_same_id=True))
    assert found(match.top_k(df, df, 4, skip_same_id=True)) == want == found(match.top_k(df, df, 4, skip_same_id=True, block=7))


def test_broadcasts_need_no_copy_of_the_package(spark, monkeypatch):
    """Executors cannot import the package: functions travel with the job, classes inside broadcasts do not."""
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or send(self, value))
    df = table(spark, clustered(60))
    index = lists.file_vectors(df, 24, lists=4)
    lists.search_lists(df, index, 3, 0.9, skip_same_id=True)
    assert len(sent) == 2 and not any(b"rolemill" in pickle.dumps(value) for value in sent)


def test_vectors_are_sent_by_strip_not_by_list(spark, monkeypatch):
    """However many lists a query visits, its vector is sent once for each strip of lists, and rows of pairs stay few."""
    df, grouped = table(spark, clustered()), []
    group = type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *cols: grouped.append(self) or group(self, *cols))
    index = lists.file_vectors(df, 24, lists=40)
    grouped.clear()
    got = lists.search_lists(df, index, 5, 1.0, skip_same_id=True, block=100)
    sent = [x.count() for x in grouped if {"_vec", "_code"} & set(x.columns)]
    assert sent and max(sent) < 12 * 600, sent  # 6 to 11 strips on 8 cores, 40 lists
    assert found(got) == found(match.top_k(df, df, 5, skip_same_id=True))


def test_short_lists_in_small_steps(spark, monkeypatch):
    """Chunks of a list, tiles of queries and early pruning leave the results and the counts as they are."""
    mat = clustered(300, seed=4)
    mat[100:250] = mat[7]  # a list of more than a strip
    df = table(spark, mat)
    df = df.unionByName(df.where("id < 9"))  # ids that come twice
    index = lists.file_vectors(df, 24)

    def run(**sizes):
        for name, n in sizes.items():
            monkeypatch.setattr(lists, name, n)
        return sorted(tuple(r) for r in lists.search_lists(df, index, 4, 0.9, skip_same_id=True, block=300 if not sizes else 40).collect())

    assert run() == run(BLOCK=16, TILE=7, MATRIX_CELLS=60)
    first, pieces = lists._strips_of(np.array([3, 3, 10, 0, 4, 4, 4]), 4)
    assert list(zip(first, pieces)) == [(0, 1), (1, 1), (2, 3), (5, 1), (5, 1), (6, 1), (7, 1)]

"""Running totals over sampled ranges, trailing counts by rank, spans of one key, large dictionaries."""

import random

import pytest
from pyspark.sql import functions as F

from rolemill.operators import prompts, skills
from rolemill.operators.spans import span_union
from rolemill.plans import skew


@pytest.fixture(scope="module")
def points(spark):
    r = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 50}", t, r.randrange(-5, 9)) for i, t in enumerate(r.sample(range(100_000), 3000))]
    return rows, spark.createDataFrame(rows, "k string, t bigint, v bigint").repartition(5)


def test_running_totals(points):
    rows, df = points
    total, most, want = {}, {}, {}
    for k, t, v in sorted(rows, key=lambda x: (x[0], x[1])):
        want[k, t] = [most.get(k)]
        total[k], most[k] = total.get(k, 0) + v, max(v, most.get(k, v))
        want[k, t].append(total[k])
    top = {(r.k, r.t): r.m for r in skew.running_max_before(df, ["k"], "t", "v", "m", parts=7).collect()}
    days = {(r.k, r.t): r.m for r in skew.running_max_before(df, ["k"], "t", "v", "m", F.floor(F.col("t") / 900)).collect()}
    sums = {(r.k, r.t): r.s for r in skew.running_sum(df, ["k"], "t", "v", "s", parts=7).collect()}
    assert top == days == {x: w[0] for x, w in want.items()} and sums == {x: w[1] for x, w in want.items()}


def test_ranges_split_one_key(spark):
    one = spark.range(4000).select(F.lit("k").alias("k"), (F.col("id") * 7 % 4001).alias("t"))
    sizes = [r["count"] for r in skew.in_ranges(one, ["k"], "t", 8).groupBy("_block").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


def test_trailing_count_by_rank(spark, points):
    rows, _ = points
    timed = spark.createDataFrame([(k, t // 40) for k, t, _ in rows], "k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    by = lambda hot: sorted((r.k, r.s, r.n) for r in skew.trailing_count(timed, ["k"], "ts", 60, "n", hot).collect())
    assert by(1) == by(10**9)
    gone = sorted((k, t // 40) for k, t, _ in rows)
    assert by(1)[5][2] == sum(k == gone[5][0] and gone[5][1] - 60 < s <= gone[5][1] for k, s in gone)


def test_spans_of_one_key_and_day(spark):
    r = random.Random(8)
    spans = [("k", a, a + r.choice([0, 3, 40, 4000])) for a in (r.randrange(86_400) for _ in range(2500))]
    df = spark.createDataFrame(spans, "k string, a bigint, b bigint").select(
        "k", F.timestamp_seconds("a").alias("a"), F.timestamp_seconds("b").alias("b"))
    covered = {x for _, a, b in spans for x in range(a, b)}
    islands = sum(x - 1 not in covered for x in covered)
    for parts in (None, 9):
        got = span_union(df, "k", "a", "b", parts).first()
        assert (got.islands, got.covered_us) == (islands, len(covered) * 1_000_000)


def test_large_dictionary(spark, monkeypatch):
    names = [f"term{i}" for i in range(120_000)] + [f"two w{i}" for i in range(300)] + [f"s{i}+" for i in range(400)]
    book = spark.createDataFrame([(n, n.upper()) for n in names], "term string, canonical string").repartition(4)
    df = spark.createDataFrame([(1, "term7 x term119999, two w5 two  w5"), (2, "s399+s3+ as3+ _s3+ .s3+"), (3, None), (4, "")], "id int, t string")
    want = {(1, "TERM7", 1, 1), (1, "TERM119999", 1, 3), (1, "TWO W5", 1, 4), (2, "S399+", 1, 1), (2, "S3+", 2, 1)}
    assert set(map(tuple, skills.match_terms(df, "id", "t", book).collect())) == want  # too many rows to broadcast
    monkeypatch.setattr(skills, "is_small", lambda terms: True)
    assert set(map(tuple, skills.match_terms(df, "id", "t", book).collect())) == want


def test_latencies_merge(spark):
    log = spark.range(20_000).select((F.col("id") % 7).alias("day"), F.lit("m").alias("model"),
                                     F.when(F.col("id") % 10 > 0, F.pmod(F.xxhash64("id"), F.lit(1000))).alias("ms"))
    daily = prompts.latency_sketches(log.unionByName(spark.createDataFrame([(9, "none", None)], log.schema)), ["model", "day"], "ms")
    week = {r.model: r for r in prompts.latency_over(daily, ["model"], [0.5, 0.99, 0.999]).collect()}
    assert set(week) == {"m"} and week["m"].calls == 18_000
    assert abs(week["m"].p50 - 500) < 20 and abs(week["m"].p99 - 990) < 12 and week["m"].p99_9 > 985

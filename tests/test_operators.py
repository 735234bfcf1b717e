"""Search, suggestions, skills, matching, queue, limits, prompts, skew plans."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolemill import schemas
from rolemill.functions.identity import text_key
from rolemill.operators import embedding, limits, match, prompts, search, skills, spans
from rolemill.operators.search import JobFilter
from rolemill.plans import skew
from rolemill.plans.broadcast import broadcast_if_small, is_small
from rolemill.streaming import limits as stream_limits

NOW = dt.datetime(2026, 8, 20)


def as_of():
    return F.lit("2026-08-20 00:00:00").cast("timestamp")


def jobs_table(spark, rows):
    names = [c.strip().split(" ")[0] for c in schemas.JOBS.split(", ")]
    base = dict.fromkeys(names)
    base.update(title="T", company="C", summary="S", url="u", embedding_status="embedded",
                embedding_retry_count=0, last_seen_at=NOW)
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], schemas.JOBS)


def links(spark, rows, value):
    return spark.createDataFrame(rows, f"job_id string, {value} string")


T1, T2 = dt.datetime(2026, 8, 1), dt.datetime(2026, 8, 2)


def test_pages(spark):
    rows = [dict(id="5"), dict(id="4"), dict(id="3", posted_at=T2), dict(id="2", posted_at=T1),
            dict(id="1", posted_at=T1), dict(id="9", last_seen_at=dt.datetime(2026, 7, 20)),
            dict(id="8", embedding_status="pending"), dict(id="7", embedding_status="failed")]
    jobs = jobs_table(spark, rows)
    sk = links(spark, [], "skill")
    so = links(spark, [("5", "b"), ("5", "a"), ("1", "z")], "source")
    cursor, seen, pages = None, [], 0
    while True:
        got = search.search(jobs, sk, so, JobFilter(), as_of(), 2, cursor)
        rows_ = got.collect()
        seen += [r.id for r in rows_]
        if pages == 0:
            assert rows_[0].sources == ["a", "b"] and rows_[1].sources == []
        pages += 1
        cursor = search.next_cursor(got)
        if cursor is None:
            break
    assert seen == ["5", "4", "3", "2", "1"] and pages == 3


def ids(spark, jobs, f, sk=(), so=()):
    got = search.search(jobs, links(spark, list(sk), "skill"), links(spark, list(so), "source"), f, as_of())
    return sorted(r.id for r in got.collect())


def test_filters(spark):
    jobs = jobs_table(spark, [
        dict(id="a", remote_allowed=True, location="Paris", seniority="senior", salary_max=100, company="X",
             description="We offer VISA help", posted_at=dt.datetime(2026, 8, 19)),
        dict(id="b", location="Hybrid - London", seniority="mid", salary_min=500),
        dict(id="c"),
        dict(id="d", remote_allowed=False, location="Remote", title="Big Data"),
        dict(id="e", remote_allowed=True, location="Hybrid", summary="about big things"),
    ])
    assert ids(spark, jobs, JobFilter(workplace="remote")) == ["a", "d", "e"]
    assert ids(spark, jobs, JobFilter(workplace="hybrid")) == ["b", "e"]
    assert ids(spark, jobs, JobFilter(workplace="onsite")) == ["c"]
    assert ids(spark, jobs, JobFilter(remote=False)) == ["d"]
    assert ids(spark, jobs, JobFilter(seniority=" mid,, senior ")) == ["a", "b"]
    assert ids(spark, jobs, JobFilter(salary_min=100)) == ["a"]
    assert ids(spark, jobs, JobFilter(posted_within=2)) == ["a"]
    assert ids(spark, jobs, JobFilter(visa=True)) == ["a"]
    assert ids(spark, jobs, JobFilter(q="BIG")) == ["d", "e"]
    assert ids(spark, jobs, JobFilter(company="X")) == ["a"]
    assert ids(spark, jobs, JobFilter(location="on%on")) == ["b"]
    sk = [("a", "Go"), ("a", "SQL"), ("b", "go"), ("b", "rust")]
    assert ids(spark, jobs, JobFilter(skills=["go", "sql"]), sk) == ["a"]
    assert ids(spark, jobs, JobFilter(skills=["GO"]), sk) == ["a", "b"]
    so = [("a", "lever:acme"), ("b", "lever")]
    assert ids(spark, jobs, JobFilter(source="lever"), (), so) == ["b"]
    assert ids(spark, jobs, JobFilter(source="lever", source_family=True), (), so) == ["a", "b"]
    assert [search.clamp_limit(x) for x in (None, 0, "7", "x", 1000)] == [20, 20, 7, 20, 100]


def test_suggest(spark):
    jobs = jobs_table(spark, [dict(id=str(i), company=f"Comp{i % 10}", title=f"t{i} comp", location="Rome") for i in range(12)])
    sk = links(spark, [("1", "Python"), ("2", "Python"), ("1", "pytest")], "skill")

    def run(*a, **k):
        return [r[0] for r in search.suggest(jobs, sk, *a, **k).collect()]

    assert run("skill", "PY") == ["Python", "pytest"]
    assert run("skill", "python", drop_echo=True) == []
    assert run("company", "comp")[:2] == ["Comp0", "Comp1"] and len(run("company", "comp")) == 8
    assert run("company", " c ") == []
    assert run("q", "comp") == [f"Comp{i}" for i in range(8)]
    uid = "0a0a0a0a-0000-0000-0000-00000000000a"
    j = jobs_table(spark, [dict(id=uid)])
    row = search.detail(j, uid, links(spark, [(uid, "b"), (uid, "a")], "skill"), "job_id").first()
    assert row.skills == ["a", "b"] and search.detail(j, "nope").count() == 0


DICTIONARY = [
    ("Node.js", ["Node", "NodeJS"]), ("React", ["React.js", "ReactJS"]), ("PostgreSQL", ["Postgres", "psql"]),
    ("Python", ["py"]), ("CI/CD", ["CI", "CD", "GitLab CI"]), ("REST API", ["REST", "RESTful"]), ("C++", ["cpp"]),
    ("C#", ["csharp", ".NET"]), ("Mobile Development", ["React Native", "iOS"]), ("JavaScript", ["JS"]),
    ("Objective-C", ["ObjC"]), ("C", []), ("Finance", ["FP&A"]), ("Testing", ["Vitest"]), ("Vitest", []),
    ("Kafka", ["Apache Kafka"]), ("SQL", []),
]


def dictionary(spark):
    return skills.dictionary(spark.createDataFrame(
        [(i, c, a) for i, (c, a) in enumerate(DICTIONARY)], "pos int, canonical string, aliases array<string>"))


def by_hand(text):
    """Brute force of the matching rule, position by position."""
    terms = {}
    for canonical, aliases in DICTIONARY:
        for t in [canonical, *aliases]:
            terms.setdefault(t.lower(), canonical)
    low, out = text.lower(), {}
    for t, canonical in terms.items():
        for m in re.finditer(f"(?={re.escape(t)})", low):
            before = low[m.start() - 1] if m.start() else " "
            after = low[m.start() + len(t)] if m.start() + len(t) < len(low) else " "
            word = r"[a-zA-Z0-9+#.]"
            if t[-1] in "+#":
                ok = not re.match(r"[A-Za-z0-9_]", before)
            else:
                ok = not re.match(word, before) and not re.match(word, after)
            if ok:
                n, first = out.get(canonical, (0, 10**9))
                out[canonical] = (n + 1, min(first, m.start()))
    return {c: n for c, (n, _) in out.items()}


def found(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {i: {} for i in range(len(texts))}
    for r in skills.match_terms(df, "id", "t", dictionary(spark)).collect():
        got[r.id][r.canonical] = r.occurrences
    return [got[i] for i in range(len(texts))]


def test_skill_golden(spark):
    cases = {
        "Built APIs in Node, React, and PostgreSQL": {"Node.js": 1, "React": 1, "PostgreSQL": 1},
        "I use Python.": {}, "CI/CD pipelines": {"CI/CD": 3}, "REST API": {"REST API": 2},
        "C++ and C#": {"C++": 1, "C#": 1}, "c++11, C# dev": {"C++": 1, "C#": 1},
        "React Native": {"React": 1, "Mobile Development": 1}, "JavaScript and .NET": {"JavaScript": 1, "C#": 1},
        "vitest FP&A": {"Testing": 1, "Finance": 1}, "": {},
    }
    assert dict(zip(cases, found(spark, list(cases)))) == cases


def test_skill_random(spark):
    rng = random.Random(5)
    words = ["node", "react", "native", "c++", "c#", ".net", "ci", "cd", "rest", "api", "objective", "c", "fp", "a",
             "py", "kafka", "apache", "gitlab", "x", "c++11", "js", "é", "_", "sql"]
    seps = [" ", "/", "-", "&", ".", ", ", "+", "#", "  ", "\n", "_", ""]
    texts = ["".join(w + rng.choice(seps) for w in rng.choices(words, k=rng.randint(1, 14))) for _ in range(400)]
    assert found(spark, texts) == [by_hand(t) for t in texts]


def test_skill_lists(spark):
    df = spark.createDataFrame([(1, "sql kafka sql react kafka node")], "id int, t string")
    row = skills.skill_lists(skills.match_terms(df, "id", "t", dictionary(spark)), "id").first()
    assert [(s.skill, s.occurrences) for s in row.skills] == [("SQL", 2), ("Kafka", 2), ("React", 1), ("Node.js", 1)]
    names = spark.createDataFrame([(" PY ",), ("zzz",)], "s string")
    assert [r.o for r in skills.canonicalize(names, "s", dictionary(spark), "o").collect()] == ["Python", "zzz"]
    offsets = skills.token_offsets(df, "id", "t").orderBy("offset").limit(3).collect()
    assert [(r.run, r.offset) for r in offsets] == [("sql", 0), ("kafka", 4), ("sql", 10)]


def vectors(spark, n, dim=8, seed=1, clones=0):
    rng = np.random.default_rng(seed)
    mat = rng.standard_normal((n, dim)).astype(np.float32)
    mat[n - clones:] = mat[0]
    return mat, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(mat)], "id int, embedding array<float>")


def nearest_by_hand(mat, k):
    unit = mat.astype(float) / np.linalg.norm(mat.astype(float), axis=1, keepdims=True)
    dist = np.round(1 - unit @ unit.T, 12)
    return {q: sorted((d, i) for i, d in enumerate(row) if i != q)[:k] for q, row in enumerate(dist)}


def as_dict(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.distance, r.item_id))
    return out


def test_match_golden(spark):
    jobs = jobs_table(spark, [
        dict(id="1", embedding=[1.0, 0.0]), dict(id="2", embedding=[1.0, 1.0], salary_max=5),
        dict(id="3", embedding=[0.0, 1.0]), dict(id="4", embedding=[-1.0, 0.0]), dict(id="5"),
        dict(id="6", embedding=[1.0, 0.0], embedding_status="pending")])
    cvs = spark.createDataFrame([("cv", "embedded", [1.0, 0.0]), ("w", "pending", None)],
                                "id string, embedding_status string, embedding array<float>")
    got = match.match(jobs, cvs, "cv", as_of()).collect()
    assert [(r.id, r.score) for r in got] == [("1", 1.0), ("2", 0.707), ("3", 0.0), ("4", -1.0)]
    sk = links(spark, [("2", "Go"), ("3", "Go")], "skill")
    assert [r.id for r in match.match(jobs, cvs, "cv", as_of(), sk, 1, skills=["go"]).collect()] == ["2"]
    assert [r.id for r in match.match(jobs, cvs, "cv", as_of(), salary_min=5).collect()] == ["2"]
    with pytest.raises(LookupError):
        match.match(jobs, cvs, "zz", as_of())
    with pytest.raises(ValueError):
        match.match(jobs, cvs, "w", as_of())


def test_top_k_blocks(spark, monkeypatch):
    mat, df = vectors(spark, 120, clones=40)
    want = nearest_by_hand(mat, 5)
    assert as_dict(match.top_k(df, df, 5, skip_same_id=True)) == want
    # More queries than a block: both sides are cut into cells.
    in_cells = match.top_k(df, df, 5, skip_same_id=True, block=25)
    assert as_dict(in_cells) == want
    plan = in_cells._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    unit = match._unit(list(mat))
    monkeypatch.setattr(match, "MATRIX_CELLS", 1000)
    near = match._best(np.arange(120), unit, np.arange(120), unit, 5, True)
    got = {q: list(zip(g["distance"], g["item_id"])) for q, g in near.groupby("query_id")}
    assert got == want


def test_queue(spark):
    jobs = jobs_table(spark, [dict(id=str(i), title="same" if i < 5 else f"t{i}", embedding_status="pending") for i in range(150)] + [
        dict(id="x", title="xx", embedding_status="failed", embedding_retry_count=6),
        dict(id="y", title="yy", embedding_status="failed", embedding_retry_count=5),
        dict(id="z", title="bad", embedding_status="pending")])
    cvs = spark.createDataFrame([], schemas.CV_PROFILES)
    cache = spark.createDataFrame([], schemas.EMBEDDING_CACHE).unionByName(
        spark.range(1).select(text_key(F.lit("t7 · C")).alias("content_hash"), F.array(F.lit(0.0), F.lit(1.0)).cast(
            "array<float>").alias("embedding"), F.lit("m").alias("model"), F.lit(2).alias("dim"), as_of().alias("created_at")))
    sk = links(spark, [], "skill")

    def make():
        def enc(texts):
            assert len(texts) <= 64
            if any(t.startswith("bad") for t in texts):
                raise embedding.EncodeError("no")
            return np.ones((len(texts), 2))
        return enc

    out = embedding.drain_queue(jobs, sk, cvs, cache, make, as_of(), dim=2)
    s = out.stats.first()
    rows = {r.id: r for r in out.jobs.collect()}
    assert s.processed == 152 and s.cached == 1 and s.embedded + s.failed == 152 and s.failed >= 1
    assert rows["x"].embedding_status == "failed" and rows["x"].embedding_retry_count == 6
    assert rows["z"].embedding_status == "failed" and rows["z"].embedding_retry_count == 1
    assert rows["7"].embedding == [0.0, 1.0] and rows["7"].embedding_status == "embedded"
    again = embedding.drain_queue(out.jobs.where("embedding_status = 'embedded'"), sk, cvs, out.cache, make, as_of(), dim=2)
    assert again.stats.first().processed == 0
    assert out.cache.select("content_hash").distinct().count() == out.cache.count()


def test_encoder(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, "A  b a")], "id int, t string")
    got = {r.id: r.embedding for r in embedding.encode(df, "t", lambda: embedding.hashed_token_encoder(16), 16).collect()}
    assert np.isclose(np.linalg.norm(got[1]), 1) and got[1] == got[3] and not any(got[2])
    wrong = embedding.encode(df, "t", lambda: embedding.hashed_token_encoder(16), 32).select("outcome").distinct().collect()
    assert [r[0] for r in wrong] == ["failed"]
    broken = embedding.encode(df, "t", lambda: (lambda texts: 1 / 0), 32).select("outcome").distinct().collect()
    assert [r[0] for r in broken] == ["error"]


def test_rate_limit(spark):
    t0 = dt.datetime(2026, 8, 1)
    h = dt.timedelta(hours=1)
    times = [t0 + i * dt.timedelta(minutes=1) for i in range(12)] + [t0 + 24.5 * h, t0 + 25.5 * h]
    df = spark.createDataFrame([("k", t) for t in times] + [("other", t0)], "k string, ts timestamp")
    rows = limits.rate_limit(df, "k", "ts").where("k = 'k'").orderBy("ts").collect()
    assert [r.allowed for r in rows] == [True] * 10 + [False] * 2 + [False, True]
    assert [r.remaining for r in rows[:3]] == [9, 8, 7] and rows[12].retry_after_s == 1
    assert rows[10].retry_after_s == 24 * 3600 - 600


def test_rate_limit_hot_keys(spark):
    """Busy keys decided slice by slice agree with the ordered pass, hit by hit."""
    rng = random.Random(11)
    t0 = dt.datetime(2026, 8, 1)
    rows, n = [], 0
    for k, gap in [("busy", 400), ("busier", 60), ("calm", 30000)]:
        now = 0
        for _ in range(600 if k != "calm" else 40):
            now += rng.choice([0, 0, 1, rng.randint(0, gap), rng.randint(0, 10 * gap)])
            rows.append((k, n, t0 + dt.timedelta(seconds=now)))
            n += 1
    df = spark.createDataFrame(rows, "k string, id int, ts timestamp")
    for limit in (1, 4):
        args = dict(limit=limit, window_s=7200, prune_s=9000, tie="id")
        plain = limits.rate_limit(df, "k", "ts", **args).collect()
        sliced = limits.rate_limit(df, "k", "ts", hot_hits=100, **args)
        assert sorted(map(tuple, sliced.select("k", "id", "ts", "allowed", "remaining", "retry_after_s").collect())) == sorted(
            (r.k, r.id, r.ts, r.allowed, r.remaining, r.retry_after_s) for r in plain)


def test_rate_limit_continues(spark):
    """Two runs, the second knowing what the first accepted, decide like one run."""
    rng = random.Random(2)
    t0 = dt.datetime(2026, 8, 1)
    rows = sorted((rng.choice("ab"), i, t0 + dt.timedelta(seconds=rng.randint(0, 60000))) for i in range(300))
    df = spark.createDataFrame(rows, "k string, id int, ts timestamp")
    cut = F.col("ts") < F.lit("2026-08-01 08:00:00").cast("timestamp")
    cols = ["k", "id", "allowed", "remaining", "retry_after_s"]
    args = dict(limit=3, window_s=7200, prune_s=9000, tie="id")
    whole = limits.rate_limit(df, "k", "ts", **args)
    first = limits.rate_limit(df.where(cut), "k", "ts", **args)
    stored = first.where("allowed").select("k", "ts")
    for hot in (10**9, 10):
        second = limits.rate_limit(df.where(~cut), "k", "ts", stored=stored, hot_hits=hot, **args)
        both = first.select(*cols).collect() + second.select(*cols).collect()
        assert sorted(map(tuple, both)) == sorted(map(tuple, whole.select(*cols).collect()))


def test_lockout(spark):
    t0 = dt.datetime(2026, 8, 1, 0, 30)
    times = [t0 + i * dt.timedelta(minutes=5) for i in range(14)]
    df = spark.createDataFrame([("k", t) for t in times + times[:2]], "k string, ts timestamp")
    rows = limits.lockout(df, "k", "ts").orderBy("ts").collect()
    want = [sum(1 for u in times if t - dt.timedelta(hours=1) < u <= t) for t in times]
    assert [r.failures for r in rows] == want and [r.locked for r in rows] == [w > 10 for w in want]
    # Long histories cross many blocks.
    rng = random.Random(4)
    long = sorted({t0 + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 9)) for _ in range(900)})
    rows = limits.lockout(spark.createDataFrame([("k", t) for t in long], "k string, ts timestamp"), "k", "ts", 2)
    got = {r.ts: r.failures for r in rows.collect()}
    assert got == {t: sum(1 for u in long if t - dt.timedelta(hours=1) < u <= t) for t in long}


def test_span_union(spark):
    rng = random.Random(3)
    t0 = dt.datetime(2026, 1, 1)
    rows = []
    for k in range(3):
        for _ in range(200):
            s = t0 + dt.timedelta(minutes=rng.randint(0, 20000))
            rows.append((k, s, s + dt.timedelta(minutes=rng.choice([0, 1, 30, 4000 if k == 0 else 5]))))
    df = spark.createDataFrame(rows, "k int, s timestamp, e timestamp")
    got = {r.k: (r.islands, r.covered_us) for r in spans.span_union(df, "k", "s", "e").collect()}
    for k in range(3):
        islands, covered, reach = 0, 0, None
        for s, e in sorted((s, e) for kk, s, e in rows if kk == k and e > s):
            if reach is None or s > reach:
                islands += 1
            covered += max(0, (e - max(s, reach or s)) // dt.timedelta(microseconds=1))
            reach = max(reach or e, e)
        assert got[k] == (islands, covered)


def test_prompts(spark):
    cvs = spark.createDataFrame([("c1", "Dev", 3.0, [("sql", 2)], NOW)],
                                "id string, target_role string, estimated_years_experience float, "
                                "skills array<struct<skill:string,occurrences:int>>, updated_at timestamp")
    jobs = spark.createDataFrame([("j1", "Sum", NOW)], "id string, summary string, updated_at timestamp")
    ask = spark.createDataFrame([("c1", "j1", "Q?", "m"), (None, None, "Q?", "m"), ("zz", None, "Q?", "m")],
                                "cv_id string, job_id string, message string, model string")
    rows = prompts.with_context(ask, cvs, jobs, "SYS").collect()
    by_cv = {r.cv_id: r for r in rows}
    assert by_cv["c1"].content == ("User CV profile: target role Dev; 3 years experience; skills: sql.\n"
                                   "Referenced job: Sum.\n\nQuestion: Q?")
    assert by_cv[None].content == "Q?" and by_cv["zz"].reject_reason == "cv not found"
    import hashlib
    parts = ["SYS", "m", "Q?", "c1@2026-08-20T00:00:00.000Z", "j1@2026-08-20T00:00:00.000Z"]
    assert by_cv["c1"].prompt_hash == hashlib.sha256("\x1f".join(parts).encode()).hexdigest()
    cache = spark.createDataFrame([(by_cv["c1"].prompt_hash, "hi")], "prompt_hash string, response_text string")
    hit = prompts.cached_replies(prompts.with_context(ask, cvs, jobs, "SYS"), cache)
    assert sorted((str(r.cv_id), r.response_text) for r in hit.collect()) == [("None", None), ("c1", "hi"), ("zz", None)]


def test_hot_keys(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(9000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = skew.join_per_key(rows, table, "k")
    assert joined.count() == 9000 and joined.where("v != k * 2 or v is null").count() == 0
    marked = skew.first_per_key(rows, ["k"], ["id"])
    firsts = marked.where("is_first")
    assert firsts.count() == rows.select("k").distinct().count()
    assert firsts.where("k = 0").first().id == 0
    nulls = rows.withColumn("k", F.when(F.col("k") != 0, F.col("k")))
    assert skew.join_per_key(nulls, table, "k").count() == 9000


def test_small_blocks_do_not_copy_a_side_for_each(spark):
    """How often a side is copied follows from the size of the other side's strips, not from ``block``."""
    mat = np.random.default_rng(5).integers(-3, 4, (2000, 4)).astype(float)  # many equal distances, some zero vectors
    df = spark.createDataFrame([(n % 1990, [float(x) for x in v]) for n, v in enumerate(mat)], "id long, embedding array<double>")
    assert match._strips(df.withColumnRenamed("embedding", "_vec"), 5, match.ITEM_STRIP, 8) == 6
    assert match._strips(df.withColumnRenamed("embedding", "_vec"), 5, 800, 8) == 10
    rows = {tuple(r) for r in match.top_k(df, df, 3, skip_same_id=True, block=5).collect()}
    assert rows == {tuple(r) for r in match.top_k(df, df, 3, skip_same_id=True).collect()}
    unit = match._unit(list(mat))
    dist = np.round(1.0 - unit @ unit.T, match.TIE_DIGITS)
    ids = np.arange(2000) % 1990
    for q in (0, 7, 1989):
        near = sorted((d, int(i)) for r in np.flatnonzero(ids == q) for d, i in zip(dist[r], ids) if np.isfinite(d) and i != q)[:3]
        assert sorted((r[3], r[1], r[2]) for r in rows if r[0] == q) == [(n + 1, i, d) for n, (d, i) in enumerate(near)]


def test_keyed_joins_broadcast_small_tables_only(spark):
    """A large table never goes whole to every task, however few bytes its files have."""
    def plan(n):
        table = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        joined = skew.join_per_key(spark.range(200).select(F.col("id").alias("k")), table, "k")
        assert joined.where("v = k * 2").count() == min(n, 200)
        return joined._jdf.queryExecution().sparkPlan().toString()

    assert "SortMergeJoin" in plan(120_000) and "BroadcastHashJoin" not in plan(120_000)
    assert "BroadcastHashJoin" in plan(150)


def test_cache_hits(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a")], "id int, h string")
    got = prompts.cache_hits(df, "h", ["id"]).orderBy("id").collect()
    assert [r.cached for r in got] == [False, False, True, True]


def test_usage(spark):
    df = spark.createDataFrame([(i, "u" if i % 2 else "v", NOW + dt.timedelta(seconds=i)) for i in range(120)],
                               "id int, user_key string, created_at timestamp")
    assert prompts.usage_log(df).count() == 100 and prompts.usage_log(df, "u").count() == 50


def test_stored_hits_between_new_hits_of_hot_keys(spark):
    hour = lambda h: f"2024-01-01 {h:02d}:00:00"
    make = lambda rows: spark.createDataFrame(rows, "k string, s string").select("k", F.to_timestamp("s").alias("t"))
    hits, stored = make([("a", hour(0)), ("a", hour(1)), ("b", hour(10))]), make([("b", hour(5)), ("b", hour(6))])
    for hot in (10**9, 0):
        got = {(r["k"], str(r["t"])): r["allowed"] for r in limits.rate_limit(
            hits, "k", "t", limit=2, stored=stored, hot_hits=hot).collect()}
        assert list(got.values()).count(False) == 1 and not got[("b", hour(10))]


def test_limit_reads_leading_digits():
    assert [search.clamp_limit(x) for x in ("20abc", "7.9", " 8", "abc", 7.9)] == [20, 7, 8, 20, 7]


def test_streams_do_not_depend_on_chunks(spark, tmp_path):
    """One key's rows in descending order, more than fit a chunk, then a second file with a row that comes late."""
    t0, n = dt.datetime(2026, 8, 1), 30_000
    first = spark.range(n).select(F.lit("k").alias("k"), F.timestamp_seconds(
        F.unix_seconds(F.lit(t0)) + 60 + n - F.col("id")).alias("ts")).coalesce(1)
    late = spark.createDataFrame([("k", t0 + dt.timedelta(seconds=s)) for s in (n + 90, 30)], first.schema).coalesce(1)
    source = str(tmp_path / "in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(build, name):
        rows = spark.readStream.schema(first.schema).parquet(source)
        query = (build(rows).writeStream.format("parquet").option("path", str(tmp_path / name / "out"))
                 .option("checkpointLocation", str(tmp_path / name / "cp")).trigger(availableNow=True).start())
        query.awaitTermination()
        return sorted(spark.read.parquet(str(tmp_path / name / "out")).collect(), key=lambda r: r.ts)

    runs = {"rate": lambda r: stream_limits.rate_limit_stream(r, "k", "ts", limit=3, window_s=100, prune_s=100),
            "lock": lambda r: stream_limits.lockout_stream(r, "k", "ts", 5, 3600),
            "cache": lambda r: stream_limits.cache_hits_stream(r, "k", "ts")}
    for batch in (first, late):
        batch.write.mode("append").parquet(source)
        got = {name: run(build, name) for name, build in runs.items()}
    at = lambda r: int((r.ts - t0).total_seconds())
    rate = [r for r in got["rate"] if at(r) > 60]
    want = limits.rate_limit(first, "k", "ts", limit=3, window_s=100, prune_s=100).orderBy("ts").collect()
    assert len(got["rate"]) == n + 2 and [r.allowed for r in rate[:n]] == [r.allowed for r in want]
    lock = [(at(r), r.locked) for r in got["lock"]]
    assert lock[0] == (30, False) and lock[-1] == (n + 90, True)
    assert [locked for _, locked in lock[1:n + 1]] == [False] * 5 + [True] * (n - 5)
    cache = [(at(r), r.cached) for r in got["cache"]]
    assert cache[:2] == [(30, True), (61, False)] and all(c for _, c in cache[2:])


def test_broadcast_counts_rows_and_bytes(spark):
    df = spark.createDataFrame([(1, "ab", ["x"], None), (2, None, None, 1.0)], "id int, t string, `a.b` array<string>, d double")
    assert is_small(df) and is_small(df, 2) and not is_small(df, 1) and is_small(df.limit(0), 0)
    assert not is_small(df, max_bytes=60) and is_small(df, max_bytes=100)
    plan = broadcast_if_small(df).join(df, "id")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


def test_stream_state_expires_and_starts_from_the_store(spark, tmp_path):
    """Days far apart: timers drop the states of callers not seen any more; decisions equal the batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t0 = dt.datetime(2026, 8, 1)
    hits = [(f"u{i % 40 + day * 30}", t0 + dt.timedelta(days=3 * day, seconds=i * 7)) for day in range(4) for i in range(200)]
    every = spark.createDataFrame(hits, "k string, ts timestamp")
    stored, new = every.where("ts < '2026-08-04'"), every.where("ts >= '2026-08-04'")
    before = limits.rate_limit(stored, "k", "ts", limit=3).where("allowed").select("k", "ts")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = []
    for day in (4, 7, 10):
        new.where(f"day(ts) = {day}").coalesce(1).write.mode("append").parquet(source)
        stream = stream_limits.rate_limit_stream(spark.readStream.schema(every.schema).parquet(source), "k", "ts", limit=3,
                                                 stored=before, grace_s=3600)
        query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        rows.append(states[-1])
    got = {(r.key, r.ts): (r.allowed, r.remaining, r.retry_after_s) for r in spark.read.parquet(out).collect()}
    want = {(r.k, r.ts): (r.allowed, r.remaining, r.retry_after_s)
            for r in limits.rate_limit(new, "k", "ts", limit=3, stored=before).collect()}
    assert got == want and len(got) == 600
    assert rows[1] <= rows[0] and rows[2] <= rows[0], rows  # no state left of the callers of earlier days

    seen = spark.createDataFrame([("a", t0), ("b", t0)], "k string, ts timestamp")
    asked = spark.createDataFrame([("a", t0 + dt.timedelta(hours=1)), ("b", t0 + dt.timedelta(hours=9)), ("c", t0),
                                   ("b", t0 + dt.timedelta(hours=10))], "k string, ts timestamp")
    asked.coalesce(1).write.parquet(str(tmp_path / "asked"))
    replies = stream_limits.cache_hits_stream(spark.readStream.schema(asked.schema).parquet(str(tmp_path / "asked")), "k", "ts",
                                              stored=seen, keep_s=4 * 3600, grace_s=86_400)
    query = (replies.writeStream.format("memory").queryName("replies").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted((r.key, r.ts.hour, r.cached) for r in spark.table("replies").collect()) == [
        ("a", 1, True), ("b", 9, False), ("b", 10, True), ("c", 0, False)]


def test_parts_are_isolated_by_halves():
    from rolemill.plans.isolation import isolate, message_of

    def run(group):
        for name in group:
            if name in ("c", "k"):
                raise ValueError(f"{name} is broken")
        return list(group)

    found = isolate(list("abcdefghijklm"), run)
    assert sorted(sum(found.results, [])) == list("abdefghijlm")
    assert found.failed == {"c": "c is broken", "k": "k is broken"} and found.attempts <= 2 * 2 * 5
    assert isolate(["x"], run).attempts == 1 and isolate([], run).results == []
    assert message_of(ValueError("")) == "ValueError"
    trace = 'Job aborted\nTraceback (most recent call last):\n  File "x.py", line 1, in f\nKeyError: \'gone\'\n'
    assert message_of(RuntimeError(trace)) == "KeyError: 'gone'"

"""Operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rolemill.llm.graph import components
from rolemill.llm import blocks, jaccard
from rolemill.llm.jaccard import JaccardJoin
from rolemill.llm.language_id import fit, identify
from rolemill.llm.language_model import score_texts
from rolemill.llm.mixing import mix_sources, poisson_steps, repetition_rates
from rolemill.llm.substring import remove_repeats
from rolemill.llm.token_counts import count_tokens
from rolemill.llm.topk import top_k
from rolemill.llm.vectors_near import near_vectors
from rolemill.llm.warc import archive
from rolemill.llm.words import Words
from rolemill.plans.session import BATCH_CONF, materialize

SPACES = rb"[\x20\x09-\x0d]+"
SCHEMA = "doc_id long, text string, n_words string, score string"  # the last two clash with added columns


def words(text, lower=False):
    raw = (text or "").encode()
    if lower:
        raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw)
    return [w for w in re.split(SPACES, raw) if w]


@pytest.fixture(scope="module")
def docs():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "漢字", "A b"]
    shared = [r.choice(vocabulary) for _ in range(60)]
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "One"), (5, "a b c"), (6, "x " * 400), (7, "p q r " * 60)]
    for i in range(40):
        own = [r.choice(vocabulary) + str(r.randrange(30)) for _ in range(r.choice([2, 6, 7, 30, 90]))]
        out += [(100 + 4 * i, " ".join(own)), (101 + 4 * i, "\t".join(own)),
                (102 + 4 * i, " ".join([*own[:3], *shared[:r.choice([20, 40, 60])], *own[3:]]))]
        own[r.randrange(len(own))] = "other"
        out.append((103 + 4 * i, " ".join(own)))
    return out + [(999, " ".join(f"v{i % 977}" for i in range(30000)))] + out[:20]


@pytest.fixture(scope="module")
def table(spark, docs):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in docs], SCHEMA).repartition(3)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_words_and_hashes():
    w = Words(pa.array(["a  b\tc", None, "", " é x", " "]))
    assert w.counts().tolist() == [3, 0, 0, 2, 0]
    assert len(set(w.hashes().tolist())) == 5
    assert Words(pa.array(["q r", "r"])).hashes()[1] == Words(pa.array(["q r", "r"])).hashes()[2]


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


@pytest.mark.parametrize("n", [16, 64, 256, 1024, 4096])
def test_words_made_to_collide(n):
    """A Thue-Morse word and its complement are equal under any polynomial modulo a power of two."""
    word = thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    w = Words(pa.array([word, other, word + "b", f"{word} {other}", word[:-1], "a", "ab", "é" * n]))
    for seed in (1, 3, 4, 21, 61):
        found = w.hashes(seed).tolist()
        assert found[0] == found[3] and found[1] == found[4] and len(set(found)) == 7


def test_words_made_to_collide_stay_apart(spark):
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, word), (2, other), (3, f"{word} {rest}"), (4, f"{other} {rest}")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in JaccardJoin(docs.where("doc_id < 3")).result().collect()} == {1: 1, 2: 2}
    assert all(r["n_removed"] == 0 for r in remove_repeats(docs).collect())


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(texts, window):
    seen = Counter()
    for t in texts:
        w = words(t)
        seen.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = []
    for t in texts:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window, phrase", [(35, 8), (5, 5), (9, 2)])
def test_substring(table, docs, window, phrase):
    got = rows(remove_repeats(table, window=window, phrase=phrase), "doc_id", "n_words", "n_removed", "kept_text", "score")
    want = [(i, n, g, kept.decode(), "y") for (i, _), (n, g, kept) in zip(docs, removed([t for _, t in docs], window))]
    assert got == sorted(want, key=repr)
    digest = remove_repeats(table, window=window, phrase=phrase, digest=True)
    assert "text" not in digest.columns
    assert {r["kept_sha256"] for r in digest.collect()} == {hashlib.sha256(w[3].encode()).hexdigest() for w in want}


def brute_components(docs, k, percent):
    sets = [frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) if (w := words(t, True)) else frozenset()
            for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in where[g] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 60)
    for i in range(len(docs)):
        least[find(i)] = min(least[find(i)], docs[i][0])
    return [(docs[i][0], len(s), least[find(i)]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k, percent", [(4, 85), (2, 60)])
def test_jaccard(table, docs, k, percent):
    join = JaccardJoin(table, shingle=k, percent=percent)
    want = brute_components(docs, k, percent)
    assert rows(join.result(), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    kept = join.representatives()
    assert kept.columns == table.columns
    groups = {c for i, n, c in want if n}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([*groups, *(i for i, n, _ in want if not n)])


class Counted(JaccardJoin):
    """Counts the rows of pairs that shards of regions make."""

    def _in_regions(self, left):
        pairs = super()._in_regions(left)
        self.open, self.pairs = left.count(), pairs.count()
        return pairs


def test_regions_of_a_template_make_no_square_of_pairs(spark):
    r = random.Random(8)
    word = lambda: f"w{r.randrange(10 ** 6)}"
    template = [word() for _ in range(120)]
    docs = [(i, " ".join(template + [word() for _ in range(60)])) for i in range(150)]
    twins = [(500 + i, " ".join([*text.split()[:-2], "other", "end"])) for i, text in docs[:5]]
    join = Counted(spark.createDataFrame(docs + twins, "doc_id long, text string").repartition(3))
    want = brute_components(docs + twins, 4, 85)
    assert rows(join.result(), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    assert join.open == 0 and join.pairs == 0  # 155 * 154 / 2 pairs share the template's regions


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80), (1, 50)])
def test_copies_at_all_distances(spark, k, percent):
    r = random.Random(percent)
    word = lambda: f"w{r.randrange(3000)}"
    docs = []
    for _ in range(3):
        at = [[word() for _ in range(150)]]
        for i in range(70):  # copies of the text or of a copy, with none to 30 words changed, some with a rest
            copy = list(at[0] if i % 2 else r.choice(at))
            for _ in range(r.choice([0, 1, 2, 4, 6, 8, 12, 30])):
                copy[r.randrange(len(copy))] = word()
            at.append(copy + [word() for _ in range(r.choice([0, 0, 4, 15]))])
            docs.append((len(docs), " ".join(at[-1])))
    join = Counted(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), shingle=k, percent=percent)
    want = brute_components(docs, k, percent)
    assert rows(join.result(), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    assert join.open > 0


def test_lone_shingles():
    def entry(roots, tokens, at):
        return np.int64(len(roots)).tobytes() + np.array(roots, np.int64).tobytes() + np.array(
            tokens, np.uint32).tobytes() + np.array(at, np.uint32).tobytes()

    got = jaccard._lone([entry([7], [1, 2, 3], [0, 0, 0]), entry([7, 9, -1], [3, 2, 4, 5], [0, 1, 2, 1])])
    assert [np.unpackbits(np.frombuffer(g, np.uint8), count=n).tolist() for g, n in zip(got, (3, 4))] == [[1, 0, 1], [1, 0, 0, 1]]


def test_tasks_take_wide_rows_a_few_at_a_time(spark):
    wide = spark.range(40, numPartitions=1).select("id", F.randstr(F.lit(1 << 20), F.lit(5)).alias("text"))
    packed = blocks.pack(wide, "text")
    groups = [g for f in packed.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file:")).metadata]
              for g in (m.row_group(i).total_byte_size for i in range(m.num_row_groups))]
    assert sum(groups) > 3 * blocks.ROW_GROUP and max(groups) < 2 * blocks.ROW_GROUP

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["size"])

    got = materialize(wide.mapInArrow(sizes, "size long"), "sizes", batch_bytes=blocks.BATCH_BYTES)
    assert got.agg(F.max("size")).first()[0] < 2 * blocks.BATCH_BYTES
    assert spark.conf.get(BATCH_CONF, None) is None


def test_texts_are_opened_a_few_megabytes_at_a_time(monkeypatch):
    texts = pa.array(["a b c d e f", None, "", "x y", "a b c d e " * 50, "b c d e"])
    want, bodies, taken = jaccard.shingle_sets(texts, 4), jaccard._squeezed(texts), []
    take = lambda part, k, f=jaccard.shingle_sets: taken.append(len("".join(part.to_pylist()))) or f(part, k)
    monkeypatch.setattr(jaccard, "TEXT_AT_ONCE", 20)
    assert jaccard._bytes_of(bodies).tolist() == [11, 0, 0, 3, 500, 7]
    assert all(map(np.array_equal, jaccard._text_sets(texts, 4), want))
    monkeypatch.setattr(jaccard, "shingle_sets", take)
    assert all(map(np.array_equal, jaccard._opened(bodies, 4), want))
    assert taken == [14, 500, 7]


def test_representatives_follow_links_not_ids(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(40))
    data = [(1, text("x")), (1, text("y")), (2, text("y")), (3, text("y") + " end"), (None, text("z")), (None, text("z")),
            (None, text("z") + " end"), (None, text("u")), (7, text("v")), (None, text("v")), (1, None), (1, "")]
    kept = JaccardJoin(spark.createDataFrame(data, "doc_id long, text string").coalesce(1)).representatives()
    want = [data[i] for i in (0, 1, 4, 7, 8, 10, 11)]
    assert rows(kept, "doc_id", "text") == sorted(want, key=repr)


def test_token_counts(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    some = [*docs, (-1, "a<|endoftext|>b <|startoftext|>  x'S 'll don't é ́e ΣΣ   ẞ ١٢٣ 😀😀"), (-2, "x" * 50000)]
    library = Tokenizer.from_file(path)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 30)
            for i, t in some]
    got = count_tokens(spark.createDataFrame(some, "doc_id long, text string"), path, limit=30, batch_bytes=200)
    assert rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_token_counts_that_keep_white_space(spark, docs, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import AddedToken, Tokenizer

    from rolemill.llm.token_counts import drops_spaces

    path = public_tokenizers.path("byte_bpe_50k.json")
    spaced = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    spaced.add_special_tokens([AddedToken("two words", special=True)])
    spaced.save(str(tmp_path / "spaced.json"))
    assert drops_spaces(public_tokenizers.path("word_bpe_49k.json"))
    some = [*docs[:60], (-1, " a  b\n\n\tc  <|endoftext|> two words "), (-2, "x y " * 9000), (-3, "   ")]
    for file in (path, str(tmp_path / "spaced.json")):
        library = Tokenizer.from_file(file)
        want = [(i, n := len(library.encode(t or "", add_special_tokens=False).ids), n > 30) for i, t in some]
        got = count_tokens(spark.createDataFrame(some, "doc_id long, text string"), file, limit=30, batch_bytes=200)
        assert not drops_spaces(file) and rows(got, "doc_id", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_archive(spark):
    pages = [(1, "http://a/\r\nX: y", "same"), (5, None, "same"), (3, "u", "same"), (2, "u", None), (4, "u", ""),
             (None, "u", "same"), (6, "é", "é\r\n\r\nWARC/1.1"), (6, "z", "é\r\n\r\nWARC/1.1")]
    got = archive(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == 4) == [
        (0, "revisit", 5), (1, "revisit", 5), (3, "revisit", 5), (5, "response", None)]
    assert sorted((r["page_id"], r["record_type"]) for r in got if r["payload_bytes"] == 0) == [(2, "revisit"), (4, "response")]
    assert sorted(r["record_type"] for r in got if r["page_id"] == 6) == ["response", "revisit"]
    one = next(r for r in got if r["page_id"] == 5)
    head, body = bytes(one["record"]).split(b"\r\n\r\n", 1)
    assert body == b"same\r\n\r\n" and b"Content-Length: 4" in head and b"\r\nX:" not in head
    import base64
    assert one["payload_digest"] == base64.b32encode(hashlib.sha1(b"same").digest()).decode()


def test_top_k(spark):
    r = random.Random(2)
    data = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(150)]
    data += [(200 + i, data[i][1]) for i in range(30)] + [(300, None), (310, [math.nan] * 8), (320, [None] * 8), (330, [])]
    q = {i: np.floor(1024 * np.array(v)) for i, v in data if v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for i in q:
        if i % 10 == 0:
            best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:7]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for rows_per_block, queries_per_block in ((4096, 1024), (20, 3), (4, 100)):
        got = top_k(df, F.col("vec_id") % 10 == 0, 7, rows_per_block=rows_per_block, queries_per_block=queries_per_block)
        assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_near_vectors(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(12, 16))
    data = [(i, (base[i % 12] + 0.25 * r.normal(size=16)).tolist(), int(i % 12 > 5) if i % 9 else None) for i in range(120)]
    data += [(200 + i, data[i][1], data[i][2]) for i in range(20)] + [(300, None, 1), (301, [0.0] * 16, 1), (302, [math.nan] * 16, 1)]
    ok = {i for i, v, c in data if v and c is not None and all(map(math.isfinite, v)) and any(v)}
    links = defaultdict(set)
    at = {i: (np.array(v), c) for i, v, c in data if i in ok}
    for i in ok:
        for j in ok:
            (a, c), (b, d) = at[i], at[j]
            if i < j and c == d and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93:
                links[i].add(j)
                links[j].add(i)

    def lowest(i):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    want = sorted(((i, len(links[i]), lowest(i), lowest(i) == i) for i, _, _ in data), key=repr)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    assert sum(map(len, links.values())) > 100
    for tile in (2048, 7):
        assert rows(near_vectors(df, tile=tile), "vec_id", "n_links", "component_id", "kept") == want


def test_mixing(spark):
    r = random.Random(6)
    data = [(i, "x" * r.randrange(0, 50), None if i % 7 == 0 else f"s{i % 3}", "c") for i in range(600)] + [(3, "y", "s0", "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, copy string")
    rates = {x["source"]: x["rate"] for x in repetition_rates(df, {"s0": 2.0, "s1": 1.0}, epochs=2.0).collect()}
    sizes = Counter()
    for _, t, s, _ in data:
        sizes[s] += len(t)
    assert rates[None] == rates["s2"] == 0.0
    assert math.isclose(rates["s0"] * sizes["s0"], 2 * sum(sizes.values()) * 2 / 3)
    steps = spark.range(1).select(poisson_steps(F.lit(3.5)).alias("s")).first()["s"]
    exact, p = [], math.exp(-3.5)
    for k in range(len(steps)):
        exact.append((exact[-1] if exact else 0) + p)
        p *= 3.5 / (k + 1)
    assert np.allclose(steps, exact, rtol=1e-12)
    mixed = mix_sources(df, {"s0": 2.0, "s1": 1.0}, epochs=2.0)
    found = rows(mixed, "doc_id", "copy", "source")
    assert {s for _, _, s in found} == {"s0", "s1"}
    count = Counter((i, s) for i, _, s in found)
    for (i, _), n in count.items():
        u = int(hashlib.md5(f"mix-1|{i}".encode()).hexdigest()[:13], 16) / 2 ** 52
        each = sum(c <= u for c in spark_steps(spark, rates[data[i][2]]))
        assert n == each * (2 if i == 3 else 1)


def test_mixing_without_ids_and_at_high_rates(spark):
    """Rows without an id draw one by one, equal ones too; a rate beyond the table of steps is a sum of draws."""
    data = [(None, f"text {i % 2000}", "s") for i in range(4000)] + [(None, None, None)] * 3 + [(5, "x", "t")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    for seed in ("mix-1", "mix-2"):
        mixed = mix_sources(df, {"s": 1.0}, seed=seed)
        n = mixed.count()
        assert abs(n - 4000) < 6 * 4000 ** 0.5, n
        per_text = Counter(r["text"] for r in mixed.collect())
        assert len(per_text) > 1500  # most texts have a copy, none all of them
    one = spark.createDataFrame([(i, "abcd", "small") for i in range(20)] + [(100 + i, "y" * 1000, "large") for i in range(200)],
                                "doc_id long, text string, source string")
    rate = {r["source"]: r["rate"] for r in repetition_rates(one, {"small": 1.0}).collect()}["small"]
    copies = Counter(r["doc_id"] for r in mix_sources(one, {"small": 1.0}).select("doc_id").collect())
    assert rate > 2000 and len(copies) == 20
    assert all(abs(n - rate) < 6 * rate ** 0.5 for n in copies.values()) and len(set(copies.values())) > 10
    # The draws of one document add up to a Poisson number: parts of equal mean, each from a hash of its own.
    parts = math.ceil(rate / 500)
    steps = spark_steps(spark, rate / parts)
    u = [int(hashlib.md5(f"mix-1|3|{i}".encode()).hexdigest()[:13], 16) / 2 ** 52 for i in range(1, parts + 1)]
    assert copies[3] == sum(sum(c <= x for c in steps) for x in u)


def test_letters_by_category():
    from rolemill.llm.language_id import has_letter

    assert not any(map(has_letter, ["", "½ ² ① 12 _ .", "٣", "\u0301"]))
    assert all(map(has_letter, ["½a", "é", "漢", "ª", "½½½½ß"]))


def spark_steps(spark, rate, known={}):  # noqa: B006
    if rate not in known:
        known[rate] = spark.range(1).select(poisson_steps(F.lit(rate)).alias("s")).first()["s"]
    return known[rate]


def test_language_model(table, docs):
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 0
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6))
                  for r in score_texts(table, F.crc32(F.col("doc_id").cast("string")) % 3 != 0).collect()), key=repr)
    tokens = [(i, [*words(t, True), None]) for i, t in docs]
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, len(ws), sum(counts[w] > 0 for w in ws), n,
                    round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in tokens), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], atol=1e-5)
    assert all(g[5] < 0 for g in got)
    assert sum(g[5] for g in got) > sum(g[4] for g in got)  # the pair model explains the texts better


def test_language_id(spark):
    r = random.Random(8)
    make = {"aa": "lorem ipsum dolor sit amet", "bb": "zwölf boxkämpfer jagen viktor quer", "cc": "être où garçon déjà naïve"}
    data = [(i, " ".join(r.choice(make[c].split()) for _ in range(r.choice([3, 30]))), c)
            for i, c in enumerate(r.choice(list(make)) for _ in range(300))]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "123 !!", None), (903, "lorem", None), (904, "dolor sit " * 30000, None)]
    df = spark.createDataFrame(data + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = fit(df, F.col("doc_id") % 4 != 2)
    got = {x["doc_id"]: x for x in identify(df, model).collect()}
    held = [x for x in data if x[0] % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == c for i, _, c in held]) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0 for i in (900, 901, 902))
    assert got[904]["lang_pred"] == "aa" and 0 <= got[904]["score"] <= 1
    assert sum(got[i]["rejected"] for i, _, _ in data) < 15
    assert fit(df.where("false"), F.lit(True)) is None


def test_language_id_rejects_what_it_has_not_learned(spark):
    r = random.Random(12)
    make = {"aa": "lorem ipsum dolor sit amet tempor magna", "bb": "zwölf boxkämpfer jagen viktor quer über den deich"}
    text = lambda words_: " ".join(r.choice(words_.split()) for _ in range(r.choice([8, 30, 90])))
    data = [(i, text(make[c]), c) for i, c in enumerate(r.choice(list(make)) for _ in range(600))]
    junk = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(n)) for n in (30, 300, 3000) for _ in range(30)]
    junk += [text("kaikki ihmiset syntyvät vapaina tasavertaisina oikeuksiltaan") for _ in range(30)]
    junk += [text("все люди рождаются свободными") for _ in range(30)]
    df = spark.createDataFrame(data + [(1000 + i, t, "zz") for i, t in enumerate(junk)], "doc_id long, text string, lang string")
    for learned in (["aa", "bb"], ["aa"]):
        model = fit(df.where(F.col("lang").isin(learned)), F.col("doc_id") % 4 != 2)
        assert len(learned) == 1 or model.least > 1 / len(learned)
        got = {x["doc_id"]: x["rejected"] for x in identify(df, model).collect()}
        assert all(got[1000 + i] for i in range(len(junk)))
        held = [got[i] for i, _, c in data if i % 4 == 2 and c in learned]
        assert sum(held) <= len(held) // 50


def test_language_sample_is_bounded(spark, monkeypatch):
    from rolemill.llm import language_id

    monkeypatch.setattr(language_id, "train_model", lambda examples: examples)
    data = [(i, f"text number {i} " * 5, f"l{i % 3}") for i in range(1500)] + [
        (-d, f"copy {d} of the same " * 5, "l0") for d in range(1, 30) for _ in range(25)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    for given, each in (({"sample": 50}, 50), ({"sample": 50, "most": 60}, 20), ({}, None)):
        got = fit(df, F.lit(True), **given)
        count = Counter(name for name, _, _ in got)
        assert count == {f"l{i}": 2 * (each or (529 if i == 0 else 500)) for i in range(3)}
    with pytest.raises(ValueError):
        fit(df, F.lit(True), most=2)


def test_pieces(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    from rolemill.llm.pieces import PieceModel, StreamingEncoder, encode_texts

    path = public_tokenizers.path("piece_bpe_32k.model")
    r = random.Random(9)
    texts = [None, "", " ", "\x00", "a" * 3000, " " * 100, "漢字 é\n\n\tfoo  bar", "<s> </s> <0x0A>", "😀 x"]
    texts += ["".join(r.choice("abcdet  hnou\n.é漢") for _ in range(r.randrange(1, 300))) for _ in range(200)]
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {x["doc_id"]: x for x in encode_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == library.encode(t or "") and got[i]["n_ids"] == len(got[i]["ids"])
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    model = PieceModel(path)
    for t in texts[4:]:
        stream, ids, at = StreamingEncoder(model), [], 0
        while at < len(t):
            step = r.randrange(1, 400)
            ids += stream.feed(t[at:at + step])
            at += step
        assert ids + stream.finish() == library.encode(t) and stream.widest < 800


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert remove_repeats(docs).count() == 0
    assert JaccardJoin(docs).result().count() == 0
    assert score_texts(docs, F.lit(True)).count() == 0
    assert mix_sources(docs).count() == 0
    assert identify(docs, fit(docs, F.lit(True))).count() == 0
    assert top_k(vectors, F.lit(True)).count() == 0
    assert near_vectors(vectors).count() == 0
    assert archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_and_queries(spark):
    import corpus_pipeline
    from rolemill.llm.queries import QUERIES

    docs = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t)) for i, t in enumerate(
        " ".join(random.Random(i // 2).choice(["the", "cat", "sat", "on", "mats"]) + str(random.Random(j).randrange(9))
                 for j in range(i // 2 * 7, i // 2 * 7 + 50)) for i in range(30))]
    df = spark.createDataFrame(docs + [(99, "...", "en", "s0", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns, name
        if name == "language_id":
            assert sorted(r["doc_id"] for r in out.collect()) == list(range(30))
        if name == "ngram_jaccard_join":
            assert out.count() <= 15
        df = spark.createDataFrame(out.collect(), df.schema)
    assert len([q for q in QUERIES if q.startswith("op")]) == 13


@pytest.mark.parametrize("percent", [55, 85, 97])
def test_linked_sets_share_regions(percent):
    rng = np.random.default_rng(percent)
    for _ in range(150):
        n = int(rng.integers(1, 400))
        both = rng.integers(0, 1 << 63, n).astype(np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n * (100 - percent) // percent)))
                                          .astype(np.uint64)))) for _ in range(2))
        text, found = np.repeat([0, 1], [len(a), len(b)]), np.concatenate((a, b))
        sizes = np.array([len(a), len(b)])
        signature, who, above, filled = jaccard.signatures(text, found, sizes, percent)
        facts = (np.array([5, 9]), np.array([5, 9]), sizes, *filled.astype(np.int32),
                 jaccard._coarse(text, found, 2))
        entry = np.int64(2).tobytes() + b"".join(x.tobytes() for x in facts) + signature.tobytes() + (
            2 * who + above).astype(np.uint32).tobytes()
        got = jaccard._across([entry], percent).to_pylist()
        inter = len(np.intersect1d(a, b))
        if 100 * inter >= percent * (len(a) + len(b) - inter):
            assert len(got) == 1 and got[0]["a"] == 5 and got[0]["b"] == 9 and got[0]["agree"] >= got[0]["need"]

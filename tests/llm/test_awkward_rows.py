"""Awkward rows for every stage of the pipeline, and operators whose added columns are there already or whose table is empty."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from rolemill.llm import stages
from rolemill.llm.licenses import BASE, EVIDENCE, NOTICES, license_digest, scan_licenses
from rolemill.llm.pieces import encode_texts
from rolemill.llm.token_counts import count_tokens
from rolemill.llm.topk import top_k
from rolemill.llm.vectors_near import near_vectors
from rolemill.llm.warc import archive
from tests_llm_words import places

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copy string, score double, ids string, n_words string"
ENGLISH = "the cat sat on the mat and the dog ran over the green hill to see what the other cats were doing there today "
GERMAN = "der hund lief \u00fcber die gr\u00fcne wiese und die katze sah ihm dabei zu w\u00e4hrend der regen auf das dach des hauses fiel "


def documents(spark):
    rows = []
    for i in range(60):
        body = (ENGLISH if i % 2 else GERMAN).split()
        rows.append((i, " ".join(body[i % 7:] + [f"w{i}x{j}" for j in range(i % 5 * 10)]), "en" if i % 2 else "de", f"s{i % 3}"))
    rows += [(100, None, "en", "s0"), (101, "", None, "s0"), (102, " \n ", "de", None), (103, None, None, None), (None, ENGLISH * 2, "en", "s1"),
             (None, None, None, "s1"), (104, "\u00bd 123 ...", "en", "s2"), (105, ENGLISH * 900, "en", "s2")] + rows[:6] + rows[:1] * 3
    return spark.createDataFrame([(*r, 1, "kept", 0.5, "ids", "n") for r in rows], DOCS).repartition(3)


@pytest.mark.parametrize("name", ["keep_identified", "keep_one_of_each_group", "cut_repeats", "mix_to_weights", "encode"])
def test_stage(spark, name):
    docs, stage = documents(spark), getattr(stages, name)
    out = stage(spark, docs, "")
    rows = out.collect()
    before = Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect())
    after = Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows)
    empty = stage(spark, docs.where("false"), "")
    assert empty.columns == out.columns and empty.count() == 0
    if name == "encode":
        assert after == before and all(len(r["ids"]) == r["n_ids"] for r in rows)
        assert {r["n_ids"] for r in rows if not r["text"]} == {0}
        return
    assert out.columns == docs.columns
    assert name == "mix_to_weights" or {r["copy"] for r in rows} == {"kept"}  # mixing adds a column of that name
    if name == "keep_identified":
        assert not set(after) - set(before) and all(before[x] == n for x, n in after.items())
        assert not any(t is None or not any(c.isalpha() for c in t) for _, t, _, _ in after)
        assert sum(after.values()) >= 0.9 * sum(n for (_, t, _, _), n in before.items() if t and any(c.isalpha() for c in t))
    if name == "keep_one_of_each_group":
        bare = [x for x in before if not (x[1] or "").split()]
        assert all(after[x] == before[x] for x in bare)
        assert all(after[x] == 1 for x in after if x not in bare) and len(after) < len(before)
    if name == "cut_repeats":
        assert Counter(i for i, *_ in after.elements()) == Counter(i for i, *_ in before.elements())
        assert after[(100, None, "en", "s0")] == 1 and after[(105, "", "en", "s2")] == 1
    if name == "mix_to_weights":
        assert not set(after) - set(before) and {s for *_, s in after} == {"s0", "s1", "s2", None}


def test_added_columns_that_are_there_and_empty_tables(spark):
    import public_tokenizers

    table = spark.createDataFrame([(1, "a b", "x", "y", "z", "q"), (2, None, "x", "y", "z", "q")],
                                  "doc_id long, text string, n_bytes string, n_tokens string, ids string, decoded_sha256 string")
    counted = count_tokens(table, public_tokenizers.path("word_bpe_49k.json"))
    assert dict(counted.dtypes)["n_tokens"] == "bigint" and counted.where("doc_id = 2").first()["n_tokens"] == 0
    coded = encode_texts(table, public_tokenizers.path("piece_bpe_32k.model"))
    assert dict(coded.dtypes)["ids"] == "array<int>" and coded.where("doc_id = 2").first()["n_ids"] == 0
    none = table.where("false")
    assert count_tokens(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert encode_texts(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    pages = spark.createDataFrame([(1, "u", "<p>", "r", "t"), (2, "u", None, "r", "t"), (3, "u", "<p>", "r", "t")],
                                  "page_id long, url string, html string, record string, record_type string")
    assert {r["page_id"]: r["record_type"] for r in archive(pages).collect()} == {1: "revisit", 2: "response", 3: "response"}
    vectors = spark.createDataFrame([(i, [1.0, float(i)], 1, "s", "r", "c") for i in range(5)] + [(None, None, None, "s", "r", "c")],
                                    "vec_id long, embedding array<double>, label int, score string, rank string, component_id string")
    best = top_k(vectors, F.col("vec_id") == 0, 2)
    assert [(r["rank"], r["vec_id"], r["score"]) for r in best.orderBy("rank").collect()] == [(1, 1, 1 << 20), (2, 2, 1 << 20)]
    assert near_vectors(vectors).where("vec_id = 1").first()["component_id"] == 1


def test_license_labels_and_scores_by_hand(spark):
    """Labels and scores of texts put together from phrases, worked out phrase by phrase."""
    import random

    r = random.Random(9)
    phrases = [*BASE, *NOTICES]
    texts = [" ; ".join(r.choice([*phrases, "plain words", "license", "mit"]).title() for _ in range(r.randrange(7))) for _ in range(150)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for row in license_digest(scan_licenses(table)).collect():
        text = texts[row["doc_id"]]
        spots = [(at, at + len(p.split()), label) for p, label in NOTICES.items() for at in places(text, p)[0]]
        notices = {label for a, b, label in spots if not any((c, d) != (a, b) and c <= a and b <= d for c, d, _ in spots)}
        base = {label for p, label in BASE.items() if places(text, p)[0]}
        assert row["labels"] == ",".join(sorted(base | notices)), text
        left = (1 - EVIDENCE["base"]) ** len(base) * (1 - EVIDENCE["notice"]) ** len(notices)
        assert abs(row["score"] - (1 - left)) < 1e-6 and row["n_tags"] == 0, text

"""Ranked search, conversation trie and license scans against brute force, with the awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolemill.llm import lexical, turn_trie
from rolemill.llm.lexical import search_ranked
from rolemill.llm.licenses import BASE, NOTICES, evaluate, family, license_digest, scan_licenses, to_postfix
from rolemill.llm.turn_trie import prefix_trie, sequences, with_shared_heads
from tests_llm_words import places

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Ranked lexical search


def ranked(items, docs, k):
    terms = [TERM.findall(lowered(t)) for _, t in docs]
    n_docs, length = sum(bool(t) for t in terms), sum(map(len, terms))
    df = Counter(w for t in terms for w in set(t))
    out = []
    for item_id, text in items:
        asked = Counter(TERM.findall(lowered(text)))
        scores = []
        for (doc_id, _), own in zip(docs, terms):
            tf = Counter(own)
            m = 25 + (75 * len(own) * n_docs) // length if length else 25
            score = sum(again * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                        * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w, again in asked.items() if w in tf)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id if doc_id is not None else 0))
        for rank, (score, none, doc_id) in enumerate(sorted(scores)[:k], 1):
            out.append((item_id, rank, None if none else doc_id, -score))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "漢字", "x1"]
    docs = [(0, None), (1, ""), (2, " ,.!"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (4, "W1--w1_w2"), (5, "w5 " * 5000)]
    for i in range(300):
        docs.append((10 + i, " ".join(r.choice(vocabulary[:r.choice([5, 30, 63])]) for _ in range(r.choice([1, 5, 40, 200])))))
    docs += docs[:40] + [(900 + i, "w7 w8 w9 w10") for i in range(120)]  # repeated rows; a third in one group of copies
    items = [(0, None), (1, "..."), (2, "w7 w8 w9 w10"), (3, "unknown"), (None, "w1"), (3, "w2 W2 w3"), (4, "é É 漢字")]
    items += [(10 + i, " ".join(r.choice(vocabulary) for _ in range(r.choice([2, 20, 90])))) for i in range(20)]
    return items, docs


def search(spark, items, docs, **options):
    i = spark.createDataFrame([(a, t, "z") for a, t in items], "item_id long, text string, score string").repartition(2)
    d = spark.createDataFrame([(a, t, 1, "q") for a, t in docs], "doc_id long, text string, item_id int, rank string")
    found = search_ranked(i, d.repartition(5), **options)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("k,options", [(10, {}), (3, {"group_bytes": 150})])
def test_search_equals_brute_force(spark, corpus, monkeypatch, k, options):
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 37)
    items, docs = corpus
    assert search(spark, items, docs, k=k, **options) == ranked(items, docs, k)


def test_search_of_nothing(spark):
    assert search(spark, [], [(1, "a")]) == search(spark, [(1, "a")], []) == search(spark, [(1, "a")], [(1, None)]) == []


def test_masks_save_scores():
    """Groups of masks that cannot reach the k-th score are left out; the rest is exact."""
    r = np.random.default_rng(1)
    entries = []
    for i in range(2000):
        held = np.flatnonzero(r.random(12) < (0.9 if i < 20 else 0.2)).astype(np.int32)
        entries.append(np.stack([held, r.integers(1, 4, len(held), np.int32)]).astype(np.int32).tobytes())
    block = lexical.Block(np.full(2000, 60), entries)
    weights = r.integers(500, 3000, 12)
    docs, scores, scored = block.best(np.arange(12), weights, 10, 0)
    full = np.zeros(2000, np.int64)
    for i, e in enumerate(entries):
        held, tf = np.frombuffer(e, np.int32).reshape(2, -1).astype(np.int64)
        full[i] = sum(weights[held] * ((10**9 * tf) // (1000 * tf + 480)))
    best = np.sort(full)[::-1][:10]
    assert sorted(scores.tolist(), reverse=True)[:10] == best.tolist() and (full[docs] == scores).all()
    assert scored < 500


# Conversation prefix trie


def trie(paths):
    """Brute force over {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    own = {p: (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0 for p, m in members.items()}
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += own[p]
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p)).encode()).hexdigest())
                   for p, m in members.items()), key=repr)


def turn_id(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, turn_id(role, text), (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


TURNS = "conv_id long, turn long, role string, text string, n_convs string, shard string"


def nodes(spark, rows, **options):
    table = spark.createDataFrame([(*r, "a", "b") for r in rows], TURNS).repartition(3)
    found = prefix_trie(with_shared_heads(sequences(table)), **options)
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.fixture(scope="module")
def conversations():
    r = random.Random(6)
    texts = ["", "a b", "é  c\td", "x", None]
    rows = []
    for c in range(150):
        for turn in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, r.choice([turn, turn, turn, None, 0]), r.choice(["user", "bot", None]), r.choice(texts)))
    for c in range(200, 275):  # a third of the conversations is one copied text
        rows += [(c, t, "user", f"same {t}") for t in range(6)]
    for c in (300, 301, 303, 323):  # long ones, sharing most of their turns
        rows += [(c, t, "user", f"long {t}" if t < 60 else f"own {c} {t}") for t in range(61 + c % 7)]
    return rows + rows[:30] + [(None, 1, "user", "no id"), (77, None, None, None)]


@pytest.mark.parametrize("shard_bytes", [1 << 20, 3000, 400])
def test_trie_equals_brute_force(spark, conversations, shard_bytes):
    assert nodes(spark, conversations, shard_bytes=shard_bytes) == trie(rebuilt(conversations))


def test_turnless_single_and_empty(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert nodes(spark, []) == nodes(spark, [(None, 1, "a", "b")]) == []
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)
    one = hashlib.sha256(str(c).encode()).hexdigest()
    assert nodes(spark, [(c, 0, "user", "gone")]) == [(c, 0, None, 1, 0, 1, 0, one)]
    assert nodes(spark, [(0, 0, "user", "a b"), (0, 1, "bot", "c")]) == sorted([
        (0, 0, None, 1, 1, 1, 0, empty), (0, 1, 0, 1, 1, 1, 0, empty),
        (0, 2, 0, 1, 0, 1, 0, hashlib.sha256(b"0").hexdigest())], key=repr)


def test_ragged_order_is_that_of_the_bytes():
    r = random.Random(2)
    rows = sorted({tuple(r.choice([1, 1, 1, 2]) for _ in range(r.randrange(70))) for _ in range(300)}, key=lambda x: hash(x))
    flat, lens = np.array([x for row in rows for x in row]), np.array([len(row) for row in rows])
    order = turn_trie._order(flat, np.cumsum(lens) - lens, lens)
    assert [rows[i] for i in order] == sorted(rows)


# License scans


TEXTS = [None, "", "  \n", "MIT License", "mit-license,MIT (License)", "permit license", "the GNU General Public\nLicense v3",
         "General Public License General Public License", "Licensed under CC BY-NC 4.0.", "é mit licensé", "mit  license " * 3000,
         "Lesser General Public License", "x " * 20000 + "Apache License, Version 2.0",
         "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\nmore", "license: MIT and nothing",
         "License: see below", "a license agreement", "SPDX-License-Identifier: Made-Up-1.0", "All rights reserved"]


def test_license_digest(spark):
    table = spark.createDataFrame([(i, t, "n", "l") for i, t in enumerate(TEXTS + TEXTS[:4])],
                                  "doc_id long, text string, n_words string, labels string").repartition(3)
    got = {r["doc_id"]: r for r in license_digest(scan_licenses(table)).collect()}
    assert len(got) == len(TEXTS) + 4 and license_digest(scan_licenses(table.where("false"))).count() == 0
    for i, text in enumerate(TEXTS + TEXTS[:4]):
        found = {p: places(text, p) for p in BASE}
        at = sorted(x for starts, _ in found.values() for x in starts)
        base = sorted(BASE[p] for p, (starts, _) in found.items() if starts)
        row = got[i]
        assert (row["n_words"], row["n_base"]) == (places(text, "x")[1], len(at)), text
        assert (row["first_word"], row["last_word"]) == ((at[0], at[-1]) if at else (None, None))
        assert row["base_labels"] == ",".join(base) and set(base) <= set(row["labels"].split(",")) | {""}
        longer = {n for n in NOTICES if places(text, n)[0]}
        inside = {n for n in longer if any(n != m and f" {n} " in f" {m} " for m in longer)}
        if "identifier" not in lowered(text) and "license:" not in lowered(text):
            assert row["labels"] == ",".join(sorted(set(base) | {NOTICES[n] for n in longer - inside}))
        assert 0 <= row["score"] <= 1 and (row["score"] > 0) == bool(row["labels"])
    by_text = {t: got[i] for i, t in enumerate(TEXTS)}
    tagged = by_text[TEXTS[13]]
    assert (tagged["labels"], tagged["n_tags"], tagged["freedom"]) == ("bsd,gpl,mit", 1, 1.0)
    assert by_text["license: MIT and nothing"]["labels"] == "mit,other"
    assert by_text["License: see below"]["labels"] == by_text["a license agreement"]["labels"] == ""
    assert by_text["SPDX-License-Identifier: Made-Up-1.0"]["labels"] == "other"
    assert by_text["Licensed under CC BY-NC 4.0."]["labels"] == "cc-by-nc"


@pytest.mark.parametrize("text,postfix", [
    ("a or b and c with d", "a b c d with and or"), ("( a or b ) and c", "a b or c and"), ("a AND b Or c", "a b and c or"),
    ("a or", "a"), ("( a", "a"), (") a", ""), ("a b", "a"), ("or a", ""), ("a ) or b", "a"), ("", ""), ("a and ( or", "a"),
    ("( ( a ) )", "a")])
def test_shunting_yard(text, postfix):
    assert " ".join(to_postfix(text.split())) == postfix


def test_expressions():
    read = lambda text: evaluate(to_postfix(text.split()))
    assert read("MIT OR GPL-3.0-or-later")[:2] == ({"mit", "gpl"}, 1.0)
    assert read("MIT AND GPL-3.0+")[:2] == ({"mit", "gpl"}, 0.3)
    assert read("GPL-2.0 WITH Classpath-exception-2.0")[1] == 0.6 > read("GPL-2.0 WITH Nothing-1.0")[1]
    assert read("MIT OR BSD-2-Clause AND ISC")[2] == "(MIT OR (BSD-2-Clause AND ISC))"
    assert read("") is None and evaluate(["see"], strict=True) is None
    assert family("cc-by-nc-4.0")[0] == "cc-by-nc" and family("CC-BY-4.0")[0] == "cc-by" and family("nothing") is None
    assert read(" OR ".join(["MIT"] * 50_000))[0] == {"mit"}

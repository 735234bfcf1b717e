"""Ranked lexical search by presence masks.

1. One pass over the texts keeps, per document, its length and how often each term of the
   asked items occurs in it: lists far smaller than the text, written to the shared folder.
2. Sums over these lists give the corpus figures and the weight of every term.
3. A task reads its documents in blocks.  A term's documents are a bitmap; the bitmaps of an
   item's terms, stacked, give every document a mask of the terms it holds, and documents
   with one mask are a group.  A mask's maximum score adds up the largest contribution of
   each of its terms in the block.  Masks are taken by descending maximum and their documents
   scored exactly, until no mask left can reach the k-th best score the task has seen.
4. The best k of each task meet per item, in two levels.

Items are read in groups of bounded size, so what a task holds of them does not grow with
their number; each group is one such search.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolemill.llm.blocks import from_bytes, pack, to_bytes, unpack
from rolemill.plans.session import materialize

GROUP_BYTES = 8 << 20  # text of the items searched for at once; a longer item is a group of its own
BLOCK_ROWS = 1 << 14  # documents of a block
BLOCK_ENTRIES = 1 << 21  # and (document, term) entries, unless one document has more
SALTS = 64

_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(raw: bytes) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII; A-Z lower-cased."""
    return raw.translate(_TERMS).split()


class Items:
    """A group of items: its vocabulary, and per item the numbers and repeats of its distinct terms."""

    def __init__(self, blocks: list[bytes], id: str, text: str):
        self.ids, self.terms, self.repeats, self.vocabulary = [], [], [], {}
        for rows in map(unpack, blocks):
            self.ids += rows[id].to_pylist()
            for t in rows[text].to_pylist():
                found = Counter(terms((t or "").encode()))
                self.terms.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found], np.int64))
                self.repeats.append(np.array(list(found.values()), np.int64))


def _postings(docs: DataFrame, items, doc_id: str, text: str, number: str) -> DataFrame:
    """(id, n, m's numerator, entries): lengths, and (term, count) pairs of the asked vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items.value.vocabulary
        for batch in batches:
            n, entries = [], []
            for value in batch.column(text):
                words = terms((value.as_py() or "").encode())
                n.append(len(words))
                held = [(known[w], c) for w, c in Counter(words).items() if w in known]
                held.sort()
                entries.append(np.array(held, np.int64).reshape(-1, 2).T.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(n, pa.int64()), pa.array(entries, pa.binary())],
                                             names=[number, "n", "entries"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{number}` {kind}, n long, entries binary")


def _frequencies(postings: DataFrame) -> dict[int, int]:
    """Documents per term: counted in tasks, added up by Spark; one number per term of the group."""
    def run(batches):
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column("entries"):
                term, _ = from_bytes(raw.as_py(), np.int32, np.int32)
                if len(term):
                    if term[-1] >= len(counts):
                        counts = np.pad(counts, (0, int(term[-1]) + 1 - len(counts)))
                    counts[term] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["term", "df"])

    found = postings.select("entries").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return dict(zip(*[c.to_pylist() for c in found.toArrow().columns]))


class Block:
    """Postings of a block by term, with contributions (1000000000 * tf) div (1000 * tf + 8 * m)."""

    def __init__(self, m: np.ndarray, entries: list[bytes]):
        parts = [from_bytes(e, np.int32, np.int32) for e in entries]
        doc = np.repeat(np.arange(len(parts)), [len(t) for t, _ in parts])
        term = np.concatenate([t for t, _ in parts]).astype(np.int64)
        tf = np.concatenate([c for _, c in parts]).astype(np.int64)
        order = np.argsort(term, kind="stable")
        self.n, self.docs = len(parts), doc[order]
        tf, term = tf[order], term[order]
        self.values = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.docs])
        self.terms, starts = np.unique(term, return_index=True)
        self.starts = np.append(starts, len(term))
        self.most = np.maximum.reduceat(self.values, starts) if len(starts) else self.values
        self.bitmaps: dict[int, np.ndarray] = {}

    def bitmap(self, j: int) -> np.ndarray:
        """Which documents hold the j-th term of the block, a bit each."""
        if j not in self.bitmaps:
            held = np.zeros(self.n, bool)
            held[self.docs[self.starts[j]:self.starts[j + 1]]] = True
            self.bitmaps[j] = np.packbits(held)
        return self.bitmaps[j]

    def best(self, asked: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that can be among the best ``k`` and reach ``least`` (at least 1), their scores, and how many were scored."""
        none = np.zeros(0, np.int64)
        at = np.searchsorted(self.terms, asked)
        here = np.flatnonzero((at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == asked)
                              & (weights > 0)) if len(self.terms) else none
        if not len(here):
            return none, none, 0
        at, weights = at[here], weights[here]
        held = np.unpackbits(np.stack([self.bitmap(j) for j in at.tolist()]), axis=1, count=self.n).view(bool)
        masks = np.packbits(held, axis=0)  # a column per document: the terms it holds, a bit each
        masks = np.ascontiguousarray(masks.T).view(f"V{masks.shape[0]}").ravel()
        order = np.argsort(masks, kind="stable") if masks.dtype.itemsize == 1 else np.lexsort(
            np.ascontiguousarray(masks).view(np.uint8).reshape(self.n, -1).T[::-1])
        ranked = masks[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        ends = np.append(first[1:], self.n)
        most = held[:, order[first]].T.astype(np.int64) @ (weights * self.most[at])
        found, scores = [], []
        scored, floor = 0, max(least, 1)
        by_most = np.argsort(-most, kind="stable")
        step, g = 64, 0
        while g < len(by_most) and most[by_most[g]] >= floor:
            now = by_most[g:g + step]
            now = now[most[now] >= floor]
            docs = np.sort(np.concatenate([order[first[x]:ends[x]] for x in now.tolist()]))
            score = np.zeros(len(docs), np.int64)
            for i, j in enumerate(at.tolist()):
                has = np.flatnonzero(held[i, docs])
                start = self.starts[j]
                place = np.searchsorted(self.docs[start:self.starts[j + 1]], docs[has])
                score[has] += weights[i] * self.values[start + place]
            scored += len(docs)
            good = score >= floor
            found.append(docs[good])
            scores.append(score[good])
            together = np.concatenate(scores)
            if len(together) > k:
                floor = max(floor, int(np.partition(together, len(together) - k)[len(together) - k]))
            g, step = g + step, step * 2
        if not found:
            return none, none, scored
        docs, score = np.concatenate(found), np.concatenate(scores)
        return docs[score >= floor], score[score >= floor], scored


def _search(docs: DataFrame, items: Items, k: int, item_id: str, item_kind: str, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    sent = spark.sparkContext.broadcast(items)  # a group's items, at most GROUP_BYTES of text or one item
    postings = materialize(_postings(docs, sent, doc_id, text, "id"), "postings")
    totals = postings.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)).alias("N"),
                          F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    n_docs, length = totals["N"], totals["L"]
    frequency = _frequencies(postings)
    df = np.array([frequency.get(t, 0) for t in range(len(items.vocabulary))], np.int64)
    weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
    asked = [w[t] * r for w, t, r in zip([weights] * len(items.ids), items.terms, items.repeats)]
    weighed = spark.sparkContext.broadcast((items.terms, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight = weighed.value
        best = [(0, [])] * len(wanted)  # per item: least score to beat, and (score, id) of the best so far
        for ids, n, entries in _blocks(batches):
            block = Block(np.array([25 + (75 * x * n_docs) // length if length else 25 for x in n], np.int64), entries)
            for i, (t, w) in enumerate(zip(wanted, weight)):
                least, held = best[i]
                found, scores, _ = block.best(t, w, k, least)
                if len(found):
                    held = held + [(s, ids[d]) for s, d in zip(scores.tolist(), found.tolist())]
                    held.sort(key=_place)
                    held = held[:k]
                    best[i] = (held[-1][0] if len(held) == k else 0, held)
        out = [(i, s, d) for i, (_, held) in enumerate(best) for s, d in held]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _, _ in out], pa.int64()), pa.array([s for _, s, _ in out], pa.int64()),
             pa.array([d for _, _, d in out], postings_id), pa.array([task % SALTS] * len(out), pa.int32())],
            names=["item", "score", "id", "salt"])

    from pyspark.sql.pandas.types import to_arrow_type

    postings_id = to_arrow_type(docs.schema[doc_id].dataType)
    listed = postings.mapInArrow(run, f"item long, score long, id {kind}, salt int")
    order = [F.desc("score"), F.asc_nulls_last("id")]
    for keys in (["item", "salt"], ["item"]):
        listed = listed.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
            F.col("rank") <= k)
    names = spark.createDataFrame([(i, v) for i, v in enumerate(items.ids)], f"item long, `{item_id}` {item_kind}")
    return listed.join(F.broadcast(names), "item").select(
        item_id, F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc_id), "score")


def _place(entry):
    score, id = entry
    return -score, id is None, id if id is not None else 0


def _blocks(batches) -> Iterator[tuple[list, list[int], list[bytes]]]:
    ids, n, entries, held = [], [], [], 0
    for batch in batches:
        for id, length, raw in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(),
                                   batch.column("entries").to_pylist()):
            if not raw:  # holds no asked term
                continue
            if ids and (len(ids) >= BLOCK_ROWS or held + len(raw) // 8 > BLOCK_ENTRIES):
                yield ids, n, entries
                ids, n, entries, held = [], [], [], 0
            ids.append(id)
            n.append(length)
            entries.append(raw)
            held += len(raw) // 8
    if ids:
        yield ids, n, entries


def search_ranked(items: DataFrame, docs: DataFrame, k: int = 10, item_id: str = "item_id", doc_id: str = "doc_id",
                  text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The ``k`` highest-scoring documents of every item: (item id, ``rank`` from 1, document id, ``score``).

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased.  With N documents that have a
    term, L terms in them and df of them holding a term, its weight is floor(1000 * ln((2N+2) / (2df+1))); a document
    of n terms has m = 25 + (75 * n * N) div L and scores weight * ((10**9 * tf) div (1000 * tf + 8 * m)) for each
    term of the item, repeats included.  Only scores above 0 are returned; equal ones by ascending id.

    Null and empty texts have no terms: such an item finds nothing, such a document is never found.  Every row is an
    item or a document of its own: rows that share an id are ranked side by side, a null id last among equals.
    Other columns take no part.  No items or no documents give no rows.  A text is held whole by one task.
    """
    spark = docs.sparkSession
    packed = pack(items.select(item_id, text), text, min(group_bytes, 4 << 20))
    sizes = packed.select("block", F.octet_length("rows").alias("bytes"), "n").orderBy("block").collect()  # a row per 4 MB
    groups, held = [], 0
    for row in sizes:
        if not groups or held + row["bytes"] > group_bytes:
            groups.append([])
            held = 0
        groups[-1].append(row["block"])
        held += row["bytes"]
    item_kind = items.schema[item_id].dataType.simpleString()
    out = None
    for blocks in groups:
        rows = packed.where(F.col("block").isin(blocks)).orderBy("block").select("rows").toArrow()["rows"].to_pylist()
        found = _search(docs, Items(rows, item_id, text), k, item_id, item_kind, doc_id, text)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"`{item_id}` {item_kind}, rank int, "
                                         f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, score long")
    return out

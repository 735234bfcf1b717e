"""Bigram language model by deleted interpolation, learned from and applied to a whole corpus.

``P(w | v) = l2 c(v w)/c(v) + l1 c(w)/N + l0 /(V+1)``, with weights by how often the
context ``v`` occurs.  The weights come from expectation-maximisation on deleted counts:
every training token is held out of the counts that predict it.

Blocks of documents ask the shards of the key space for the counts of their distinct
words and word pairs and are told the sums over all blocks, so every count of the corpus
is used and none is gathered in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.llm.blocks import ask, pack, shard_count, tell
from rolemill.llm.words import U64, Words, mix
from rolemill.plans.session import materialize

CONTEXT_BUCKETS = 24  # by powers of two; more frequent contexts share the last
ROUNDS = 30
BEGIN, END = U64(0x51ED270B9F3C9D11), U64(0xA0761D6478BD642F)


def _squeeze(values: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(values).tobytes(), asbytes=True)


def _expand(raw: bytes, n: int, dtype) -> np.ndarray:
    size = n * np.dtype(dtype).itemsize
    return np.frombuffer(pa.Codec("zstd").decompress(raw, size, asbytes=True) if n else b"", dtype)


class _Tokens:
    """Tokens of a block: the words of each text, then an end."""

    def __init__(self, texts):
        words = Words(texts, lower=True)
        counts = words.counts()
        self.lengths = counts + 1
        self.first = np.cumsum(self.lengths) - self.lengths
        n = int(self.lengths.sum())
        token = np.full(n, END, U64)
        is_word = np.ones(n, bool)
        is_word[self.first + counts] = False
        token[is_word] = words.hashes(61)
        before = np.empty(n, U64)
        before[1:] = token[:-1]
        before[self.first] = BEGIN
        self.one = mix(token, 62) >> U64(3)
        pair = mix(token ^ mix(before, 63), 64)
        self.two = (pair >> U64(3)) | ((pair % U64(7) + U64(1)) << U64(61))  # pairs fill the other 7/8 of the space
        self.begin = mix(np.array([BEGIN]), 62)[0] >> U64(3)

    def keys(self):
        """Distinct keys in order, and the place of every token's word and pair among them; the begin marker's too."""
        parts = [np.unique(x, return_inverse=True) for x in (np.append(self.one, self.begin), self.two)]
        (one, at_one), (two, at_two) = parts
        return np.concatenate((one, two)), at_one[:-1], at_two + len(one), at_one[-1]


def _shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the key space, so that ordered keys stay ordered inside a shard."""
    return ((keys >> U64(32)) * U64(shards)) >> U64(32)


def _pack_keys(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ordered keys as differences of 6 bytes (8 if one is larger), and their counts."""
    steps = np.diff(keys, prepend=U64(0))
    first, steps = steps[:1], steps[1:]
    width = 6 if not len(steps) or int(steps.max()) < 1 << 48 else 8
    body = np.ascontiguousarray(steps).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return b"".join((np.int64([len(keys), width]).tobytes(), first.tobytes(), body, _squeeze(counts.astype(np.uint32))))


def _unpack_keys(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = np.frombuffer(raw, np.int64, 2).tolist()
    at = 24 + (n - 1) * width
    steps = np.zeros((n, 8), np.uint8)
    steps[:1] = np.frombuffer(raw, np.uint8, 8, 16)
    steps[1:, :width] = np.frombuffer(raw, np.uint8, (n - 1) * width, 24).reshape(n - 1, width)
    return np.cumsum(steps.view(U64).ravel(), dtype=U64), _expand(raw[at:], n, np.uint32)


def _sum_counts(table: pa.Table) -> pa.Table:
    """Sums over all blocks at one shard; the row of block -1 has the distinct words and tokens of training texts."""
    parts = [_unpack_keys(e.as_py()) for e in table["entries"]]
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    sums = np.add.reduceat(counts[order], np.flatnonzero(new))
    out = np.empty(len(order), np.int64)
    out[order] = sums[np.cumsum(new) - 1]
    word = (keys[order][new] >> U64(61) == 0) & (sums > 0)
    ends = np.cumsum([len(k) for k, _ in parts])
    entries = [_squeeze(out[e - len(k):e]) for (k, _), e in zip(parts, ends.tolist())]
    m, shard = len(entries), table["shard"][0].as_py()
    return pa.table([pa.array([shard] * (m + 1), pa.int32()), pa.array([*table["block"].to_pylist(), -1], pa.int64()),
                     pa.array([*entries, b""], pa.binary()), pa.array([0] * m + [int(word.sum())], pa.int64()),
                     pa.array([0] * m + [int(sums[word].sum())], pa.int64())],
                    names=["shard", "block", "entries", "types", "tokens"])


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else by the power of two below its count."""
    return np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(np.int64), CONTEXT_BUCKETS - 1), 0)


def learn_weights(bucket, p2, p1, weight, p0: float, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (buckets x 3: pair, word, uniform) by expectation-maximisation on weighted events."""
    lam = np.full((CONTEXT_BUCKETS, 3), 1 / 3)
    lam[0] = 0, 0.5, 0.5
    for _ in range(rounds):
        parts = lam[bucket] * np.stack((p2, p1, np.full(len(p1), p0)), axis=1)
        parts *= (weight / np.maximum(parts.sum(1), 1e-300))[:, None]
        for b in range(CONTEXT_BUCKETS):
            seen = parts[bucket == b].sum(0) + np.array([0.01 if b else 0, 0.01, 0.01])
            lam[b] = seen / seen.sum()
    return lam


def score_texts(docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text", alpha: float = 0.1) -> DataFrame:
    """(id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``trained``) for every row of ``docs``.

    Texts with ``train`` teach the model; all are scored.  A-Z count as lower case.  A
    null or empty text is its end token alone.  ``base_score`` adds up the add-``alpha``
    unigram logarithms (base 10), ``score`` the model's.  With no training text both
    spread evenly over one unknown word.  Repeated rows count, and are returned, each.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    blocks = pack(rows, "text")
    shards = shard_count(blocks, 5_000_000)

    def question(block, table):
        tokens = _Tokens(table["text"])
        keys, at_one, at_two, begin = tokens.keys()
        taught = np.repeat(table["train"].to_numpy(), tokens.lengths)
        counts = np.bincount(at_one[taught], minlength=len(keys)) + np.bincount(at_two[taught], minlength=len(keys))
        shard = _shards_of(keys, shards)
        edges = np.flatnonzero(np.diff(shard, prepend=shard[:1] + U64(1)))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)]):
            yield int(shard[a]), _pack_keys(keys[a:b], counts[a:b])

    answers = materialize(ask(blocks, question).groupBy("shard").applyInArrow(
        _sum_counts, "shard int, block long, entries binary, types long, tokens long"), "counts")
    total = answers.where("block = -1").agg(F.sum("types"), F.sum("tokens")).first()
    types, tokens = total[0] or 0, total[1] or 0
    taught = docs.where(F.coalesce(train, F.lit(False))).count()  # how often the begin marker is a context

    def align(block, table, told):
        """The counts of every token of a block, in order."""
        names = ["ids", "train", "lengths", "pairs", "words"]
        if table is None:
            return pa.table([pa.array([], pa.binary())] * 5, names=names)
        t = _Tokens(table["text"])
        keys, at_one, at_two, _ = t.keys()
        parts = {x["shard"]: x["entries"] for x in told}
        shard = _shards_of(keys, shards)
        sums = np.concatenate([_expand(parts[s], n, np.int64) for s, n in zip(*(
            x.tolist() for x in np.unique(shard, return_counts=True)))])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.select(["id"]).schema) as out:
            out.write_table(table.select(["id"]))
        values = [sink.getvalue().to_pybytes(), _squeeze(table["train"].to_numpy()), _squeeze(t.lengths.astype(np.int64)),
                  _squeeze(sums[at_two]), _squeeze(sums[at_one])]
        return pa.table([pa.array([v], pa.binary()) for v in values], names=names)

    aligned = materialize(tell(blocks, answers.where("block >= 0").select("block", "shard", "entries"), align,
                               "ids binary, train binary, lengths binary, pairs binary, words binary"), "aligned")

    def rows_of(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids = pa.ipc.open_stream(row["ids"]).read_all()
                n = ids.num_rows
                lengths = _expand(row["lengths"], n, np.int64)
                m = int(lengths.sum())
                pairs, words = (_expand(row[c], m, np.int64) for c in ("pairs", "words"))
                contexts = np.empty_like(words)  # a token's context is the word before it, or the begin marker
                contexts[1:] = words[:-1]
                contexts[np.cumsum(lengths) - lengths] = taught
                yield ids, _expand(row["train"], n, np.bool_), lengths, pairs, words, contexts

    def events(batches):
        """Deleted counts of training tokens, summed by bucket and by steps of both probabilities."""
        for _, train_, lengths, pairs, words, contexts in rows_of(batches):
            own = np.repeat(train_, lengths)
            p, w, c = pairs[own] - 1, words[own] - 1, contexts[own] - 1
            p2, p1 = p / np.maximum(c, 1), w / max(tokens - 1, 1)
            steps = [np.where(x > 0, 1 + np.minimum(-4 * np.log2(np.maximum(x, 1e-30)), 126).astype(np.int64), 0)
                     for x in (p2, p1)]
            key = (_bucket(c) * 128 + steps[0]) * 128 + steps[1]
            found, at = np.unique(key, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), *(pa.array(np.bincount(at, x, len(found)).astype(float)) for x in (np.ones(len(key)), p2, p1))],
                names=["key", "n", "s2", "s1"])

    seen = (aligned.mapInArrow(events, "key long, n double, s2 double, s1 double")
            .groupBy("key").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1"))
            .orderBy("key").toPandas())  # at most CONTEXT_BUCKETS x 128 x 128 rows
    n = seen["n"].to_numpy()
    lam = learn_weights(seen["key"].to_numpy() >> 14, seen["s2"].to_numpy() / n, seen["s1"].to_numpy() / n, n,
                        1.0 / (types + 1))

    def score(batches):
        for ids, train_, lengths, pairs, words, contexts in rows_of(batches):
            first = np.cumsum(lengths) - lengths
            l2, l1, l0 = lam[_bucket(contexts)].T
            p = l2 * pairs / np.maximum(contexts, 1) + l1 * words / max(tokens, 1) + l0 / (types + 1)
            base = np.log10((words + alpha) / (tokens + alpha * (types + 1)))
            out = [ids.column("id").combine_chunks(), pa.array(lengths), pa.array(np.add.reduceat((words > 0).astype(np.int64), first)),
                   pa.array(np.full(len(lengths), tokens, np.int64)), pa.array(np.add.reduceat(base, first)),
                   pa.array(np.add.reduceat(np.log10(p), first)), pa.array(train_)]
            yield pa.RecordBatch.from_arrays(out, names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score",
                                                         "trained"])

    kind = rows.schema["id"].dataType.simpleString()
    scored = aligned.mapInArrow(score, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, "
                                       "score double, trained boolean")
    return scored.withColumnRenamed("id", id)

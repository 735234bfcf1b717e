"""Prefix trie of conversations from padded turn-id matrices.

1. Every turn becomes a 16-byte id of its role and text and a word count; texts go no further.  A
   conversation is the string of its turns' ids, whose byte order is the order of a depth-first walk.
2. Conversations with equal turns are one row from here on, with their number, smallest id and a digest
   of all their ids.  The digest is a chain, so these ids stream in order through a task, in constant memory.
3. Distinct sequences are dealt to shards by range of their first turns.  A shard pads its turn ids to
   matrices of ``BAND`` columns, sorts the rows by lexsort from the last band to the first, and walks the
   columns: a mask of changes against the row above, OR-accumulated from column to column, marks where
   nodes start, and ``reduceat`` adds up each depth.  Sums over subtrees follow from the deepest level up.
4. A node whose first or last row in a shard continues in the neighbouring one is a boundary node.  Every
   shard knows how many turns it shares with its neighbours, so each counts what it owns: a child and a
   node's own tokens belong to the first shard that has them, a leaf to the last.  Partial rows of a
   boundary node then simply add up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.plans.broadcast import broadcast_if_small
from rolemill.plans.session import materialize

ID_BYTES = 16
BAND = 16  # columns of one padded matrix
SHARD_BYTES = 8 << 20
RANGE_TURNS = 256  # sequences that share so many first turns stay in one shard
NONE_SHA = hashlib.sha256(b"").hexdigest()
NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, key binary, parent_key binary")


def sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """(conv_id, ids, words): each conversation's turn ids, in hex, and word counts, in order of ``turn``.

    Null turns come first, equal ones are ordered by turn id; a null role or text counts as empty; rows
    without a conversation id, which must be a whole number, are left out.  A turn id is the first half of a
    SHA-256 of the role's length, the role and the text.  One conversation's ids meet in one task.
    """
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    id = F.substring(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256), 1, 2 * ID_BYTES)
    words = F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+"))
    each = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), id.alias("id"), words.alias("words")).alias("t"))
    listed = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return listed.select("conv_id", F.col("ts.id").alias("ids"), F.col("ts.words").alias("words"))


def with_shared_heads(listed: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Rebuild conversation c: the first h turns of conversation c - c % ``every``, then its own after its first h.

    h is the unsigned CRC-32 of c in decimal, modulo ``heads``.  A head shorter than h counts as far as it
    goes, an absent one not at all; of own turns, those after the first h stay.  Works on `sequences`.
    """
    at = {"ids": "array<string>", "words": "array<int>"}
    first = listed.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("head"), *[F.slice(c, 1, max(heads - 1, 1)).alias(f"head_{c}") for c in at])
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = listed.withColumn("h", h.cast("int")).withColumn("head", F.col("conv_id") - F.col("conv_id") % every)
    return own.join(first, "head", "left").select("conv_id", *[
        F.concat(F.when((F.col("h") > 0) & F.col(f"head_{c}").isNotNull(), F.slice(f"head_{c}", F.lit(1), F.col("h")))
                 .otherwise(F.array().cast(kind)),
                 F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))).alias(c)
        for c, kind in at.items()])


def _runs(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal 32-byte keys."""
    data = np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, 4)
    new = np.append(True, (data[1:] != data[:-1]).any(axis=1))
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(data))


def _ends(rows: DataFrame, parts: int) -> DataFrame:
    """(key, n, low, sha) of every distinct sequence: how many conversations are equal to it, the smallest, all of them."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("conv_id").to_numpy()
                starts, ends = _runs(batch.column("key"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(starts)), pa.array(ids[starts]),
                     pa.array([ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())],
                    names=["key", "low", "ids"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, low, state = None, 0, 0, None
        for batch in batches:
            out = []
            for k, first, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if key is not None:
                        out.append((key, n, low, state.hexdigest()))
                    key, n, low, state = k, 0, first, hashlib.sha256()
                ids = np.frombuffer(raw, np.int64).tolist()
                state.update(("," * (n > 0) + ",".join(map(str, ids))).encode())
                n += len(ids)
            yield _ended(out)
        yield _ended([(key, n, low, state.hexdigest())] if key is not None else [])

    listed = (rows.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
              .mapInArrow(pieces, "key binary, low long, ids binary"))
    return (listed.repartition(parts, "key").sortWithinPartitions("key", "low")
            .mapInArrow(chain, "key binary, n long, low long, sha string"))


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("key", "n", "low", "sha"), r)) for r in rows], schema=pa.schema(
        [("key", pa.binary()), ("n", pa.int64()), ("low", pa.int64()), ("sha", pa.string())]))


def _order(flat: np.ndarray, off: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Order of sequences of turn numbers, a shorter one before what continues it; no padding beyond a band's rows."""
    rank = np.zeros(len(lens), np.int64)
    for band in range((int(lens.max(initial=0)) - 1) // BAND, -1, -1):
        act = np.flatnonzero(lens > band * BAND)
        matrix = np.zeros((len(act), BAND), np.int64)
        for c in range(BAND):
            has = np.flatnonzero(lens[act] > band * BAND + c)
            matrix[has, c] = flat[off[act[has]] + band * BAND + c]
        below = rank[act]
        order = np.lexsort((below, *matrix.T[::-1]))
        matrix, below = matrix[order], below[order]
        new = (matrix[1:] != matrix[:-1]).any(axis=1) | (below[1:] != below[:-1])
        rank[act[order]] = np.append(1, 1 + np.cumsum(new)) if len(act) else 0
    return np.argsort(rank, kind="stable")


def _path_keys(sequence: bytes, most: int) -> list[bytes]:
    """Keys of the nodes along a sequence, for depths 0 to ``most``."""
    state = hashlib.sha256()
    keys = [state.digest()]
    for d in range(1, most + 1):
        state.update(sequence[(d - 1) * ID_BYTES:d * ID_BYTES])
        keys.append(state.copy().digest())
    return keys


def _flat(column: pa.ChunkedArray) -> tuple[list[bytes], np.ndarray]:
    raw = column.to_pylist()
    halves = np.frombuffer(b"".join(raw), ">u8").reshape(-1, ID_BYTES // 8).astype(np.uint64)
    order = np.lexsort(halves.T[::-1])
    ranked = halves[order]
    number = np.zeros(len(halves), np.int64)
    if len(halves):
        number[order] = np.append(1, 1 + np.cumsum((ranked[1:] != ranked[:-1]).any(axis=1)))
    return raw, number


def _levels(rows: pa.Table, before: int, after: int) -> Iterator[dict]:
    """Nodes of one shard, a level at a time from the root; ``before`` and ``after``: turns shared with its neighbours."""
    raw, flat = _flat(rows["seq"])
    lens = np.array([len(r) // ID_BYTES for r in raw], np.int64)
    off = np.cumsum(lens) - lens
    order = _order(flat, off, lens)
    said = np.concatenate([np.zeros(0, np.int64), rows["words"].combine_chunks().flatten().to_numpy().astype(np.int64)])
    lens, off = lens[order], off[order]
    weight, low = rows["n"].to_numpy()[order], rows["low"].to_numpy()[order]
    sha = np.array(rows["sha"].to_pylist(), object)[order]
    left_keys, right_keys = _path_keys(raw[order[0]], before), _path_keys(raw[order[-1]], after)
    changed, act, above = np.zeros(len(lens), bool), np.arange(len(lens)), None
    changed[0] = True
    for d in range(int(lens.max()) + 1):
        if d:
            act = act[lens[act] >= d]
            column = flat[off[act] + d - 1]
            differs = np.append(True, (act[1:] != act[:-1] + 1) | (column[1:] != column[:-1]))
            changed[act] |= differs
        head = np.flatnonzero(changed[act])
        starts, last = act[head], act[np.append(head[1:], len(act)) - 1]
        n = np.add.reduceat(weight[act], head)
        words = said[off[starts] + d - 1] if d else np.zeros(len(head), np.int64)
        left, right = (starts == 0) & (d <= before), (last == len(lens) - 1) & (d <= after)
        keys: list[bytes | None] = [None] * len(head)
        if right[-1]:
            keys[-1] = right_keys[d]
        if left[0]:
            keys[0] = left_keys[d]
        level = {
            "conv_id": np.minimum.reduceat(low[act], head), "depth": d, "starts": starts, "left": left, "key": keys,
            "n_convs": n, "n_children": np.zeros(len(head), np.int64),
            "n_leaves": (~right & (lens[last] == d)).astype(np.int64), "saved_tokens": n * words - words * ~left,
            "ends_sha256": np.where(lens[starts] == d, sha[starts], NONE_SHA),
            "parent": np.searchsorted(above, starts, "right") - 1 if d else None}
        above = starts
        yield level


def _nodes(rows: pa.Table, before: int, after: int) -> pa.Table:
    levels = list(_levels(rows, before, after))
    for upper, level in zip(levels[-2::-1], levels[:0:-1]):
        parent = level["parent"]
        np.add.at(upper["n_children"], parent, (~level["left"]).astype(np.int64))
        for c in ("n_leaves", "saved_tokens"):
            np.add.at(upper[c], parent, level[c])
    parts = []
    for upper, level in zip([None, *levels], levels):
        size = len(level["starts"])
        parent_keys = [None] * size if upper is None else [upper["key"][p] for p in level["parent"].tolist()]
        parent = pa.nulls(size, pa.int64()) if upper is None else pa.array(
            upper["conv_id"][level["parent"]], mask=np.array([k is not None for k in parent_keys]))
        parts.append(pa.table({
            "conv_id": pa.array(level["conv_id"]), "depth": pa.array(np.full(size, level["depth"])), "parent_conv_id": parent,
            "n_convs": pa.array(level["n_convs"]), "n_children": pa.array(level["n_children"]),
            "n_leaves": pa.array(level["n_leaves"]), "saved_tokens": pa.array(level["saved_tokens"]),
            "ends_sha256": pa.array(level["ends_sha256"].tolist(), pa.string()),
            "key": pa.array(level["key"], pa.binary()), "parent_key": pa.array(parent_keys, pa.binary())}))
    return pa.concat_tables(parts)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns that a shard's first sequence has in common with the last one before it."""
    for batch in batches:
        common = []
        for a, b in zip(batch.column("first").to_pylist(), batch.column("last").to_pylist()):
            n = min(len(a), len(b))
            differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
            common.append((int(differ[0]) if len(differ) else n) // ID_BYTES)
        yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(common, pa.int64())], names=["shard", "turns"])


def _neighbours(dealt: DataFrame) -> dict[int, tuple[int, int]]:
    """Per shard: turns shared with the shard before and the one after, -1 for none; two numbers a shard."""
    edges = dealt.groupBy("shard").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    ids = sorted(r["shard"] for r in dealt.select("shard").distinct().collect())
    found = {}
    if len(ids) > 1:
        spark = dealt.sparkSession
        pairs = spark.createDataFrame(list(zip(ids[1:], ids[:-1])), "shard int, prior int")
        firsts = edges.select("shard", "first").join(F.broadcast(pairs), "shard")
        lasts = edges.select(F.col("shard").alias("prior"), "last")
        compared = firsts.join(lasts, "prior").select("shard", "first", "last").mapInArrow(_shared, "shard int, turns long")
        found = {r["shard"]: r["turns"] for r in compared.collect()}
    after = {a: found[b] for a, b in zip(ids, ids[1:])}
    return {s: (found.get(s, -1), after.get(s, -1)) for s in ids}


def prefix_trie(listed: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per distinct sequence of first turns, from `sequences` or what was rebuilt from them.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (the parent's smallest member, null for the
    root), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes of its subtree, itself included),
    ``saved_tokens`` (over its subtree: words of a node's last text times all members but one),
    ``ends_sha256`` (of the ids of conversations that end there, ascending, joined by commas).
    Conversations without turns end at the root; no conversations give no rows.
    """
    spark = listed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(listed.select("conv_id", F.unhex(F.array_join("ids", "")).alias("seq"), "words"), "sequences")
    ends = _ends(rows.select("conv_id", F.unhex(F.sha2("seq", 256)).alias("key")), parts)
    distinct = rows.join(ends.select(F.col("low").alias("conv_id"), "n", "sha"), "conv_id").withColumnRenamed("conv_id", "low")
    distinct = materialize(distinct, "distinct")
    size = distinct.agg(F.sum(F.octet_length("seq") + 100)).first()[0] or 0
    first = F.substring("seq", 1, RANGE_TURNS * ID_BYTES)
    dealt = materialize(distinct.repartitionByRange(int(size // shard_bytes) + 1, first)
                        .withColumn("shard", F.spark_partition_id()), "shards")
    shared = _neighbours(dealt)

    def build(shard: pa.Table) -> pa.Table:
        return _nodes(shard, *shared[shard["shard"][0].as_py()])

    nodes = materialize(dealt.groupBy("shard").applyInArrow(build, NODES), "nodes")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = nodes.where("key is null and parent_key is null").select(*out)
    if len(shared) <= 1:
        return whole
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    ended = F.max(F.when(F.col("ends_sha256") != NONE_SHA, F.col("ends_sha256")))
    boundary = materialize(nodes.where("key is not null").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), *sums,
        F.coalesce(ended, F.lit(NONE_SHA)).alias("ends_sha256"), F.max("parent_key").alias("parent_key")), "boundary")
    tops = boundary.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.where("key is null and parent_key is not null").drop("parent_conv_id").unionByName(boundary)
    return whole.unionByName(below.join(broadcast_if_small(tops), "parent_key", "left").select(*out))

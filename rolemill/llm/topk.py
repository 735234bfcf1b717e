"""Exact top-k inner products by a three-phase uniform threshold.

The axes are dealt to nodes; a node scores every row on its own axes only.

1. Every node lists its best local scores per query; the listed rows are scored in full,
   and the k-th best of them is a safe cutoff: the answer holds nothing below it.
2. The cutoff is shared out evenly over the nodes.  A row whose every local score is
   below its share cannot reach the cutoff; all others are collected.
3. Collected rows whose known scores and shares can still reach the cutoff are scored in
   full, and the best k of them are the answer.

Queries and rows meet in blocks of bounded size.  Scores are integers held in doubles,
exact below 2**53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemill.plans.session import materialize

NODES = 4
ROWS_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 1024


def _stack(column) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _local(queries: np.ndarray, rows: np.ndarray, nodes: int):
    for axes in np.array_split(np.arange(rows.shape[1]), min(nodes, rows.shape[1])):
        yield queries[:, axes] @ rows[:, axes].T


def quantized(vector: str, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, as whole doubles; null where the vector takes no part."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.coalesce((F.size(v) > 0) & ~bad, F.lit(False)),
                  F.transform(v, lambda x: F.floor(x * scale).cast("double")))


def top_k(table: DataFrame, is_query: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding",
          nodes: int = NODES, rows_per_block: int = ROWS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the k best rows of every query, ties to the smaller id.

    A query's own row is no candidate (rows are told apart by id, so all rows that share
    its id are left out, and a repeated query id is asked once, by one of its rows).
    Vectors that are null or empty, or hold null or non-finite components, take no part;
    nor do rows without an id.  Vectors of different lengths do not meet.
    """
    rows = materialize(table.select(F.col(id).cast("long").alias("id"), quantized(vector).alias("vec"), is_query.alias("q"))
                       .where("id is not null and vec is not null").withColumn("dim", F.size("vec")), "vectors")
    queries = rows.where("q").dropDuplicates(["id"]).select("id", "vec", "dim")
    n_rows, n_queries = rows.count(), queries.count()
    blocks, parts = max(1, -(-n_rows // rows_per_block)), max(1, -(-n_queries // queries_per_block))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    here = rows.select("id", "vec", "dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).withColumn(
        "part", numbers(parts))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int")).withColumn(
        "block", numbers(blocks))
    key = ["dim", "part", "block"]
    here = here.toDF(*here.columns)  # columns of its own: both sides of the meeting come from one table

    def gather(q: pa.Table, r: pa.Table) -> pa.Table:
        out = _empty()
        if len(q) and len(r):
            out = _score(q, r, _listed)
        return out

    def _listed(a: np.ndarray, b: np.ndarray, _q: pa.Table) -> np.ndarray:
        take = np.zeros((len(a), len(b)), bool)
        most = min(k + 1, len(b))  # one more: the query itself may be on the list
        for local in _local(a, b, nodes):
            best = np.argpartition(local, len(b) - most, axis=1)[:, len(b) - most:]
            np.put_along_axis(take, best, True, axis=1)
        return take

    def collect(q: pa.Table, r: pa.Table) -> pa.Table:
        out = _empty()
        if len(q) and len(r):
            out = _score(q, r, _needed)
        return out

    def _needed(a: np.ndarray, b: np.ndarray, q: pa.Table) -> np.ndarray:
        cutoff = np.array([-np.inf if c is None else float(c) for c in q["cutoff"].to_pylist()])[:, None]
        share = cutoff / min(nodes, a.shape[1])
        some, bound = np.zeros((len(a), len(b)), bool), np.zeros((len(a), len(b)))
        for local in _local(a, b, nodes):
            high = local >= share
            some |= high
            bound += np.where(high, local, share)
        return some & (bound >= cutoff)

    def _score(q: pa.Table, r: pa.Table, choose) -> pa.Table:
        a, b = _stack(q["vec"]), _stack(r["vec"])
        qid, rid = q["id"].to_numpy(), r["id"].to_numpy()
        i, j = np.nonzero(choose(a, b, q) & (qid[:, None] != rid[None, :]))
        score = np.concatenate([np.einsum("nd,nd->n", a[i[s:s + 100_000]], b[j[s:s + 100_000]])
                                for s in range(0, max(1, len(i)), 100_000)])
        order = np.lexsort((rid[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        starts = np.searchsorted(i, i)
        best = np.arange(len(i)) - starts < k  # no more than k of one block can be in the answer
        return pa.table([pa.array(qid[i[best]], pa.int64()), pa.array(rid[j[best]], pa.int64()),
                         pa.array(score[best].astype(np.int64))], names=["query_id", "vec_id", "score"])

    def _empty() -> pa.Table:
        none = pa.array([], pa.int64())
        return pa.table([none, none, none], names=["query_id", "vec_id", "score"])

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    schema = "query_id long, vec_id long, score long"
    listed = asked.groupBy(*key).cogroup(here.groupBy(*key)).applyInArrow(gather, schema)
    cutoffs = (ranked(listed).where(F.col("rank") == k)
               .select(F.col("query_id").alias("id"), F.col("score").alias("cutoff")))
    told = asked.join(cutoffs, "id", "left").select("id", "vec", "dim", "part", "block", "cutoff")
    found = told.groupBy(*key).cogroup(here.groupBy(*key)).applyInArrow(collect, schema)
    return ranked(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Cosine top-k, exactly: one query, many queries.  `rolemill.operators.lists` has the approximate form.

Distances are computed in blocks of bounded size inside tasks and only the best
``k`` of every block leave it, so pairs never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemill.functions.vectors import cosine_distance_to, score
from rolemill.operators.search import PAGE_COLUMNS, STALE_DAYS, clamp_limit, having_all, visible

BLOCK = 4096  # vectors per side of a block
MATRIX_CELLS = 4_000_000  # distances held at once
TILE = 1024  # queries of a distance matrix
QUERY_STRIP, ITEM_STRIP = 1 << 20, 1 << 22  # numbers in the vectors of a strip of queries, of items
TIE_DIGITS = 12  # distances closer than this are ties, decided by item id


def nearest(items: DataFrame, query: Sequence[float], k: int, item_id: str, vec: str,
            columns: Sequence[str] = ()) -> DataFrame:
    """The ``k`` items closest to one vector: a single scan with a bounded sort."""
    return (
        items.withColumn("distance", cosine_distance_to(F.col(vec), query))
        .where(F.col("distance").isNotNull())
        .select(item_id, *columns, "distance")
        .orderBy("distance", item_id).limit(k)
    )


def query_vector(cvs: DataFrame, cv_id: str) -> list[float]:
    """Vector of one profile; fails when it is unknown or not embedded yet."""
    row = cvs.where(F.col("id") == cv_id).select("embedding_status", "embedding").first()
    if row is None:
        raise LookupError(f"profile not found: {cv_id}")
    if row["embedding_status"] != "embedded" or row["embedding"] is None:
        raise ValueError(f"profile is not embedded yet: {row['embedding_status']}")
    return list(row["embedding"])


def eligible(jobs: DataFrame, job_skills: DataFrame | None, as_of: Column, remote: bool | None = None,
             skills: Sequence[str] = (), salary_min: int | None = None,
             stale_days: int = STALE_DAYS) -> DataFrame:
    """Embedded, fresh postings that pass the match filters."""
    rows = jobs.where(F.col("embedding").isNotNull() & visible(as_of, stale_days))
    if remote is not None:
        rows = rows.where(F.col("remote_allowed") == remote)
    if salary_min is not None:
        rows = rows.where(F.col("salary_max") >= salary_min)
    return having_all(rows, "id", job_skills, "job_id", "skill", skills) if skills else rows


def match(jobs: DataFrame, cvs: DataFrame, cv_id: str, as_of: Column, job_skills: DataFrame | None = None,
          limit: int | str | None = None, **filters) -> DataFrame:
    """Best postings for one profile, best first, with a three-decimal score."""
    rows = eligible(jobs, job_skills, as_of, **filters)
    columns = [c for c in PAGE_COLUMNS if c != "id"]
    best = nearest(rows, query_vector(cvs, cv_id), clamp_limit(limit), "id", "embedding", columns)
    return best.withColumn("score", score(F.col("distance"))).orderBy("distance", "id")


def _by_length(q_ids, q_vecs, i_ids, i_vecs) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Queries and items by vector length: only vectors of one length have a distance."""
    q_len, i_len = (np.fromiter(map(len, v), np.int64, len(v)) for v in (q_vecs, i_vecs))
    for n in np.intersect1d(q_len, i_len):
        if n:
            q, i = np.flatnonzero(q_len == n), np.flatnonzero(i_len == n)
            yield q_ids[q], _unit([q_vecs[x] for x in q]), i_ids[i], _unit([i_vecs[x] for x in i])


def _unit(vectors) -> np.ndarray:
    mat = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    length = np.linalg.norm(mat, axis=1, keepdims=True)
    return np.divide(mat, length, out=np.full_like(mat, np.nan), where=length > 0)


def _leaders(near: pd.DataFrame, k: int) -> pd.DataFrame:
    """The first ``k`` rows of every query by distance, ties by item id."""
    ranked = near.sort_values(["query_id", "distance", "item_id"], kind="stable")
    return ranked.groupby("query_id", sort=False).head(k)


def _near(q_ids: np.ndarray, q_mat: np.ndarray, i_ids: np.ndarray, i_mat: np.ndarray, k: int,
          skip_same_id: bool, reach: np.ndarray) -> pd.DataFrame:
    """Candidates of one distance matrix, by row of ``q_mat``: everything up to each row's k-th distance, known (``reach``) or here."""
    cosine = q_mat @ i_mat.T
    if (reach == np.inf).any():
        dist = np.round(1.0 - cosine, TIE_DIGITS)
        dist[np.isnan(dist)] = np.inf
        if skip_same_id:
            dist[q_ids[:, None] == i_ids[None, :]] = np.inf
        limit = np.partition(dist, k - 1, axis=1)[:, k - 1:k] if k < dist.shape[1] else np.inf
        rows, cols = np.nonzero((dist <= limit) & np.isfinite(dist))
        dist = dist[rows, cols]
    else:
        # Few cells pass, so only these are rounded and compared by id; the slack covers the rounding.
        rows, cols = np.nonzero(cosine >= (1.0 - reach - 10.0 ** -TIE_DIGITS)[:, None])
        dist = np.round(1.0 - cosine[rows, cols], TIE_DIGITS)
        fine = dist <= reach[rows]
        if skip_same_id:
            fine &= q_ids[rows] != i_ids[cols]
        rows, cols, dist = rows[fine], cols[fine], dist[fine]
    return _leaders(pd.DataFrame({"query_id": rows, "item_id": i_ids[cols], "distance": dist}), k)


def _best(q_ids: np.ndarray, q_mat: np.ndarray, i_ids: np.ndarray, i_mat: np.ndarray, k: int,
          skip_same_id: bool) -> pd.DataFrame:
    """The ``k`` closest items of each query, over distance matrices of bounded size."""
    out = []
    for low in range(0, len(q_ids), TILE):
        ids, mat = q_ids[low:low + TILE], q_mat[low:low + TILE]
        step, reach, best = max(k + 1, MATRIX_CELLS // len(ids)), np.full(len(ids), np.inf), None
        few = min(step, max(k + 1, TILE))  # the first matrix is sorted whole, so it is a small one
        for at in [0, *range(few, len(i_ids), step)]:
            to = at + step if at else few
            near = _near(ids, mat, i_ids[at:to], i_mat[at:to], k, skip_same_id, reach)
            if not len(near):
                continue
            best = near if best is None else _leaders(pd.concat([best, near]), k)
            last = best.groupby("query_id")["distance"].agg(["size", "max"])
            last = last[last["size"] == k]
            reach[last.index.to_numpy()] = last["max"].to_numpy()
            # Rows without a direction have nothing to look for.
            reach[np.isnan(mat).any(axis=1)] = -np.inf
        if best is not None:
            out.append(best.assign(query_id=ids[best["query_id"].to_numpy()]))
    none = pd.DataFrame({"query_id": q_ids[:0], "item_id": i_ids[:0], "distance": []})
    return _leaders(pd.concat(out), k) if out else none


def _rename(df: DataFrame, key: str, vec: str) -> DataFrame:
    return df.where(F.col(vec).isNotNull()).select(F.col(key).alias("_id"), F.col(vec).alias("_vec"))


def _keep_best(candidates: DataFrame, k: int) -> DataFrame:
    """Final ``k`` per query; the limit is also applied before the shuffle."""
    order = Window.partitionBy("query_id").orderBy("distance", "item_id")
    return (candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def _schema(queries: DataFrame, items: DataFrame) -> str:
    q, i = queries.schema["_id"].dataType.simpleString(), items.schema["_id"].dataType.simpleString()
    return f"query_id {q}, item_id {i}, distance double"


def strips(n: int, width: int, block: int, most: int, parallel: int) -> int:
    """Into how many strips ``n`` vectors are cut: as few as hold ``most`` numbers, since the other side is copied for each.

    A smaller side is cut further, into blocks, until every core has a few cells.
    """
    blocks, full = -(-n // block), -(-n * max(1, width) // most)
    return max(1, full, min(blocks, int(np.ceil((4 * parallel) ** 0.5))))


def _strips(df: DataFrame, block: int, most: int, parallel: int) -> int:
    seen = df.agg(F.count("*").alias("n"), F.max(F.size("_vec")).alias("width")).first()
    return strips(seen["n"], seen["width"] or 1, block, most, parallel)


def cells(queries: DataFrame, items: DataFrame, block: int, solve, schema: str) -> DataFrame:
    """``solve`` over every cell: both sides are cut into strips of at least ``block`` rows by ``_id`` (`strips`)."""
    parallel = queries.sparkSession.sparkContext.defaultParallelism
    q_strips = _strips(queries, block, QUERY_STRIP, parallel)
    i_strips = _strips(items, block, ITEM_STRIP, parallel)

    def spread(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        return (
            df.withColumn(own, F.pmod(F.xxhash64("_id"), F.lit(own_n)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))
        )

    cell = ["_qc", "_ic"]
    q_cells = spread(queries, "_qc", q_strips, "_ic", i_strips)
    i_cells = spread(items, "_ic", i_strips, "_qc", q_strips)
    return q_cells.groupBy(*cell).cogroup(i_cells.groupBy(*cell)).applyInPandas(solve, schema)


def _block_join(queries: DataFrame, items: DataFrame, k: int, block: int, skip_same_id: bool) -> DataFrame:
    """Best candidates of all pairs, computed cell by cell."""
    def solve(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": q["_id"][:0], "item_id": i["_id"][:0], "distance": []})
        found = [_best(*part, k, skip_same_id) for part in _by_length(
            q["_id"].to_numpy(), q["_vec"].to_numpy(), i["_id"].to_numpy(), i["_vec"].to_numpy())]
        return pd.concat(found) if found else none

    return cells(queries, items, block, solve, _schema(queries, items))


def top_k(queries: DataFrame, items: DataFrame, k: int, query_id: str = "id", item_id: str = "id",
          query_vec: str = "embedding", item_vec: str = "embedding", skip_same_id: bool = False,
          block: int = BLOCK) -> DataFrame:
    """Exact ``k`` closest items of every query: (query_id, item_id, distance, rank).

    Up to one block of queries travels to the tasks and the items stay where they
    are; beyond that both sides are cut into cells.
    """
    q, i = _rename(queries, query_id, query_vec), _rename(items, item_id, item_vec)
    few = q.limit(block + 1).toPandas() if _at_most(q, block) else None
    if few is None:
        found = _block_join(q, i, k, block, skip_same_id)
        return _keep_best(found, k)
    if few.empty:
        return _keep_best(items.sparkSession.createDataFrame([], _schema(q, i)), k)
    shared = q.sparkSession.sparkContext.broadcast((few["_id"].to_numpy(), few["_vec"].to_numpy()))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in batches:
            for part in _by_length(*shared.value, pdf["_id"].to_numpy(), pdf["_vec"].to_numpy()):
                near = _best(*part, k, skip_same_id)
                best = near if best is None else _leaders(pd.concat([best, near]), k)
        if best is not None:
            yield best

    return _keep_best(i.mapInPandas(scan, _schema(q, i)), k)


def _at_most(df: DataFrame, n: int) -> bool:
    return df.count() <= n

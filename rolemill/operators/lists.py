"""Inverted lists over vectors: a coarse centre per list, and one byte per component for what is left.

Centres are fitted on a bounded sample; every vector is filed under its closest centre with its residual
in whole numbers from -127 to 127, a scale and the length of what the numbers miss.  That length bounds how
far a cosine worked out from the numbers can be off, so a search ships and compares small codes, keeps
whatever can still be among the best, and compares full vectors for that short list alone.  Within the
lists it visits a search is exact; how many it visits buys recall.  Lists travel in strips, and a query
meets a strip once, with a bit for each list that it visits there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolemill.operators.match import BLOCK, MATRIX_CELLS, QUERY_STRIP, TIE_DIGITS, TILE, strips
from rolemill.plans.session import materialize

SAMPLE = 16_384  # vectors that centres are fitted on: the only sample, taken by hash of the id
MOST_LISTS = 4096
ROUNDS = 12
CODE_STRIP = 1 << 24  # numbers in the codes of a strip of lists
MARGIN = 1e-9  # room for the rounding of sums


@dataclass(frozen=True)
class Lists:
    """Filed vectors: (``_list``, ``_id``, ``_code``, ``_scale``, ``_err``, ``_vec``), a folder per list."""

    centres: np.ndarray
    sizes: np.ndarray
    radius: np.ndarray  # largest angle between a centre and a vector of its list
    path: str
    rows: DataFrame


def usable(df: DataFrame, id: str, vec: str, dim: int, *extra: str) -> DataFrame:
    """(``_id``, ``_vec``) of rows that have a direction: vectors of another length, zero ones and any with null or non-finite components are left out."""
    v = F.col(vec)
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce((F.size(v) == dim) & fine, F.lit(False))).select(
        F.col(id).alias("_id"), v.cast("array<double>").alias("_vec"), *extra)


def _matrix(column) -> np.ndarray:
    """Unit rows of an Arrow or pandas column of vectors."""
    if isinstance(column, (pa.Array, pa.ChunkedArray)):
        flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
        mat = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    else:
        mat = np.vstack([np.asarray(v, dtype=np.float64) for v in column])
    return mat / np.linalg.norm(mat, axis=1, keepdims=True)


def fit_centres(sample: np.ndarray, lists: int, seed: int = 17) -> np.ndarray:
    """Unit centres by Lloyd's rounds on the sphere; a centre that nothing is close to moves to a sampled row."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        lost = np.flatnonzero(lengths[:, 0] < 1e-12)
        sums[lost], lengths[lost] = sample[rng.integers(0, len(sample), len(lost))], 1.0
        centres = sums / lengths
    return centres


def encode_residuals(unit: np.ndarray, centres: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, errors): ``unit = centre + scale * code`` up to a vector of length ``error``."""
    rest = unit - centres[near]
    scale = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
    codes = np.rint(rest / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(rest - codes * scale[:, None], axis=1)


def file_vectors(items: DataFrame, dim: int, id: str = "id", vec: str = "embedding", lists: int | None = None,
                 sample: int = SAMPLE, keep: Sequence[str] = ()) -> Lists:
    """Fit centres and file every vector; ids must be unique.

    ``lists``: by default the square root of the number of vectors, 4096 at most.  At most ``sample`` vectors reach
    the driver.  ``keep`` columns are filed along for filters.
    """
    rows = usable(items, id, vec, dim, *keep)
    n = rows.count()
    lists = max(1, min(MOST_LISTS, lists or int(round(n ** 0.5))))
    drawn = rows.select("_vec", F.xxhash64("_id").alias("h")).orderBy("h").limit(sample).select("_vec").toArrow()
    centres = fit_centres(_matrix(drawn["_vec"]), lists) if n else np.zeros((1, dim))
    shared = items.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*rows.schema.fields, T.StructField("_list", T.IntegerType()), T.StructField("_code", T.BinaryType()),
                           *[T.StructField(n, T.DoubleType()) for n in ("_scale", "_err", "_angle")]])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column("_vec"))
            cos = unit @ centres.T
            near = np.argmax(cos, axis=1)
            codes, scale, err = encode_residuals(unit, centres, near)
            angle = np.arccos(np.clip(cos[np.arange(len(near)), near], -1, 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(scale), pa.array(err), pa.array(angle)], names=schema.names)

    filed = materialize(rows.mapInArrow(assign, schema), "filed", partition_by="_list")
    stats = filed.groupBy("_list").agg(F.count("*").alias("n"), F.max("_angle").alias("radius")).collect()  # a row a list
    sizes, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for row in stats:
        sizes[row["_list"]], radius[row["_list"]] = row["n"], row["radius"]
    return Lists(centres, sizes, radius, filed.inputFiles()[0].split("/_list=")[0] if n else "", filed)


def _to_visit(unit: np.ndarray, centres: np.ndarray, sizes: np.ndarray, share: float) -> np.ndarray:
    """Which lists every query visits, a row a query: the closest ones, until they hold ``share`` of all vectors."""
    if share >= 1:
        return np.ones((len(unit), len(centres)), bool)
    order = np.argsort(-(unit @ centres.T), axis=1)
    held = np.cumsum(sizes[order], axis=1)
    last = (held >= share * sizes.sum()).argmax(axis=1)
    seen = np.zeros(order.shape, bool)
    np.put_along_axis(seen, order, np.arange(len(centres)) <= last[:, None], axis=1)
    return seen


def _strips_of(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first strip, number of strips) of every list: lists share strips of about ``rows`` vectors, one that holds more has strips of its own."""
    first, pieces, at, held = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // rows)), 0, 0
    for n, size in enumerate(sizes):
        if held and held + size > rows:
            at, held = at + 1, 0
        first[n], held = at, held + size
        if pieces[n] > 1:
            at, held = at + pieces[n], 0
    return first, pieces


def _raise(best: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Merge values of some rows into ``best``, the highest values of every row."""
    k = best.shape[1]
    order = np.lexsort((-values, rows))
    who, first, n = np.unique(rows[order], return_index=True, return_counts=True)
    rank = np.arange(len(order)) - np.repeat(first, n)
    new = np.full((len(who), k), -np.inf)
    new[np.repeat(np.arange(len(who)), n)[rank < k], rank[rank < k]] = values[order][rank < k]
    best[who] = -np.sort(-np.concatenate([best[who], new], axis=1), axis=1)[:, :k]


def _short_list(unit: np.ndarray, seen: np.ndarray, q_ids: np.ndarray, centres: np.ndarray, place: np.ndarray, i_ids: np.ndarray,
                codes: np.ndarray, scale: np.ndarray, err: np.ndarray, k: int, skip_same_id: bool) -> tuple[np.ndarray, ...]:
    """(row, item, lowest and highest cosine, codes looked at by row): whatever can be among a row's ``k`` best of the lists it visits.

    ``place`` has the list of every item, in ascending order; ``seen`` a column a list.
    """
    best, scanned = np.full((len(unit), k), -np.inf), np.zeros(len(unit), np.int64)  # best: the highest lower bounds so far
    found, held, most = [], 0, MATRIX_CELLS

    def still() -> tuple[np.ndarray, ...]:
        rows, cols, low, high = (np.concatenate(x) for x in zip(*found))
        fine = high >= best[rows, k - 1]
        return rows[fine], cols[fine], low[fine], high[fine]

    ends = np.searchsorted(place, np.arange(len(centres)), "right")
    for n, (start, end) in enumerate(zip([0, *ends], ends)):
        visitors = np.flatnonzero(seen[:, n])
        if skip_same_id and start < end and (i_ids[start:end] == i_ids[start]).all():  # a list of one id is none to that id
            visitors = visitors[q_ids[visitors] != i_ids[start]]
        scanned[visitors] += end - start
        for a in range(start, end, BLOCK):
            b = min(a + BLOCK, end)
            near = centres[n] + codes[a:b] * scale[a:b, None]
            for at in range(0, len(visitors), TILE):
                part = visitors[at:at + TILE]
                about = unit[part] @ near.T
                floor = best[part, k - 1]
                new = np.flatnonzero(floor == -np.inf)
                if len(new) and b - a > k:  # fewer than k seen so far: the k-th best here will do
                    low = about[new] - err[a:b]
                    if skip_same_id:
                        low[q_ids[part[new], None] == i_ids[None, a:b]] = -np.inf
                    floor[new] = -np.partition(-low, k - 1, axis=1)[:, k - 1]
                rows, cols = np.nonzero(about >= floor[:, None] - err[a:b])
                about, cols, rows = about[rows, cols], cols + a, part[rows]
                if skip_same_id:
                    fine = q_ids[rows] != i_ids[cols]
                    about, cols, rows = about[fine], cols[fine], rows[fine]
                if not len(rows):
                    continue
                low = about - err[cols]
                found.append((rows, cols, low, about + err[cols]))
                held += len(rows)
                better = low > best[rows, k - 1]
                _raise(best, rows[better], low[better])
                if held > most:  # much of what was kept early goes again
                    found = [still()]
                    held = len(found[0][0])
                    most = max(MATRIX_CELLS, 2 * held)
    if not found:
        return (*(np.zeros(0, kind) for kind in (np.int64, np.int64, float, float)), scanned)
    return (*still(), scanned)


def search_lists(queries: DataFrame, index: Lists, k: int, share: float, query_id: str = "id",
                 query_vec: str = "embedding", skip_same_id: bool = False, block: int = BLOCK) -> DataFrame:
    """The ``k`` closest filed vectors of every query among the closest lists that hold ``share`` of all vectors.

    (``query_id``, ``item_id``, ``distance``, ``rank``, ``scanned``, ``compared``): exact cosine distances, ties by id;
    how many codes were looked at and how many full vectors compared for the query.  ``share = 1`` visits every
    list and is exact.  Lists lie in strips of bounded bytes, or of ``block`` vectors and more where cores would
    idle; a query is sent once to every strip in which it visits a list, a crowded list is cut into several.
    """
    dim = index.centres.shape[1]
    asked = usable(queries, query_id, query_vec, dim)
    spark = queries.sparkSession
    parallel, n_items = spark.sparkContext.defaultParallelism, int(index.sizes.sum())
    first, pieces = _strips_of(index.sizes, max(1, -(-n_items // strips(n_items, dim, block, CODE_STRIP, parallel))))
    own = [np.flatnonzero((first <= x) & (x < first + pieces)) for x in range(int((first + pieces).max()))]
    q_strips = strips(asked.count(), dim, block, QUERY_STRIP, parallel)
    # At most 4096 centres and a few numbers each; arrays alone, since a broadcast's classes do not travel with the job.
    shared = spark.sparkContext.broadcast((index.centres, index.sizes, own))
    sent = T.StructType([*asked.schema.fields, T.StructField("_ic", T.IntegerType()), T.StructField("_seen", T.BinaryType())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, sizes, own = shared.value
        step = max(1, MATRIX_CELLS // len(centres))
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            seen = _to_visit(_matrix(batch.column("_vec")), centres, sizes, share)
            for strip, lists in enumerate(own):
                rows = np.flatnonzero(seen[:, lists].any(axis=1))
                if not len(rows):
                    continue
                bits = np.packbits(seen[np.ix_(rows, lists)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(rows)) for c in batch.columns), pa.array(np.full(len(rows), strip, np.int32)),
                     pa.array([x.tobytes() for x in bits], pa.binary())], names=sent.names)

    def solve(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if q.empty or i.empty:
            return pd.DataFrame({"query_id": q["_id"][:0], "item_id": i["_id"][:0], "low": [], "high": [], "scanned": []})
        lists = shared.value[2][q["_ic"].iloc[0]]
        seen = np.unpackbits(np.frombuffer(b"".join(q["_seen"]), np.uint8).reshape(len(q), -1), axis=1, count=len(lists)).astype(bool)
        i = i.sort_values("_list", kind="stable")
        q_ids, i_ids = q["_id"].to_numpy(), i["_id"].to_numpy()
        rows, cols, low, high, scanned = _short_list(
            _matrix(q["_vec"]), seen, q_ids, shared.value[0][lists], np.searchsorted(lists, i["_list"].to_numpy()), i_ids,
            np.frombuffer(b"".join(i["_code"]), np.int8).reshape(len(i), dim), i["_scale"].to_numpy(),
            i["_err"].to_numpy() + MARGIN, k, skip_same_id)
        order = np.argsort(rows, kind="stable")
        rows, cols = rows[order], cols[order]
        first = np.append(True, rows[1:] != rows[:-1]) if len(rows) else np.zeros(0, bool)
        return pd.DataFrame({"query_id": q_ids[rows], "item_id": i_ids[cols], "low": low[order], "high": high[order],
                             "scanned": first * scanned[rows]})

    places = F.broadcast(spark.createDataFrame(
        [(n, int(a), int(b)) for n, (a, b) in enumerate(zip(first, pieces))], "_list int, _first int, _pieces int"))
    q = asked.mapInArrow(send, sent).withColumn("_qc", F.pmod(F.xxhash64("_id"), F.lit(q_strips)).cast("int"))
    i = index.rows.join(places, "_list").select(
        "_id", "_list", "_code", "_scale", "_err", (F.col("_first") + F.pmod(F.xxhash64("_id"), "_pieces")).cast("int").alias("_ic"),
        F.explode(F.sequence(F.lit(0), F.lit(q_strips - 1))).alias("_qc"))
    kinds = [asked.schema["_id"].dataType.simpleString(), index.rows.schema["_id"].dataType.simpleString()]
    listed = q.groupBy("_qc", "_ic").cogroup(i.groupBy("_qc", "_ic")).applyInPandas(
        solve, f"query_id {kinds[0]}, item_id {kinds[1]}, low double, high double, scanned bigint")
    by_query = Window.partitionBy("query_id")
    reach = F.max(F.when(F.col("_n") == k, F.col("low"))).over(by_query)
    short = (listed.withColumn("_n", F.row_number().over(by_query.orderBy(F.desc("low"))))
             .withColumn("scanned", F.sum("scanned").over(by_query))
             .withColumn("_floor", reach).where(F.col("high") >= F.coalesce("_floor", F.lit(-2.0)))
             .withColumn("compared", F.count("*").over(by_query))
             .select("query_id", "item_id", "scanned", "compared"))
    full = index.rows.select(F.col("_id").alias("item_id"), F.col("_vec").alias("_i"))
    pairs = short.join(full, "item_id").join(asked.select(F.col("_id").alias("query_id"), F.col("_vec").alias("_q")), "query_id")

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        if a.empty:
            return pd.Series([], dtype="float64")
        return pd.Series(np.round(1.0 - np.einsum("nd,nd->n", _matrix(a), _matrix(b)), TIE_DIGITS))

    order = by_query.orderBy("distance", "item_id")
    return (pairs.withColumn("distance", distance("_q", "_i")).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).select("query_id", "item_id", "distance", "rank", "scanned", "compared"))


def search_one(index: Lists, query: Sequence[float], k: int, where=None, columns: Sequence[str] = (),
               first: int = 2) -> tuple[DataFrame, int]:
    """(the ``k`` filed vectors closest to one query under a filter, number of lists read): exact.

    Lists are visited in order of the smallest angle any of their vectors can have to the query, a few more at a
    time; those whose smallest angle lies beyond the k-th found are never read.  ``where`` is a condition on kept columns.
    """
    spark = index.rows.sparkSession
    unit = np.asarray(query, np.float64) / np.linalg.norm(query)
    angle = np.arccos(np.clip(index.centres @ unit, -1, 1))
    least = np.where(index.sizes > 0, np.maximum(angle - index.radius, 0), np.inf)
    order = [int(x) for x in np.argsort(least) if index.sizes[x]]
    best, at, wave = [], 0, first

    @F.pandas_udf("double")
    def distance(vecs: pd.Series) -> pd.Series:
        return pd.Series(np.round(1.0 - _matrix(vecs) @ unit, TIE_DIGITS) if len(vecs) else [], dtype="float64")

    while at < len(order):
        reach = np.arccos(np.clip(1 - best[k - 1]["distance"], -1, 1)) if len(best) >= k else np.inf
        group = [x for x in order[at:at + wave] if least[x] <= reach + MARGIN]
        if not group:
            break
        rows = spark.read.schema(index.rows.schema).option("basePath", index.path).parquet(*[f"{index.path}/_list={x}" for x in group])
        rows = rows if where is None else rows.where(where)
        found = rows.withColumn("distance", distance("_vec")).select("_id", *columns, "distance").orderBy("distance", "_id").limit(k)
        best = sorted([*best, *found.collect()], key=lambda r: (r["distance"], r["_id"]))[:k]  # at most 2k rows
        at, wave = at + wave, wave * 2
    schema = T.StructType([*index.rows.select("_id", *columns).schema.fields, T.StructField("distance", T.DoubleType())])
    return spark.createDataFrame(best, schema), min(at, len(order))

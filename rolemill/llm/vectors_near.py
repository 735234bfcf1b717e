"""Near-duplicate vectors inside labels: PCA-ordered tiled comparison.

Vectors are turned onto the principal axes of the table.  Linked unit vectors are close
on every axis, so cells on the leading axes meet only their neighbours; cells are cut
into tiles of bounded size.  A pair of tiles multiplies the leading axes first; what the
other axes can add is at most the product of the two suffix norms, and pairs that cannot
reach the threshold drop out before the next axes.  Pairs that are left are decided on
the original vectors.  Equal vectors are one vector with a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.llm.graph import components
from rolemill.plans.session import materialize

TILE = 2048
SLACK = 1e-9  # rounding allowance of the bounds, never of the decision


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vector: str):
    """Vectors that can link: not null or empty, all components present and finite, not zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, its axes by falling variance of the unit vectors.

    Only sums of products leave the tasks, ``length**2`` numbers each.
    """
    def products(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                m = _matrix(batch.filter(pa.array(dims == d)).column("vec"))
                m = m / np.linalg.norm(m, axis=1, keepdims=True)
                sums[d] = sums.get(d, 0) + m.T @ m
        for d, s in sums.items():
            i = np.arange(d * d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d)), pa.array(i), pa.array(s.ravel())],
                                             names=["dim", "i", "s"])

    rows = (vectors.select("dim", "vec").mapInArrow(products, "dim long, i long, s double")
            .groupBy("dim", "i").agg(F.sum("s").alias("s")).orderBy("dim", "i").toPandas())
    out = {}
    for d, part in rows.groupby("dim"):
        _, axes = np.linalg.eigh(part["s"].to_numpy().reshape(int(d), int(d)))
        out[int(d)] = np.ascontiguousarray(axes[:, ::-1])
    return out


def close_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all pairs of rows with cosine at or above the threshold."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ra, rb = (a / na[:, None]) @ axes, (b / nb[:, None]) @ axes
    d = ra.shape[1]
    ends = sorted({min(d, e) for e in (max(1, d // 8), max(1, d // 4), max(1, d // 2), d)})
    rest = lambda r, e: np.sqrt(np.maximum((r[:, e:] ** 2).sum(1), 0.0))
    at = ends[0]
    part = ra[:, :at] @ rb[:, :at].T
    i, j = np.nonzero(part + np.outer(rest(ra, at), rest(rb, at)) >= cosine - SLACK)
    dots = part[i, j]
    for end in ends[1:]:
        out = []
        for s in range(0, len(i), 200_000):
            p, q = i[s:s + 200_000], j[s:s + 200_000]
            x = dots[s:s + 200_000] + np.einsum("nd,nd->n", ra[p, at:end], rb[q, at:end])
            out.append((x, x + rest(ra, end)[p] * rest(rb, end)[q] >= cosine - SLACK))
        dots, ok = (np.concatenate(c) for c in zip(*out)) if out else (dots, np.zeros(0, bool))
        i, j, dots, at = i[ok], j[ok], dots[ok], end
    exact = [np.einsum("nd,nd->n", a[i[s:s + 200_000]], b[j[s:s + 200_000]]) for s in range(0, len(i), 200_000)]
    ok = (np.concatenate(exact) if exact else np.zeros(0)) / (na[i] * nb[j]) >= cosine
    return i[ok], j[ok]


def _spanning(nodes: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component instead of all links: (node, smallest node of its component)."""
    root = np.arange(nodes)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before, root.copy())
        root = root[root]
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(nodes))
    return moved, root[moved]


def near_vectors(table: DataFrame, cosine: float = 0.93, id: str = "vec_id", vector: str = "embedding",
                 label: str = "label", tile: int = TILE) -> DataFrame:
    """(id, ``n_links``, ``component_id``, ``kept``) for every row of ``table``.

    Rows link when their labels are equal and not null, their vectors have one length and
    a cosine of at least ``cosine`` in double precision.  Vectors that are null, empty or
    zero, or hold null or non-finite components, and rows without a label, link with
    nothing.  Repeated rows count as separate vectors.  ``cosine`` must be positive.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the threshold lies above 0 and at most at 1")
    rows = table.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"),
                        F.col(label).alias("label"))
    good = rows.where(usable("vec") & F.col("label").isNotNull())
    groups = materialize(good.groupBy("label", "vec").agg(F.count("*").alias("copies"), F.min("id").alias("low"))
                         .select(F.monotonically_increasing_id().alias("gid"), "label", "vec", "copies", "low",
                                 F.size("vec").cast("long").alias("dim")), "vectors")
    axes = principal_axes(groups)
    width = float(np.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK)

    def place(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cells = np.zeros((len(dims), 2), np.int64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                m = _matrix(batch.take(pa.array(at)).column("vec"))
                lead = (m / np.linalg.norm(m, axis=1, keepdims=True)) @ axes[d][:, :2]
                cells[at, :lead.shape[1]] = np.floor(lead / width)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("gid", "label", "vec", "copies", "dim")), pa.array(cells[:, 0]),
                 pa.array(cells[:, 1])], names=["gid", "label", "vec", "copies", "dim", "x", "y"])

    kind = dict(table.dtypes)[next(c for c in table.columns if c == label)]
    placed = materialize(groups.mapInArrow(
        place, f"gid long, label {kind}, vec array<double>, copies long, dim long, x long, y long"), "cells")
    cell = ["label", "dim", "x", "y"]
    tiles = materialize(placed.groupBy(*cell).agg(F.ceil(F.count("*") / tile).cast("long").alias("tiles")), "tiles")
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                               for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)))))
    there = tiles.select("label", "dim", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("tiles").alias("tiles2"))
    met = (tiles.withColumn("step", near).withColumn("x2", F.col("x") + F.col("step.i"))
           .withColumn("y2", F.col("y") + F.col("step.j")).join(there, ["label", "dim", "x2", "y2"]))
    pairs = (met.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
             .withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles2") - 1)))
             .where("x <> x2 or y <> y2 or s <= t"))
    pairs = materialize(pairs.select(*cell, "s", "x2", "y2", "t", F.monotonically_increasing_id().alias("pair"),
                                     ((F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2"))
                                      & (F.col("s") == F.col("t"))).alias("own")), "pairs")
    rows_in = (placed.join(tiles, cell).withColumn("s", F.pmod(F.xxhash64("gid"), F.col("tiles")))
               .select(*cell, "s", "gid", "copies", "vec"))
    left = rows_in.join(pairs.select(*cell, "s", "pair", "own"), [*cell, "s"]).select("pair", "own", "gid", "copies", "vec", "dim")
    right = (rows_in.join(pairs.where("not own").select("label", "dim", F.col("x2").alias("x"), F.col("y2").alias("y"),
                                                        F.col("t").alias("s"), "pair"), [*cell, "s"])
             .select("pair", "gid", "copies", "vec").toDF("pair", "gid", "copies", "vec"))  # columns of its own

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        gids, links, roots = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(a):
            own = a["own"][0].as_py()
            b = a if own else b
            if len(b):
                i, j = close_pairs(_matrix(a["vec"]), _matrix(b["vec"]), axes[a["dim"][0].as_py()], cosine)
                if own:
                    i, j = i[i < j], j[i < j]
                    gids, copies = a["gid"].to_numpy(), a["copies"].to_numpy()
                else:
                    gids = np.concatenate((a["gid"].to_numpy(), b["gid"].to_numpy()))
                    copies = np.concatenate((a["copies"].to_numpy(), b["copies"].to_numpy()))
                    j = j + len(a)
                links = np.bincount(i, copies[j], len(gids)) + np.bincount(j, copies[i], len(gids))
                moved, root = _spanning(len(gids), i, j)
                roots = gids.copy()
                roots[moved] = gids[root]
                some = links > 0
                gids, links, roots = gids[some], links[some].astype(np.int64), roots[some]
        return pa.table([pa.array(gids), pa.array(links, pa.int64()), pa.array(roots)], names=["gid", "links", "root"])

    found = materialize(left.groupBy("pair").cogroup(right.groupBy("pair")).applyInArrow(
        compare, "gid long, links long, root long"), "links")
    counts = found.groupBy("gid").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("gid").alias("a"), F.col("root").alias("b")))
    facts = (groups.select("gid", "label", "vec", "copies", "low").join(counts, "gid", "left")
             .join(linked.select(F.col("node").alias("gid"), "root"), "gid", "left")
             .withColumn("root", F.coalesce("root", "gid")))
    lowest = facts.groupBy("root").agg(F.min("low").alias("component_id"))
    facts = facts.join(lowest, "root").select(
        F.col("label").alias("_label"), F.col("vec").alias("_vec"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = rows.join(facts, usable("vec") & (F.col("label") == F.col("_label")) & (F.col("vec") == F.col("_vec")), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"), (F.col("id") == component).alias("kept"))

"""Table changes as joins: fold a batch, upsert, insert-ignore, replace sets.

A batch is folded to one row per key with mergeable aggregates before any join,
so a key that makes up a large part of a batch is already reduced on the map
side and both sides of every join are unique by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.plans.broadcast import broadcast_if_small, narrow


def fold(batch: DataFrame, keys: Sequence[str], first: Sequence[str] = (), last: Sequence[str] = (),
         last_non_null: Sequence[str] = (), order: str | Column = "arrival") -> DataFrame:
    """One row per key: ``first`` columns of the earliest row, ``last`` of the latest.

    ``last_non_null`` columns take the latest value that is present.
    """
    seq = F.col(order) if isinstance(order, str) else order
    aggs = []
    if first:
        aggs.append(F.min_by(F.struct(*first), seq).alias("_first"))
    if last:
        aggs.append(F.max_by(F.struct(*last), seq).alias("_last"))
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), seq)).alias(c) for c in last_non_null]
    out = batch.groupBy(*keys).agg(*aggs or [F.lit(1).alias("_one")]).drop("_one")
    return out.select(
        *keys, *[F.col(f"_first.{c}").alias(c) for c in first],
        *[F.col(f"_last.{c}").alias(c) for c in last], *last_non_null)


def upsert(state: DataFrame, batch: DataFrame, keys: Sequence[str], insert_only: Sequence[str] = (),
           replace: Sequence[str] = (), replace_if_given: Sequence[str] = (),
           keep: Sequence[str] = ()) -> DataFrame:
    """New state after merging ``batch`` (unique by key) into ``state``.

    On a key that exists, ``insert_only`` and ``keep`` columns stay, ``replace``
    columns take the new value and ``replace_if_given`` columns take it unless
    null.  ``keep`` columns exist only in the state and start as null.
    """
    s = state.withColumn("_old", F.lit(True)).alias("s")
    b = batch.withColumn("_new", F.lit(True)).alias("b")
    joined = s.join(b, [F.col(f"s.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    is_old, is_new = F.col("s._old").isNotNull(), F.col("b._new").isNotNull()
    out = {k: F.coalesce(F.col(f"s.{k}"), F.col(f"b.{k}")) for k in keys}
    for c in insert_only:
        out[c] = F.when(is_old, F.col(f"s.{c}")).otherwise(F.col(f"b.{c}"))
    for c in replace:
        out[c] = F.when(is_new, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}"))
    for c in replace_if_given:
        out[c] = F.coalesce(F.col(f"b.{c}"), F.col(f"s.{c}"))
    for c in keep:
        out[c] = F.col(f"s.{c}")
    order = [c for c in state.columns if c in out]
    return joined.select(*[out[c].alias(c) for c in order])


def insert_ignore(state: DataFrame, batch: DataFrame, keys: Sequence[str],
                  order: str | Column = "arrival") -> DataFrame:
    """State plus the batch rows whose key is new; the earliest row of a key counts."""
    return state.unionByName(new_rows(state, batch, keys, order))


def new_rows(state: DataFrame, batch: DataFrame, keys: Sequence[str],
             order: str | Column = "arrival", narrow_state: bool = False) -> DataFrame:
    """Only the rows that insert-ignore would append.

    ``narrow_state`` suits a small, cheap batch against a large state: the batch
    is counted and the state's matching keys are found by a scan.
    """
    rest = [c for c in state.columns if c not in keys]
    folded = fold(batch, keys, first=rest, order=order).select(*state.columns)
    known = state.select(*keys)
    if narrow_state:
        known = narrow(known, batch, keys)
    return folded.join(known, list(keys), "left_anti")


def replace_sets(state: DataFrame, batch: DataFrame, key: str, value: str, values: str,
                 order: str | Column = "arrival") -> DataFrame:
    """Replace each key's set of ``value`` rows by the batch's array ``values``.

    Within a batch the latest non-empty array of a key wins; an empty or null
    array leaves the stored set alone.
    """
    seq = F.col(order) if isinstance(order, str) else order
    filled = F.size(F.coalesce(F.col(values), F.array())) > 0
    newest = (
        batch.where(filled).groupBy(key)
        .agg(F.max_by(F.array_distinct(values), seq).alias(values))
    )
    kept = state.join(newest.select(key), key, "left_anti")
    return kept.select(key, value).unionByName(newest.select(key, F.explode(values).alias(value)))


def delete_with_children(parent: DataFrame, dead: Column, parent_key: str,
                         children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Drop parents where ``dead`` holds, and every child row that refers to one.

    Children are anti-joined with the dropped keys; when these are few, the
    children are filtered in place.
    """
    gone = F.coalesce(dead, F.lit(False))
    keys = broadcast_if_small(parent.where(gone).select(F.col(parent_key).alias("_dead")))
    out = {"parent": parent.where(~gone)}
    for name, (child, fk) in children.items():
        out[name] = child.join(keys, child[fk] == keys["_dead"], "left_anti")
    return out

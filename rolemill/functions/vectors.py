"""Vector expressions: norms, cosine, literals, dimension checks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemill.functions.text import round_half_up

EMBEDDING_DIM = 384


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column) -> Column:
    return F.sqrt(_sum(F.transform(vec, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(vec: Column) -> Column:
    """Unit-length copy in double precision; a zero vector stays as it is."""
    length = norm(vec)
    return F.transform(vec, lambda x: x.cast("double") / F.when(length == 0, 1.0).otherwise(length))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - cos``; null when one of the vectors has no direction."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, 1.0 - dot(a, b) / lengths)


def cosine_distance_to(vec: Column, query: Sequence[float]) -> Column:
    """Cosine distance to one known vector; null for vectors of another length.

    Arrow hands whole columns of vectors to one matrix product, which beats
    element-wise lambdas by far at usual dimensions; only the vectors leave the JVM.
    """
    target = np.asarray(query, dtype=np.float64)
    target_norm = np.linalg.norm(target)

    @F.pandas_udf("double")
    def distance(vecs: pd.Series) -> pd.Series:
        if vecs.empty:
            return pd.Series([], dtype="float64")
        mat = np.vstack([np.asarray(v, dtype=np.float64) for v in vecs])
        lengths = np.linalg.norm(mat, axis=1) * target_norm
        with np.errstate(divide="ignore", invalid="ignore"):
            cos = np.where(lengths > 0, (mat @ target) / lengths, np.nan)
        return pd.Series(1.0 - cos)

    fits = F.size(vec) == len(target)
    usable = F.when(fits, vec).otherwise(F.array(*[F.lit(0.0)] * len(target)).cast("array<float>"))
    return F.when(fits, F.nanvl(distance(usable), F.lit(None).cast("double")))


def score(distance: Column) -> Column:
    """Similarity shown to users: three decimals, halves up."""
    return round_half_up(1.0 - distance, 1000)


def has_dim(vec: Column, dim: int = EMBEDDING_DIM) -> Column:
    return F.coalesce(F.size(vec) == dim, F.lit(False))


def require_dim(vec: Column, dim: int = EMBEDDING_DIM) -> Column:
    """The vector itself; the job fails when a vector has another length."""
    wrong = F.raise_error(F.concat(
        F.lit(f"vector dimension mismatch: expected {dim}, got "), F.size(vec).cast("string")))
    return F.when(vec.isNull() | (F.size(vec) == dim), vec).otherwise(wrong)


def vector_literal(vec: Column) -> Column:
    """``[0.1,0.2]`` text form."""
    return F.to_json(vec)


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")

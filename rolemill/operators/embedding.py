"""Embedding queue: pick, hash, reuse cached vectors, encode the rest, write back."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.functions.identity import cv_composite, job_composite, text_key
from rolemill.functions.vectors import EMBEDDING_DIM, has_dim
from rolemill.operators.search import with_links
from rolemill.plans.broadcast import narrow
from rolemill.plans.session import materialize
from rolemill.plans.skew import join_per_key

# Encoder batch sizes and retry limit.
BATCH = 64
MAX_BATCH = 100
MAX_RETRIES = 6
MODEL = "hashed-tokens"

Encoder = Callable[[list[str]], np.ndarray]


class EncodeError(Exception):
    """A retryable encoder failure: the texts of the batch are marked failed."""


class _Buckets(dict):
    """Bucket of every token seen, worked out once; forgets all when there are too many."""

    def __init__(self, dim: int, most: int = 200_000):
        super().__init__()
        self.dim, self.most = dim, most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dim
        return found


def hashed_token_encoder(dim: int = EMBEDDING_DIM) -> Encoder:
    """Deterministic encoder without a model: token counts in hashed buckets, unit length."""
    bucket = _Buckets(dim).__getitem__

    def encode_batch(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            slots = list(map(bucket, text.lower().split()))
            if slots:
                out[row] = np.bincount(slots, minlength=dim)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)

    return encode_batch


def encode(df: DataFrame, text: str, make_encoder: Callable[[], Encoder], dim: int = EMBEDDING_DIM,
           batch: int = BATCH, keep: list[str] | None = None) -> DataFrame:
    """Add ``embedding`` and ``outcome`` (ok, failed, error) to every row.

    ``make_encoder`` runs once per task, so a model is loaded there and not per
    batch.  A vector count or length that does not fit, or an `EncodeError`,
    fails the texts of that batch; any other exception leaves them as errors.
    """
    columns = keep if keep is not None else df.columns
    size = min(batch, MAX_BATCH)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in df.select(*columns).schema) + ", embedding array<float>, outcome string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at:at + size].copy()
                texts = part[text].tolist()
                vectors, outcome = [None] * len(texts), "ok"
                try:
                    got = np.asarray(encoder(texts), dtype=np.float64)
                    if got.shape != (len(texts), dim):
                        raise EncodeError(f"expected {len(texts)} x {dim}, got {got.shape}")
                    vectors = list(got.astype(np.float32))
                except EncodeError:
                    outcome = "failed"
                except Exception:  # noqa: BLE001 - not retryable: the rows stay as they are
                    outcome = "error"
                part = part[columns]
                part["embedding"], part["outcome"] = pd.Series(vectors, index=part.index, dtype=object), outcome
                yield part

    return df.select(*dict.fromkeys([*columns, text])).mapInPandas(run, schema)


def queued(max_retries: int = MAX_RETRIES, backoff_as_of: Column | None = None) -> Column:
    """Rows to embed: pending, or failed with retries left.

    With ``backoff_as_of`` a failed row also waits ``2^retries`` seconds after
    its last attempt.
    """
    retry = (F.col("embedding_status") == "failed") & (F.col("embedding_retry_count") < max_retries)
    if backoff_as_of is not None:
        due = F.unix_micros("embedding_last_attempt_at") + F.pow(F.lit(2), F.col("embedding_retry_count")) * 1e6
        retry = retry & (F.col("embedding_last_attempt_at").isNull() | (due <= F.unix_micros(backoff_as_of)))
    return (F.col("embedding_status") == "pending") | retry


def with_skill_list(jobs: DataFrame, job_skills: DataFrame) -> DataFrame:
    """Jobs with their sorted skill array (empty when none)."""
    return with_links(jobs, "id", job_skills, "job_id", "skill", "skills")


def candidates(jobs: DataFrame, job_skills: DataFrame, cvs: DataFrame, due: Column | None = None) -> DataFrame:
    """(kind, id, attempts, text, hash) of everything that waits for a vector."""
    due = queued() if due is None else due
    waiting = jobs.where(due).select("id", "title", "company", "location", "seniority", "embedding_retry_count")
    skills = narrow(job_skills, waiting.select(F.col("id").alias("job_id")), ["job_id"])
    job_rows = with_skill_list(waiting, skills).select(
        F.lit("job").alias("kind"), "id", F.col("embedding_retry_count").alias("attempts"),
        job_composite(F.col("title"), F.col("company"), F.col("skills"), F.col("location"),
                      F.col("seniority")).alias("text"))
    cv_rows = cvs.where(due).select(
        F.lit("cv").alias("kind"), "id", F.col("embedding_retry_count").alias("attempts"),
        cv_composite(F.col("target_role"), F.col("skills"),
                     F.col("estimated_years_experience").cast("double")).alias("text"))
    return job_rows.unionByName(cv_rows).withColumn("hash", text_key(F.col("text")))


def split_by_cache(keyed: DataFrame, cache: DataFrame, key: str = "hash",
                   cache_key: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """(hits with the cached vector, misses): one row per distinct key.

    Equal texts are reduced to one before the cache is looked at.
    """
    once = keyed.groupBy(key).agg(F.first("text").alias("text"))
    entries = cache.select(F.col(cache_key).alias(key), "embedding")
    return once.join(entries, key), once.join(entries.select(key), key, "left_anti")


@dataclass
class Drained:
    """New tables after a drain, and what led to them."""

    jobs: DataFrame
    cvs: DataFrame
    cache: DataFrame
    stats: DataFrame
    results: DataFrame  # (hash, kind, id, attempts, embedding, outcome, cached) per queued row
    new_cache: DataFrame  # cache rows to append


def write_back(table: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Apply (id, vector, outcome) to a table's embedding columns.

    With ``attempts``, the count before this run, results may be applied again without counting a failure twice.
    """
    before = F.col("attempts") if "attempts" in results.columns else F.lit(None).cast("int")
    r = results.select(F.col("id").alias("_rid"), F.col("embedding").alias("_vec"),
                       F.col("outcome").alias("_outcome"), before.alias("_before"))
    ok, failed = F.col("_outcome") == "ok", F.col("_outcome") == "failed"
    changed = {
        "embedding": F.when(ok, F.col("_vec")).otherwise(F.col("embedding")),
        "embedding_status": F.when(ok, "embedded").when(failed, "failed").otherwise(F.col("embedding_status")),
        "embedding_retry_count": F.when(failed, F.coalesce("_before", "embedding_retry_count") + 1).otherwise(
            F.col("embedding_retry_count")),
        "embedding_last_attempt_at": F.when(ok | failed, as_of).otherwise(F.col("embedding_last_attempt_at")),
        "updated_at": F.when(ok, as_of).otherwise(F.col("updated_at")),
    }
    return table.join(r, table["id"] == r["_rid"], "left").withColumns(changed).drop("_rid", "_vec", "_outcome", "_before")


def text_vectors(waiting: DataFrame, cache: DataFrame, make_encoder: Callable[[], Encoder], dim: int) -> DataFrame:
    """(hash, embedding, outcome, cached) of every distinct text that waits; cached vectors are not encoded again."""
    valid = narrow(cache.where(has_dim(F.col("embedding"), dim)),
                   waiting.select(F.col("hash").alias("content_hash")).distinct(), ["content_hash"])
    hits, misses = split_by_cache(waiting, valid)
    fresh = encode(misses, "text", make_encoder, dim, keep=["hash"])
    return (hits.select("hash", "embedding", F.lit("ok").alias("outcome"), F.lit(True).alias("cached"))
            .unionByName(fresh.withColumn("cached", F.lit(False))))


def row_results(waiting: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every waiting row with its text's vector; many rows may share one text, so hot texts are split."""
    return join_per_key(waiting.select("kind", "id", "attempts", "hash"), vectors, "hash", "inner", spread=["kind", "id"])


def cache_rows(vectors: DataFrame, as_of: Column, dim: int, model: str) -> DataFrame:
    return vectors.where(~F.col("cached") & (F.col("outcome") == "ok")).select(
        F.col("hash").alias("content_hash"), "embedding", F.lit(model).alias("model"),
        F.lit(dim).alias("dim"), as_of.alias("created_at"))


def drain_queue(jobs: DataFrame, job_skills: DataFrame, cvs: DataFrame, cache: DataFrame,
                make_encoder: Callable[[], Encoder], as_of: Column, dim: int = EMBEDDING_DIM,
                model: str = MODEL, due: Column | None = None) -> Drained:
    """Embed the whole queue in one pass.

    The queue and the encoder's output are written to the shared folder once:
    several results depend on them, and a lost executor must not call the
    encoder again.
    """
    waiting = materialize(candidates(jobs, job_skills, cvs, due), "queue")
    vectors = materialize(text_vectors(waiting, cache, make_encoder, dim), "vectors")
    results = row_results(waiting, vectors)
    new_cache = cache_rows(vectors, as_of, dim, model)
    return Drained(
        jobs=write_back(jobs, results.where(F.col("kind") == "job"), as_of),
        cvs=write_back(cvs, results.where(F.col("kind") == "cv"), as_of),
        cache=cache.unionByName(new_cache),
        stats=tick_stats(results),
        results=results,
        new_cache=new_cache,
    )


def tick_stats(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("outcome") == "ok").alias("embedded"),
        F.count_if(F.col("cached")).alias("cached"),
        F.count_if(F.col("outcome") != "ok").alias("failed"),
    )

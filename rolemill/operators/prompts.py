"""Prompt contexts, response cache and the usage log."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.functions.identity import TOP_CV_SKILLS, by_occurrences, entity_version, prompt_key
from rolemill.plans.session import materialize
from rolemill.plans.skew import first_per_key, join_per_key

USAGE_PAGE = 100


def profile_context(role: Column, years: Column, skills: Column) -> Column:
    """One sentence about a profile."""
    listed = F.array_join(F.slice(by_occurrences(skills), 1, TOP_CV_SKILLS), ", ")
    shown = F.when(years == F.floor(years), F.floor(years).cast("string")).otherwise(years.cast("string"))
    return F.concat(
        F.lit("User CV profile: target role "), F.coalesce(role, F.lit("unknown")), F.lit("; "),
        F.coalesce(shown, F.lit("?")), F.lit(" years experience; skills: "),
        F.coalesce(F.nullif(listed, F.lit("")), F.lit("none detected")), F.lit("."))


def job_context(summary: Column) -> Column:
    return F.concat(F.lit("Referenced job: "), summary, F.lit("."))


def with_context(prompts: DataFrame, cvs: DataFrame, jobs: DataFrame, system: str) -> DataFrame:
    """Prompts (cv_id, job_id, message, model) with content, cache key and reject reason.

    Many prompts may refer to one profile or posting, so both lookups split hot
    ids.  A reference that does not exist rejects the prompt.
    """
    cv_side = cvs.select(
        F.col("id").alias("cv_id"), F.col("updated_at").alias("_cv_at"),
        profile_context(F.col("target_role"), F.col("estimated_years_experience"),
                        F.col("skills")).alias("_cv"))
    job_side = jobs.select(F.col("id").alias("job_id"), F.col("updated_at").alias("_job_at"),
                           job_context(F.col("summary")).alias("_job"))
    joined = join_per_key(join_per_key(prompts, cv_side, "cv_id"), job_side, "job_id", keys_of=prompts)
    context = F.concat_ws("\n", "_cv", "_job")
    return joined.withColumns({
        "reject_reason": F.when(F.col("cv_id").isNotNull() & F.col("_cv").isNull(), "cv not found")
        .when(F.col("job_id").isNotNull() & F.col("_job").isNull(), "job not found"),
        "content": F.when(context == "", F.col("message")).otherwise(
            F.concat(context, F.lit("\n\nQuestion: "), F.col("message"))),
        "prompt_hash": prompt_key(F.lit(system), F.col("model"), F.col("message"),
                                  entity_version(F.col("cv_id"), F.col("_cv_at")),
                                  entity_version(F.col("job_id"), F.col("_job_at"))),
    }).drop("_cv", "_cv_at", "_job", "_job_at")


def cached_replies(prompts: DataFrame, cache: DataFrame, key: str = "prompt_hash",
                   reply: str = "response_text") -> DataFrame:
    """Prompts with the stored reply, null where there is none."""
    return join_per_key(prompts, cache.select(key, reply), key)


def cache_hits(prompts: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """Mark every prompt that repeats an earlier one."""
    return first_per_key(prompts, [key], order, "_first").withColumn("cached", ~F.col("_first")).drop("_first")


@dataclass
class Answered:
    """What a run of prompts gave; ``usage`` and ``new_cache`` are rows to append."""

    answers: DataFrame  # the prompts with response_text, cached and reject_reason
    usage: DataFrame
    new_cache: DataFrame


def run_prompts(asked: DataFrame, cvs: DataFrame, jobs: DataFrame, cache: DataFrame, system: str,
                reply: Callable[[DataFrame], DataFrame]) -> Answered:
    """Answer prompts (id, user_key, model, message, cv_id, job_id, created_at) from the cache, else by ``reply``.

    ``reply`` adds ``response_text``, ``prompt_tokens``, ``completion_tokens`` and ``latency_ms`` to rows with
    ``content`` and ``model``.  It sees every distinct unanswered prompt once, the earliest; repeats of it are
    cache hits like any other: they cost no tokens.  A prompt whose profile or posting is unknown is rejected and
    leaves no usage.
    """
    full = materialize(cached_replies(with_context(asked, cvs, jobs, system), cache), "prompts")
    good = F.col("reject_reason").isNull()
    missing = first_per_key(full.where(good & F.col("response_text").isNull()).drop("response_text"),
                            ["prompt_hash"], ["created_at", "id"], "_first")
    fresh = materialize(reply(missing.where("_first").select("id", "created_at", "prompt_hash", "model", "content")), "replies")
    known = full.where(good & F.col("response_text").isNotNull()).withColumn("cached", F.lit(True))
    text = fresh.select("prompt_hash", "response_text")
    answered = join_per_key(missing, text, "prompt_hash", "inner", spread=["id"]).withColumn("cached", ~F.col("_first")).drop("_first")
    rejected = full.where(~good).withColumn("cached", F.lit(None).cast("boolean"))
    answers = known.unionByName(answered)
    cost = fresh.select(F.col("id").alias("_id"), "prompt_tokens", "completion_tokens", "latency_ms")
    zero = {c: F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("prompt_tokens", "completion_tokens", "latency_ms")}
    usage = answers.join(cost, answers["id"] == cost["_id"], "left").select(
        "id", "user_key", "model", zero["prompt_tokens"], zero["completion_tokens"], "cached", zero["latency_ms"], "created_at")
    return Answered(answers.unionByName(rejected), usage,
                    fresh.select("prompt_hash", "response_text", "model", "created_at"))


def usage_log(usage: DataFrame, user: str | None = None, n: int = USAGE_PAGE,
              order: Sequence[str] = ("created_at", "id"), user_column: str = "user_key",
              newest: bool = False) -> DataFrame:
    """The oldest (or newest) ``n`` entries; a user sees those among them that are their own."""
    by = [F.desc(c) if newest else F.asc(c) for c in order]
    entries = usage.orderBy(*by).limit(n)
    return entries if user is None else entries.where(F.col(user_column) == user)


def usage_rollup(usage: DataFrame, by: Sequence[str], tokens: Sequence[str], cached: str, latency: str,
                 percentile: float | None = None) -> DataFrame:
    """Calls, token sums, cached share and latency per group; all partial aggregates."""
    aggs = [F.count("*").alias("calls"), *[F.sum(t).alias(f"sum_{t}") for t in tokens],
            F.avg(F.col(cached).cast("double")).alias("cached_rate"),
            F.avg(latency).alias("avg_latency"), F.max(latency).alias("max_latency")]
    if percentile is not None:
        aggs.append(F.percentile_approx(latency, percentile).alias("latency_percentile"))
    return usage.groupBy(*by).agg(*aggs)


SKETCH_K = 400  # ranks are right to about 0.7 in a hundred


def latency_sketches(usage: DataFrame, by: Sequence[str], latency: str) -> DataFrame:
    """(by, calls, sketch): a quantile sketch of the latencies of each group, a few kilobytes however many calls.

    Kept per tier, model and day, sketches answer for any span of days without reading the log again.
    Missing latencies are left out; a group without any has a null sketch.
    """
    value = F.col(latency).cast("double")
    return usage.groupBy(*by).agg(F.count(value).alias("calls"), F.kll_sketch_agg_double(value, SKETCH_K).alias("sketch"))


def latency_over(sketches: DataFrame, by: Sequence[str], percentiles: Sequence[float]) -> DataFrame:
    """(by, calls, p50, ...): percentiles over all sketches of a group, merged."""
    kept = sketches.where(F.col("calls") > 0)
    merged = kept.groupBy(*by).agg(F.sum("calls").alias("calls"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("_all"))
    names = {p: f"p{100 * p:g}".replace(".", "_") for p in percentiles}
    return merged.select(*by, "calls", *[F.kll_sketch_get_quantile_double("_all", F.lit(float(p))).alias(n)
                                         for p, n in names.items()])

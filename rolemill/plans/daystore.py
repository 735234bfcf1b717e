"""Postings as append-only tables by day: narrow rows that change often apart from wide ones that do not.

A sighting writes one short row; a text is written when it is new or differs; a vector, a
source link or a skill set is a row of its own.  Nothing is rewritten in place, so a batch costs
what it brings, whatever the table holds.  Rows carry the number of the change that wrote
them, and the latest one of a key counts.

Retention drops whole day folders of sightings: what is in them is either dead or seen again
in a later folder.  Of the other tables' expiring folders the rows still in use move to the
current day first, so a row is written again at most once per retention period.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolemill import schemas
from rolemill.functions.vectors import EMBEDDING_DIM
from rolemill.operators.embedding import (
    MODEL, Encoder, cache_rows, candidates, queued, row_results, text_vectors, tick_stats,
)
from rolemill.operators.search import STALE_DAYS
from rolemill.operators.upsert import fold, new_rows
from rolemill.plans.broadcast import narrow
from rolemill.plans.files import Files
from rolemill.plans.ingest import FIRST_WINS, LAST_GIVEN_WINS, LAST_WINS, source_links
from rolemill.plans.session import materialize
from rolemill.plans.store import Delivery

DAY, SEQ = "day", "seq"
WIDE = ["description", "summary"]
SHORT = ["id", "content_hash", *FIRST_WINS, "location", *LAST_GIVEN_WINS, "fetched_at", "last_seen_at", "updated_at"]

_TYPES = dict(column.split(" ", 1) for column in schemas.JOBS.split(", "))


def _ddl(names: list[str]) -> str:
    return ", ".join(f"{n} {_TYPES[n]}" for n in names)


#: Table name: schema without day and change number.
TABLES = {
    "postings": f"{_ddl(SHORT)}, text_key string, text_seq bigint",
    "posting_texts": f"id string, {_ddl(WIDE)}",
    "posting_vectors": "id string, " + _ddl(["embedding", "embedding_status", "embedding_retry_count",
                                              "embedding_last_attempt_at", "updated_at"]),
    "posting_sources": schemas.JOB_SOURCES,
    "posting_skills": "job_id string, skills array<string>",
    "embedding_cache": schemas.EMBEDDING_CACHE,
}
#: Tables whose rows refer to a posting, and the column that does.
CHILDREN = {"posting_texts": "id", "posting_vectors": "id", "posting_sources": "job_id", "posting_skills": "job_id"}


@dataclass(frozen=True)
class DayStore:
    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _fs(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _schema(self, name: str) -> T.StructType:
        return T.StructType.fromDDL(f"{TABLES[name]}, {SEQ} bigint")

    def days(self, name: str) -> list[str]:
        return [n.removeprefix(f"{DAY}=") for n in self._names(self.path(name)) if n.startswith(f"{DAY}=")]

    def rows(self, name: str, days: list[str] | None = None) -> DataFrame:
        """All rows of a table, or those of some days, with their change numbers; other days are not listed."""
        schema = self._schema(name)
        wanted = [f"{self.path(name)}/{DAY}={d}" for d in (self.days(name) if days is None else days)]
        return self.spark.read.schema(schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], schema)

    def latest(self, name: str, key: str) -> DataFrame:
        """The latest row of every key: change numbers are compared first, rows are joined once."""
        newest = self.rows(name).groupBy(key).agg(F.max(SEQ).alias(SEQ))
        return self.rows(name).join(newest, [key, SEQ])

    def change_number(self, tag: str) -> int:
        """Number of the change with this tag; a new one gets one more than there have been."""
        folder, files = f"{self.root.rstrip('/')}/_changes", Files(self.spark)
        held = files.read(f"{folder}/{tag}")
        return int(held if held is not None else files.write_once(f"{folder}/{tag}", str(len(files.names(folder)) + 1)))

    def append_once(self, name: str, rows: DataFrame, day: str, tag: str) -> bool:
        """Add rows to a day's folder, once per ``tag``; False if they were added before.

        Rows are staged whole and their files renamed into the folder, under names that begin with the tag;
        a run that dies in between is finished by the next one from what was staged.
        """
        root = self.root.rstrip("/")
        fs, marker = self._fs(f"{root}/_appended/{tag}/{name}")
        if fs.exists(marker):
            return False
        staged = f"{root}/_staged/{tag}/{name}"
        if not fs.exists(self._fs(f"{staged}/_SUCCESS")[1]):
            typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self._schema(name)])
            typed.write.mode("overwrite").parquet(staged)
        target = f"{self.path(name)}/{DAY}={day}"
        fs.mkdirs(self._fs(target)[1])
        for file in self._names(staged):
            if file.startswith("part-"):
                fs.rename(self._fs(f"{staged}/{file}")[1], self._fs(f"{target}/{tag}-{file}")[1])
        fs.create(marker).close()
        fs.delete(self._fs(staged)[1], True)
        return True

    def drop_days(self, name: str, days: list[str]) -> None:
        for day in days:
            fs, path = self._fs(f"{self.path(name)}/{DAY}={day}")
            fs.delete(path, True)

    # Retention leaves the time before which nothing counts any more.

    def retire_before(self, micros: int) -> None:
        fs, path = self._fs(f"{self.root.rstrip('/')}/_retired/{micros}")
        if not fs.exists(path):
            fs.create(path).close()

    def retired_before(self) -> int | None:
        found = [int(n) for n in self._names(f"{self.root.rstrip('/')}/_retired")]
        return max(found, default=None)


def current(store: DayStore) -> DataFrame:
    """The narrow row of every posting that counts."""
    found = store.latest("postings", "content_hash")
    cut = store.retired_before()
    return found if cut is None else found.where(F.unix_micros("last_seen_at") >= cut)


def read_jobs(store: DayStore, wide: bool = True) -> DataFrame:
    """Postings in the columns of the job table; without ``wide``, text and vector are left out and not read."""
    short = current(store)
    state = store.latest("posting_vectors", "id").select(
        "id", *(["embedding"] if wide else []), "embedding_status", "embedding_retry_count", "embedding_last_attempt_at",
        F.col("updated_at").alias("_embedded_at"))
    out = short.join(state, "id", "left").withColumns({
        "embedding_status": F.coalesce("embedding_status", F.lit("pending")),
        "embedding_retry_count": F.coalesce("embedding_retry_count", F.lit(0)),
        "updated_at": F.coalesce("_embedded_at", "updated_at")})
    if wide:
        texts = store.rows("posting_texts").withColumnRenamed(SEQ, "text_seq")
        out = out.join(texts, ["id", "text_seq"])
    return out.select(*[c for c in _TYPES if wide or c not in (*WIDE, "embedding")])


def read_links(store: DayStore) -> tuple[DataFrame, DataFrame]:
    """(source links, skills) of the postings that count, a row per link."""
    ids = current(store).select(F.col("id").alias("job_id"))
    links = store.rows("posting_sources").drop(SEQ).join(ids, "job_id", "left_semi")
    skills = store.latest("posting_skills", "job_id").join(ids, "job_id", "left_semi")
    return links, skills.select("job_id", F.explode("skills").alias("skill"))


class _Once:
    """Decisions of one change, kept by its delivery; a batch run keeps them in the shared folder."""

    def __init__(self, store: DayStore, delivery: Delivery | None, tag: str | None):
        self.delivery = delivery
        self.tag = tag or self.note("tag", lambda: {"tag": uuid.uuid4().hex})["tag"]
        self.number = store.change_number(self.tag)

    def note(self, name: str, make: Callable[[], dict]) -> dict:
        return self.delivery.note(name, make) if self.delivery else make()

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return self.delivery.stage(name, make) if self.delivery else materialize(make(), name)


def _day(store: DayStore, as_of: Column) -> str:
    return store.spark.range(1).select(F.to_date(as_of).cast("string")).first()[0]


def sight(store: DayStore, batch: DataFrame, as_of: Column, delivery: Delivery | None = None,
          tag: str | None = None) -> dict[str, int]:
    """Take in one batch of enriched postings: {inserted, updated, texts}.

    As with `upsert_jobs`: the first sighting supplies title, company, link, level, pay and remote flag; every
    later one moves location, text, the last sighting and a given posting date.
    """
    once = _Once(store, delivery, tag)
    day = once.note("day", lambda: {"day": _day(store, as_of)})["day"]

    def merge() -> DataFrame:
        folded = fold(batch, ["content_hash"], first=["id", *FIRST_WINS], last=LAST_WINS, last_non_null=LAST_GIVEN_WINS)
        keys = folded.select("content_hash")
        old = narrow(current(store), keys, ["content_hash"])
        old = old.select("content_hash", *[F.col(c).alias(f"_{c}") for c in (
            *FIRST_WINS, *LAST_GIVEN_WINS, "fetched_at", "updated_at", "text_key", "text_seq")], F.lit(True).alias("_old"))
        key = F.sha2(F.to_json(F.struct(*WIDE), {"ignoreNullFields": "false"}), 256)
        is_old = F.col("_old").isNotNull()
        joined = folded.withColumn("text_key", key).join(old, "content_hash", "left").withColumn(
            "new_text", ~is_old | (F.col("text_key") != F.col("_text_key")))
        return joined.select(
            "id", "content_hash", *[F.when(is_old, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in FIRST_WINS],
            "location", *[F.coalesce(c, f"_{c}").alias(c) for c in LAST_GIVEN_WINS],
            F.coalesce("_fetched_at", as_of).alias("fetched_at"), as_of.alias("last_seen_at"),
            F.coalesce("_updated_at", as_of).alias("updated_at"), "text_key",
            F.when(F.col("new_text"), F.lit(once.number)).otherwise(F.col("_text_seq")).alias("text_seq"),
            *WIDE, "new_text", is_old.alias("old"), F.lit(once.number).alias(SEQ))

    rows = once.stage("sighted", merge)
    linked = once.stage("linked", lambda: batch.select("id", "source", "source_job_id", "skills", "arrival"))
    ids = rows.select(F.col("id").alias("job_id"))
    known = narrow(store.rows("posting_sources").drop(SEQ), ids, ["job_id"])
    number = F.lit(once.number).alias(SEQ)
    links = new_rows(known, source_links(linked, as_of), ["job_id", "source"]).select("*", number)
    filled = linked.where(F.size(F.coalesce("skills", F.array())) > 0)
    skills = filled.groupBy(F.col("id").alias("job_id")).agg(
        F.max_by(F.array_distinct("skills"), "arrival").alias("skills")).select("*", number)
    store.append_once("posting_texts", rows.where("new_text"), day, once.tag)
    store.append_once("posting_sources", links, day, once.tag)
    store.append_once("posting_skills", skills, day, once.tag)
    store.append_once("postings", rows, day, once.tag)  # last: only now the others are seen
    counts = rows.agg(F.count_if(~F.col("old")).alias("inserted"), F.count_if("old").alias("updated"),
                      F.count_if("new_text").alias("texts")).first()
    return counts.asDict()


def embed(store: DayStore, make_encoder: Callable[[], Encoder], as_of: Column, dim: int = EMBEDDING_DIM,
          model: str = MODEL, delivery: Delivery | None = None, tag: str | None = None) -> dict[str, int]:
    """Embed what waits; writes a row per result and per new cache entry, and no posting again."""
    once = _Once(store, delivery, tag)
    day = once.note("day", lambda: {"day": _day(store, as_of)})["day"]
    due = read_jobs(store, wide=False).where(queued())
    none = store.spark.createDataFrame([], schemas.CV_PROFILES)
    waiting = once.stage("queue", lambda: candidates(due, read_links(store)[1], none))
    cache = store.rows("embedding_cache").drop(SEQ)
    vectors = once.stage("vectors", lambda: text_vectors(waiting, cache, make_encoder, dim))
    results = row_results(waiting, vectors)
    ok = F.col("outcome") == "ok"
    rows = results.where(F.col("outcome").isin("ok", "failed")).select(
        "id", F.when(ok, F.col("embedding")).alias("embedding"), F.when(ok, "embedded").otherwise("failed").alias("embedding_status"),
        (F.col("attempts") + F.when(ok, 0).otherwise(1)).alias("embedding_retry_count"), as_of.alias("embedding_last_attempt_at"),
        F.when(ok, as_of).alias("updated_at"), F.lit(once.number).alias(SEQ))
    fresh = cache_rows(vectors, as_of, dim, model).withColumn(SEQ, F.lit(once.number))
    store.append_once("embedding_cache", fresh, day, once.tag)
    store.append_once("posting_vectors", rows, day, once.tag)
    return tick_stats(results).first().asDict()


def retire(store: DayStore, as_of: Column, days: int = STALE_DAYS) -> dict[str, int]:
    """Forget postings not seen for ``days``: {folders dropped, rows moved to the current day}.

    A posting exactly as old as that stays.  A run that dies is simply repeated.
    """
    now = store.spark.range(1).select(F.unix_micros(as_of), F.to_date(as_of).cast("string")).first()
    cut = now[0] - days * 86_400_000_000
    store.retire_before(cut)
    first = (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=cut)).date().isoformat()
    ids = current(store).select("id", "text_seq")
    dropped = moved = 0
    for name, key in CHILDREN.items():
        old = [d for d in store.days(name) if d < first]
        if old:
            rows = store.rows(name, old)
            if name == "posting_texts":
                live = rows.join(ids.withColumnRenamed("text_seq", SEQ), ["id", SEQ], "left_semi")
            else:
                live = rows.join(ids.select(F.col("id").alias(key)), key, "left_semi")
                if name != "posting_sources":  # only the latest set or vector counts
                    live = live.join(store.rows(name).groupBy(key).agg(F.max(SEQ).alias(SEQ)), [key, SEQ], "left_semi")
            kept = materialize(live, f"kept-{name}")
            moved += kept.count()
            store.append_once(name, kept, now[1], f"roll-{first}")
            store.drop_days(name, old)
            dropped += len(old)
    old = [d for d in store.days("postings") if d < first]
    store.drop_days("postings", old)
    return {"folders": dropped + len(old), "moved": moved}

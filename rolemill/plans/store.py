"""State tables as hash-bucketed Parquet folders.

A change rewrites only the buckets its keys fall into.  The new rows are first
written to the shared folder and then swapped in with dynamic partition
overwrite, so the table is never read and replaced by the same job and a run
that dies between the two steps can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolemill import schemas
from rolemill.plans.session import materialize

BUCKET = "bucket"
MARKER = "_buckets-"

# Rows inside a file follow this column, so that its footer statistics can skip row groups.
FILE_ORDER = {"jobs": "posted_at", "chat_usage": "created_at", "rate_limit_hits": "hit_at"}

# Table name: (schema, bucketing key).
TABLES = {
    "jobs": (schemas.JOBS, "content_hash"),
    "job_sources": (schemas.JOB_SOURCES, "job_id"),
    "job_skills": (schemas.JOB_SKILLS, "job_id"),
    "companies": (schemas.COMPANIES, "name"),
    "sources": (schemas.RUN_LOG, "name"),
    "cv_profiles": (schemas.CV_PROFILES, "id"),
    "cv_skills": (schemas.CV_SKILLS, "cv_id"),
    "embedding_cache": (schemas.EMBEDDING_CACHE, "content_hash"),
    "chat_usage": (schemas.CHAT_USAGE, "id"),
    "chat_cache": (schemas.CHAT_CACHE, "prompt_hash"),
    "rate_limit_hits": (schemas.RATE_LIMIT_HITS, "user_key"),
}


class Delivery:
    """How a run keeps what it decided: a batch run simply goes on with it.

    Streams use a form that outlives the run (`rolemill.streaming.commits.BatchDelivery`).
    """

    def __init__(self, store: Store):
        self.store = store

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return make()

    def note(self, name: str, make: Callable[[], dict]) -> dict:
        return make()

    def append(self, table: str, rows: DataFrame) -> None:
        self.store.append(table, rows)


@dataclass(frozen=True)
class Store:
    """Where the state tables live and into how many buckets new ones are cut.

    A table keeps the number of buckets it was first written with, in a marker beside
    its data; later stores use that number, whatever their own.
    """

    spark: SparkSession
    root: str
    buckets: int = 16
    tables: dict = field(default_factory=lambda: dict(TABLES))

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _fs(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def bucket_count(self, name: str) -> int:
        """Buckets of a table: as recorded, or as this store would cut a new one."""
        fs, pattern = self._fs(f"{self.path(name)}/{MARKER}*")
        found = list(fs.globStatus(pattern) or [])
        return int(found[0].getPath().getName().removeprefix(MARKER)) if found else self.buckets

    def _record(self, name: str, buckets: int) -> None:
        fs, path = self._fs(f"{self.path(name)}/{MARKER}{buckets}")
        if not fs.exists(path):
            fs.create(path).close()

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(self.tables[name][1]), F.lit(self.bucket_count(name))).cast("int")

    def _schema(self, name: str) -> T.StructType:
        return T.StructType.fromDDL(self.tables[name][0])

    def _all(self, name: str) -> DataFrame:
        schema = self._schema(name).add(BUCKET, T.IntegerType())
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self._all(name).drop(BUCKET)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows that are known to be new."""
        self._write(name, rows, "append")

    def append_once(self, name: str, rows: DataFrame, tag: str) -> bool:
        """Add rows that are known to be new, once per ``tag``; False if they were added before.

        The rows are staged whole and their files then renamed into the table under names that
        begin with the tag.  A run that dies in between is finished by the next one from what was
        staged, without looking at ``rows`` again, so no row is lost or doubled.
        """
        root = self.root.rstrip("/")
        fs, marker = self._fs(f"{root}/_appended/{name}/{tag}")
        if fs.exists(marker):
            return False
        self._record(name, self.bucket_count(name))
        staged = f"{root}/_staged/{name}/{tag}"
        if not fs.exists(self._fs(f"{staged}/_SUCCESS")[1]):
            self._write(name, rows, "overwrite", staged)
        for folder in fs.listStatus(self._fs(staged)[1]):
            if folder.isDirectory():
                target = f"{self.path(name)}/{folder.getPath().getName()}"
                fs.mkdirs(self._fs(target)[1])
                for file in fs.listStatus(folder.getPath()):
                    fs.rename(file.getPath(), self._fs(f"{target}/{tag}-{file.getPath().getName()}")[1])
        fs.create(marker).close()
        fs.delete(self._fs(staged)[1], True)
        return True

    def change(self, name: str, keys: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the buckets that ``keys`` fall into by ``fn`` of their rows.

        ``fn`` must keep every row's key, and only rows of these buckets may come back.
        """
        hit = self._touched(name, keys)
        if not hit:
            return
        state = self._all(name).where(F.col(BUCKET).isin(hit)).drop(BUCKET)
        self._replace(name, fn(state), hit)

    def _touched(self, name: str, keys: DataFrame) -> list[int]:
        """Distinct bucket numbers, at most as many as the table has."""
        return [r[0] for r in keys.select(self._bucket(name).alias(BUCKET)).distinct().collect()]

    def overwrite(self, name: str, rows: DataFrame) -> None:
        """Replace the whole table."""
        self._replace(name, rows, list(range(self.bucket_count(name))))

    def _replace(self, name: str, rows: DataFrame, hit: Sequence[int]) -> None:
        staged = materialize(self._typed(name, rows), f"stage-{name}")
        self._write(name, staged, "overwrite")
        # Buckets that became empty write no files, so they are emptied explicitly.
        filled = set(self._touched(name, staged))
        for bucket in sorted(set(hit) - filled):
            self._drop(f"{self.path(name)}/{BUCKET}={bucket}")

    def _drop(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _typed(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self._schema(name)])

    def _write(self, name: str, rows: DataFrame, mode: str, staged: str | None = None) -> None:
        buckets = self.bucket_count(name)
        out = self._typed(name, rows).withColumn(BUCKET, self._bucket(name))
        # Rows of one bucket meet in a few tasks, so a bucket is a few files, not one per task.
        (out.repartition(F.col(BUCKET), F.pmod(F.xxhash64(self.tables[name][1], F.lit(1)), F.lit(4)))
         .sortWithinPartitions(BUCKET, *([FILE_ORDER[name]] if name in FILE_ORDER else []))
         .write.mode(mode).partitionBy(BUCKET)
         .option("partitionOverwriteMode", "static" if staged else "dynamic").parquet(staged or self.path(name)))
        if staged is None:
            self._record(name, buckets)

"""Session defaults and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def build_session(app: str, cores: int | None = None, shuffle_partitions: int | None = None,
                  shared_dir: str | None = None, memory: str = "12g") -> SparkSession:
    """A session with the settings every operator assumes.

    On a cluster the master, memory and checkpoint folder come from its own
    configuration; ``cores`` and ``shared_dir`` are for local runs.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if cores is not None:
        builder = (builder.master(f"local[{cores}]").config("spark.ui.enabled", "false")
                   .config("spark.driver.memory", memory))
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if shared_dir is not None:
        builder = builder.config(CHECKPOINT_CONF, shared_dir)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    A local session without that setting gets a temporary one; on a cluster the
    setting is required, because executors do not share a machine's own folders.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="rolemill-")
        spark.conf.set(CHECKPOINT_CONF, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def batches_of(spark: SparkSession, size: int | None) -> Iterator[None]:
    """What runs meanwhile hands Python batches of about ``size`` bytes, unless the session has a bound of its own."""
    own = size is not None and spark.conf.get(BATCH_CONF, None) is None
    if own:
        spark.conf.set(BATCH_CONF, str(size))
    try:
        yield
    finally:
        if own:
            spark.conf.unset(BATCH_CONF)


def materialize(df: DataFrame, name: str, partition_by: str | None = None, batch_bytes: int | None = None,
                **options) -> DataFrame:
    """Cut lineage by writing to the shared folder; survives lost executors.

    ``partition_by`` gives every value of a column a folder, ``batch_bytes`` bounds the batches that Python
    gets on the way, ``options`` are those of the writer.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    with batches_of(spark, batch_bytes):
        if partition_by:
            df.repartition(partition_by).write.options(**options).partitionBy(partition_by).parquet(path)
        else:
            df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Queries over streams write their input in as many tasks as it is read."""

from pathlib import Path

from pyspark.sql import functions as F

from rolemill.plans.session import CHECKPOINT_CONF
from workload import QUERIES


def test_a_stream_of_documents_is_not_written_by_one_task(spark, tmp_path):
    docs = spark.range(80).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit("en").alias("lang"),
        F.concat(F.lit("Text "), F.col("id") % 7).alias("text"), (F.col("id") * 10).alias("n_chars"))
    docs.repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    root = Path(spark.conf.get(CHECKPOINT_CONF).removeprefix("file:"))
    before = set(root.glob("docs-*"))
    assert QUERIES["stream_fold"](spark, str(tmp_path)).count() == 7
    source, = set(root.glob("docs-*")) - before
    assert len(list(source.glob("*.parquet"))) > 2  # two parts, each by several tasks

"""From raw documents to training ids: the stages in order, and their run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolemill.llm import stages
from rolemill.plans.session import materialize

#: Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("language_id", stages.keep_identified),
    ("ngram_jaccard_join", stages.keep_one_of_each_group),
    ("substring_dedup", stages.cut_repeats),
    ("mix_sources", stages.mix_to_weights),
    ("sentencepiece", stages.encode),
]

#: SQL can express neither the trained identifier nor the piece encoder; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and its decisions take effect.

All of them work on whole texts of any length, one text held by one task at a time, take rows that repeat as
rows of their own unless they say otherwise, keep columns they do not know (one named like a column that the
operator adds holds what the operator put there), and give an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemill.llm.jaccard import JaccardJoin
from rolemill.llm.language_id import fit, identify
from rolemill.llm.mixing import mix_sources
from rolemill.llm.pieces import encode_texts
from rolemill.llm.substring import remove_repeats


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the identifier rejects go.

    Null and empty texts and texts without a letter are rejected.  Learns from rows with a non-null ``lang``;
    without any, every document is rejected.  Repeated rows share one fate.
    """
    model = fit(docs, F.lit(True))
    return identify(docs, model).where("not rejected").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id.

    Null and empty texts are linked with nothing and all stay.  Of rows that are equal one stays; among equal
    ids the first row as read, a null id after all others.
    """
    return JaccardJoin(docs, shingle=5, percent=80).representatives()


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere; a text without any stays as it is.

    Null texts stay null; a text that recurs as a whole, or a repeated row, becomes empty and its row stays.
    """
    cut = remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.withColumn("text", text).select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their target shares, in a global shuffle.

    A source without bytes, all its texts null or empty, has no share and goes.  Rows with one id have as many
    copies each, rows without an id draw one by one.
    """
    return mix_sources(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids; a null or empty text has none."""
    import public_tokenizers

    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_text=True)

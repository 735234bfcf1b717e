"""Mixing sources to target weights by Poisson replication.

The mean repetition of a source is its target share of all bytes over its own bytes.  A
document's number of copies is the Poisson quantile, at that mean, of a number in [0, 1)
made from the hash of its id and a seed: the same in any run and on any machine.
Copies are dealt to partitions, and ordered inside them, by a hash of their own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.plans.session import materialize

SEED = "mix-1"
MOST_RATE = 500  # a table of steps is made for no more; a Poisson number of a larger mean is a sum of such


def _uniform(*parts: Column) -> Column:
    """52 bits of an MD5 digest as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def repetition_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0,
                     source: str = "source", text: str = "text") -> DataFrame:
    """(source, rate): mean copies per document, so that sources reach their share of ``epochs`` times all bytes.

    Without ``weights`` a source's share goes with the square root of its bytes.  A
    source without a weight, or without bytes, has rate 0; a null source is one source.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(
        F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")).alias("size"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.sqrt("size"))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        weighted = sizes.join(given, F.col("source").eqNullSafe(F.col("name")), "left").fillna(0.0, ["weight"])
    weighted = materialize(weighted, "sources")
    total = weighted.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    if not total["size"] or not total["weight"]:
        return weighted.select("source", F.lit(0.0).alias("rate"))
    rate = F.lit(total["size"] * epochs) * F.col("weight") / F.lit(total["weight"]) / F.col("size")
    return weighted.select("source", F.when((F.col("size") > 0) & (F.col("weight") > 0), rate).otherwise(0.0).alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """The distribution function at 0, 1, 2, ... up to where it is 1 in double precision."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    first = -rate
    step = F.aggregate(
        F.sequence(F.lit(1), most),
        F.struct(first.alias("log"), F.exp(first).alias("sum"), F.array(F.exp(first)).alias("steps")),
        lambda acc, k: F.struct(
            (acc["log"] + F.ln(rate) - F.ln(k.cast("double"))).alias("log"),
            (acc["sum"] + F.exp(acc["log"] + F.ln(rate) - F.ln(k.cast("double")))).alias("sum"),
            F.concat(acc["steps"], F.array(acc["sum"] + F.exp(acc["log"] + F.ln(rate) - F.ln(k.cast("double"))))).alias("steps")),
        lambda acc: acc["steps"])
    return F.when(rate > 0, step)


def _named(docs: DataFrame, id: str) -> DataFrame:
    """Rows with ``_mix_name``, what their draws are made from: the id, or the row itself and its number among equals.

    Rows without an id that are equal in every column are counted and told apart by number: whichever is which,
    the result is the same.
    """
    lost = docs.where(F.col(id).isNull())
    with_id = docs.where(F.col(id).isNotNull()).withColumn("_mix_name", F.col(id).cast("string"))
    if lost.isEmpty():
        return with_id
    row = F.struct(*docs.columns)
    equal = (lost.select(row.alias("row"), F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256).alias("key"))
             .groupBy("key").agg(F.first("row").alias("row"), F.count("*").cast("int").alias("n")))
    each = equal.withColumn("number", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return with_id.unionByName(each.select("row.*", F.concat_ws("|", "key", F.col("number").cast("string")).alias("_mix_name")))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, seed: str = SEED,
                id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``copy`` (from 1) and ``shuffle_key``, globally shuffled.

    Rows with the same id get the same number of copies; rows without an id draw one by one, also
    where they are equal.  Documents may get no copy.  A null or empty text is a document like any
    other, a null source a source.  A column named like an added one is replaced.  An empty table
    gives an empty result.  A rate above 500 is drawn as a sum of draws at equal parts of it.
    """
    parts = F.greatest(F.ceil(F.col("rate") / MOST_RATE), F.lit(1)).cast("int")
    steps = repetition_rates(docs, weights, epochs, source, text).withColumn("_mix_parts", parts).select(
        F.col("source").alias("_mix_source"), "_mix_parts", poisson_steps(F.col("rate") / F.col("_mix_parts")).alias("_mix_steps"))
    name = F.col("_mix_name")
    columns = [c for c in docs.columns if c not in ("copy", "shuffle_key")]

    def quantile(u: Column) -> Column:
        return F.coalesce(F.size(F.filter("_mix_steps", lambda c: c <= u)), F.lit(0))

    drawn = F.aggregate(F.sequence(F.lit(1), F.col("_mix_parts")), F.lit(0),
                        lambda n, i: n + quantile(_uniform(F.lit(seed), name, i.cast("string"))))
    count = F.when(F.col("_mix_parts") == 1, quantile(F.col("_mix_u"))).otherwise(drawn)
    copies = (_named(docs.select(*columns), id)
              .join(steps, F.col(source).eqNullSafe(F.col("_mix_source")))
              .withColumn("_mix_u", _uniform(F.lit(seed), name))
              .withColumn("_mix_n", F.when(F.col("_mix_steps").isNull(), 0).otherwise(count))
              .where("_mix_n > 0")
              .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))))
    key = F.md5(F.concat_ws("|", F.lit(seed), name, F.col("copy").cast("string")))
    return (copies.select(*columns, "copy", key.alias("shuffle_key"))
            .repartition("shuffle_key").sortWithinPartitions("shuffle_key"))

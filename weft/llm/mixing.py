"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the bytes over its actual
share. Each row draws a uniform number from a seeded hash of its id, inverts the
Poisson distribution of that mean, and is repeated that many times. The result is
shuffled globally by a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stash, join_checked, utf8_size


def hash_bits(seed: int, digits: int, *parts: Column) -> Column:
    """The first hexadecimal digits (15 at most) of the MD5 of the seed and the parts, as a number."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from a seeded hash of the parts."""
    return hash_bits(seed, 13, *parts).cast("double") / F.lit(float(2**52))


def poisson_thresholds(mean: Column) -> Column:
    """Cumulative Poisson probabilities for 0, 1, 2, ... until the tail is below 2^-52."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    step = lambda acc, i: F.struct(
        (acc["logp"] + F.log(mean) - F.log(i.cast("double"))).alias("logp"),
        F.concat(acc["cdf"], F.array(acc["cdf"][F.size(acc["cdf"]) - 1] + F.exp(acc["logp"] + F.log(mean) - F.log(i.cast("double"))))).alias("cdf"),
    )
    start = F.struct((-mean).alias("logp"), F.array(F.exp(-mean)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda a: a["cdf"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(source, mean, thresholds)``: mean repetition rates that bring sources to their target shares.

    Targets are ``weights`` (sources it doesn't name get none), or else the sources'
    byte sizes raised to ``power``. The total size stays the input's.
    """
    size = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(utf8_size(F.col(text_col))).alias("bytes"))
    if weights is None:
        want = F.pow(F.col("bytes").cast("double"), F.lit(power))
    else:
        want = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
    size = Stash(docs.sparkSession, "mixing").put("sources", size.withColumn("want", F.round(want * 1000.0)))
    whole = size.agg(F.sum("bytes").cast("double").alias("bytes"), F.sum(F.col("want").cast("decimal(38,0)")).cast("double").alias("want")).first()
    mean = F.col("want") / F.lit(whole["want"]) * F.lit(whole["bytes"]) / F.col("bytes") if whole["want"] else F.lit(0.0)
    rates = size.select("source", mean.alias("mean"))
    return rates.withColumn("thresholds", F.when(F.col("mean") > 0, poisson_thresholds(F.col("mean"))).otherwise(F.array(F.lit(1.0))))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with every row repeated by its draw, plus ``copy int`` (from 1), ``mean double`` and ``shuffle_key long``.

    Rows are dealt to partitions by the hash of (id, copy) and sorted by it there, so
    each partition is a random sample in random order. Rows with equal ids draw the
    same count; a null source is a source of its own; null texts count one byte. The
    output's columns of those names replace any that docs has. Rates are joined by a
    checked broadcast: one row per source. An empty table gives no rows.
    """
    docs = docs.drop("copy", "mean", "shuffle_key")
    rates = source_rates(docs, weights, power, source_col, text_col).withColumnRenamed("source", "__source")
    on = F.col(source_col).eqNullSafe(F.col("__source"))
    drawn = join_checked(docs, rates, on, rows=100_000)
    n = F.size(F.filter("thresholds", lambda c: c <= uniform(seed, F.col(id_col))))
    out = drawn.withColumn("__n", n).where("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    key = hash_bits(seed, 15, F.lit("shuffle"), F.col(id_col), F.col("copy"))
    out = out.withColumn("shuffle_key", key).select(*[F.col(c) for c in docs.columns], "copy", "mean", "shuffle_key")
    return out.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")

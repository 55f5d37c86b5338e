"""Sharding by proportional stratified interleaving.

Rows are ranked within their source in seeded-random order; a row's fractional rank
(rank - 1/2) / (rows of the source) spreads each source evenly over [0, 1], so cutting
the rows sorted by fractional rank gives shards that all hold the mixture.

No source is ranked by one task: hashes and fractional ranks are uniform, so rows are
dealt to even buckets of them, and a bucket's offset is a running sum over bucket counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, join_checked, utf8_size


#: A source as two columns that are never null, so that joins and windows by it share one shuffle.
SOURCE = ["__source", "__none"]
#: Positions in a block of a running sum, and entries made by one row of ``rank_buckets``.
BLOCK = 10_000


def source_key(source_col: str) -> list[Column]:
    return [F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"), F.col(source_col).isNull().alias("__none")]


def running_sums(counts: DataFrame, keys: list[str], at: str, n: str, name: str) -> DataFrame:
    """``(*keys, at, name)``: the sum of ``n`` over smaller positions of the same keys. Blocks of positions are summed
    first, so one task sees a block or the block totals, never a key's whole list. ``counts`` is read twice."""
    counts = counts.withColumn("__k", F.floor(F.col(at) / BLOCK))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    before = earlier.partitionBy(*keys).orderBy("__k")
    blocks = counts.groupBy(*keys, "__k").agg(F.sum(n).alias("__t")).select(*keys, "__k", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    inside = earlier.partitionBy(*keys, "__k").orderBy(at)
    own = F.coalesce(F.sum(n).over(inside), F.lit(0))
    return counts.join(blocks, [*keys, "__k"]).select(*keys, at, (own + F.col("__base")).alias(name))


def rank_buckets(stats: DataFrame, parts: int) -> DataFrame:
    """``(__p, __c)``: rows in each bucket of fractional ranks, from the sources' sizes ``__n`` alone.

    A source makes an entry a bucket or, if it has fewer rows than there are buckets, an entry a row: never more
    entries than rows.
    """
    sized = stats.select("__n", F.least(F.col("__n"), F.lit(parts)).alias("__m"))
    dealt = sized.select("__n", "__m", F.explode(F.expr(f"sequence(0L, (__m - 1) div {BLOCK})")).alias("__d")).repartition("__n", "__d")
    entry = dealt.select("__n", F.explode(F.expr(f"sequence(__d * {BLOCK}, least((__d + 1) * {BLOCK}, __m) - 1)")).alias("__i"))
    up_to = lambda q: f"((2 * __n * {q} + {parts - 1}) div {parts}) div 2"
    few = F.col("__n") < parts
    place = F.when(few, F.expr(f"((2 * __i + 1) * {parts}) div (2 * __n)")).otherwise(F.col("__i"))
    rows = F.when(few, F.lit(1)).otherwise(F.expr(f"{up_to('(__i + 1)')} - {up_to('__i')}"))
    return entry.groupBy(place.alias("__p")).agg(F.sum(rows.cast("long")).alias("__c"))


def interleave(
    docs: DataFrame, shards: int = 8, seed: int = 29, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    carry: list[str] | None = None, bucket_rows: int = 256,
) -> DataFrame:
    """Columns ``carry`` (default: all) of docs with ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Shards differ by one row at most; ``slot`` numbers a shard's rows from 0 without
    gaps. Rows of equal hash are ordered by id, text checksum and size, and rows equal
    in all of these take neighbouring places in any order. A null source is a source of
    its own; a null text has size 1 and checksum 0. The output's names replace columns
    of docs. An empty table gives an empty result. Each bucket holds about
    ``bucket_rows`` rows whatever the input's size; buckets have no say in where a row goes.
    """
    made = ("size", "text_crc32", "shard", "slot")
    own = [c for c in (carry or docs.columns) if c not in made]
    rows = docs.select(
        *own,
        utf8_size(F.col(text_col)).alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 12).alias("__h"),
        F.col(id_col).alias("__id"),
        *source_key(source_col),
    )
    stash = Stash(docs.sparkSession, "interleave")
    stats = stash.put("sources", docs.select(*source_key(source_col)).groupBy(*SOURCE).agg(F.count("*").alias("__n")))
    total = stats.agg(F.sum("__n")).first()[0] or 0
    parts = max(1, math.ceil(total / bucket_rows))
    rows = join_checked(rows, stats, SOURCE, rows=100_000)
    width = F.greatest(F.lit(1), F.ceil(F.col("__n") / bucket_rows))
    unit = F.col("__h").cast("double") / F.lit(float(2**52))
    rows = rows.withColumn("__b", F.least(F.floor(unit * width), width - 1).cast("long"))

    # offset of each hash bucket within its source: a running sum over bucket counts
    counts = stash.put("bucket-rows", rows.groupBy(*SOURCE, "__b").agg(F.count("*").alias("__c")))
    counts = stash.put("buckets", running_sums(counts, SOURCE, "__b", "__c", "__before"))
    rows = join_checked(rows, counts, [*SOURCE, "__b"], rows=500_000)
    order = Window.partitionBy(*SOURCE, "__b").orderBy("__h", "__id", "text_crc32", "size")
    rows = rows.withColumn("__rank", F.row_number().over(order) + F.col("__before")).drop("__before", "__b")

    # bucket of the fractional rank (2 r - 1) / (2 n), and how many rows come before it, by source sizes alone
    rows = rows.withColumn("__p", F.expr(f"((2 * __rank - 1) * {parts}) div (2 * __n)"))
    cuts = stash.put("cuts", running_sums(rank_buckets(stats, parts), [], "__p", "__c", "__below"))
    rows = join_checked(rows, cuts, "__p", rows=500_000)
    mixed = Window.partitionBy("__p").orderBy((2 * F.col("__rank") - 1) / (2.0 * F.col("__n")), F.desc("__none"), "__source", "__rank")
    rows = rows.withColumn("__g", F.row_number().over(mixed) - 1 + F.col("__below"))
    shard = F.expr(f"(__g * {shards}) div {max(total, 1)}")
    rows = rows.withColumn("shard", shard.cast("int"))
    slot = F.col("__g") - F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return rows.withColumn("slot", slot.cast("long")).select(*own, *made)

"""The relational kernel as a thin API: ten operators, one Spark operation each but for joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select(df: DataFrame, columns) -> DataFrame:
    """Pick columns; a pair (column, alias) renames."""
    return df.select(*[F.col(c[0]).alias(c[1]) if isinstance(c, tuple) and c[1] else F.col(c[0] if isinstance(c, tuple) else c) for c in columns])


def where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def project(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(*[v.alias(k) for k, v in columns.items()])


def group_by(df: DataFrame, keys: list[Column], aggregates: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[v.alias(k) for k, v in aggregates.items()])


def skip(df: DataFrame, n: int) -> DataFrame:
    return df.offset(n)


def take(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


#: Rows of one key that are joined with each other as one block: at most about the square of it in pairs.
BLOCK_ROWS = 2048


def join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Natural join on the common columns; without any it is a cross product.

    A key's rows are cut into blocks on both sides, and each pair of blocks is joined where the hash of key and blocks
    says, so that a few keys with many rows are shared out over all tasks. A row is copied once for each block of its key
    on the other side. Rows without a partner are added by anti joins.
    """
    on = [c for c in left.columns if c in right.columns]
    if not on:
        return cross(left, right)
    plain = left.join(right, on, {"inner": "inner", "left": "left", "right": "right", "outer": "full"}[how])
    types = {f.name: f.dataType for f in plain.schema.fields if plain.columns.count(f.name) == 1}
    conf, context = left.sparkSession.conf, left.sparkSession.sparkContext
    most = 4 * context.defaultParallelism
    n = max(int(conf.get("spark.sql.shuffle.partitions")), most)

    def dealt(df, other):
        """With the row's block in ``__own``, and in ``__other`` the number of blocks of its key on the other side, null if there are none.

        Blocks are given by partitions: Spark deals rows out so that a task that is repeated gets the same ones."""
        df = df.repartition(most).withColumn("__at", F.spark_partition_id())
        for name, side in (("__own", df), ("__other", other)):
            counts = side.groupBy(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(on)]).agg(F.count(F.lit(1)).alias(name))
            same = [df[f"`{k}`"] == counts[f"__k{i}"] for i, k in enumerate(on)]
            df = df.join(counts, reduce(lambda a, b: a & b, same), "left").drop(*[f"__k{i}" for i in range(len(on))])
        blocks = lambda c: F.when(F.col(c).isNotNull(), F.least(F.ceil(F.col(c) / F.lit(BLOCK_ROWS)).cast("int"), F.lit(most)))
        return df.withColumn("__own", F.pmod(F.col("__at"), blocks("__own"))).withColumn("__other", blocks("__other")).drop("__at")

    ours, theirs = dealt(left, right), dealt(right, left)
    key = [F.col(f"`{k}`").cast(types[k]).alias(k) for k in on]
    rest = [c for c in left.columns if c not in on], [c for c in right.columns if c not in on]
    copies = F.explode(F.sequence(F.lit(0), F.col("__other") - 1))
    blocks = [
        df.where("__other is not null").select(*key, *[F.col(f"`{c}`") for c in own], F.col("__own").alias(mine), copies.alias(yours)).repartition(n, *on, "__a", "__b")
        for df, own, mine, yours in ((ours, rest[0], "__a", "__b"), (theirs, rest[1], "__b", "__a"))
    ]
    out = blocks[0].hint("shuffle_merge").join(blocks[1], [*on, "__a", "__b"]).drop("__a", "__b")
    for df, other, none, kinds in ((left, right, rest[1], ("left", "outer")), (right, left, rest[0], ("right", "outer"))):
        if how in kinds:
            alone = df.join(other.select(*[f"`{k}`" for k in on]).distinct(), on, "left_anti")
            alone = alone.withColumns({**{k: F.col(f"`{k}`").cast(types[k]) for k in on}, **{c: F.lit(None).cast(types[c]) for c in none}})
            out = out.unionAll(alone.select(*[f"`{c}`" for c in out.columns]))
    return out


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def order_by(df: DataFrame, keys: list[tuple[Column, bool]]) -> DataFrame:
    """Nulls last ascending, first descending."""
    return df.orderBy(*[c.asc_nulls_last() if up else c.desc_nulls_first() for c, up in keys])

"""Numbers of matches without the matches: branches of a node are counted apart and multiplied.

A branch has a row for each relationship from the node: ``__from, __rel, __n``, the node's id, the relationship's id, and the number of
matches beyond it.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import factorial, prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Branches of one node whose relationships must differ: the ways to split them into sets are listed (15 for four).
MOST = 4


def _splits(items: list[int]):
    """All ways to split a list into sets."""
    if not items:
        yield []
        return
    for rest in _splits(items[1:]):
        yield [[items[0]], *rest]
        for i, s in enumerate(rest):
            yield [*rest[:i], [items[0], *s], *rest[i + 1 :]]


def choices(parts: list[DataFrame]) -> DataFrame:
    """``__from, __n``: by node, in how many ways each branch can take a relationship so that all are different ones.

    With N(S) as the number of ways in which all branches of a set S take the same relationship, that is the sum over all
    splits of the branches of the products of (-1)^(|S|-1) (|S|-1)! N(S) (for two: N(1) N(2) - N(12)).
    """
    if len(parts) == 1:
        return parts[0].groupBy("__from").agg(F.sum("__n").alias("__n"))
    at = range(len(parts))
    rows = reduce(DataFrame.unionAll, [p.select("__from", "__rel", *[(F.col("__n") if i == j else F.lit(0).cast("bigint")).alias(f"__n{j}") for j in at]) for i, p in enumerate(parts)])
    each = rows.where("__rel is not null").groupBy("__from", "__rel").agg(*[F.sum(f"__n{j}").alias(f"__n{j}") for j in at])
    sets = [s for k in range(1, len(parts) + 1) for s in combinations(at, k)]
    name = lambda s: "__s" + "_".join(map(str, sorted(s)))
    sums = each.groupBy("__from").agg(*[F.sum(prod((F.col(f"__n{j}") for j in s[1:]), start=F.col(f"__n{s[0]}"))).alias(name(s)) for s in sets])
    total = reduce(lambda a, b: a + b, [reduce(lambda a, b: a * b, [F.col(name(s)) * F.lit((-1) ** (len(s) - 1) * factorial(len(s) - 1)) for s in split]) for split in _splits(list(at))])
    return sums.select("__from", total.alias("__n")).where("__n > 0")

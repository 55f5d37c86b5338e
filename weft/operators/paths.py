"""Variable-length and shortest paths as frontier joins.

``edges(r, __from, __to)`` is in the direction of travel. A result row is
``s, t, rels, via``: start, end, relationships, and the nodes after the start.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Levels that are unrolled into one lazy plan; deeper searches stop at an empty frontier.
LAZY_LEVELS = 6


#: Levels of a shortest-path search that are one lazy plan.
LAZY_SHORTEST = 2


class PathLimitError(RuntimeError):
    """An unbounded search reached the hop limit with paths still open."""


def _shared(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frontier with a reliable checkpoint."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all nodes share in spark.checkpoint.dir")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weft-paths-"))
    return df.checkpoint(eager=True)


def _begin(starts: DataFrame, edges: DataFrame) -> DataFrame:
    kind = edges.schema["r"].dataType.simpleString()
    return starts.select("s", F.col("s").alias("t"), F.array().cast(f"array<{kind}>").alias("rels"), F.array().cast("array<bigint>").alias("via"))


def _step(front: DataFrame, edges: DataFrame) -> DataFrame:
    """One more hop to nodes that the path hasn't visited."""
    out = front.join(edges, front["t"] == edges["__from"])
    out = out.where((F.col("__to") != F.col("s")) & ~F.array_contains("via", F.col("__to")))
    return out.select("s", F.col("__to").alias("t"), F.concat("rels", F.array("r")).alias("rels"), F.concat("via", F.array("__to")).alias("via"))


def var_length(starts: DataFrame, edges: DataFrame, lo: int, hi: int | None, limit: int, ends: DataFrame | None = None) -> DataFrame:
    """All paths of lo to hi hops from ``starts(s)`` without a repeated node, to ``ends(t)`` if these are given.

    Up to LAZY_LEVELS hops are one lazy plan. Beyond that frontiers are checkpointed and
    the search ends when one is empty; an unbounded search that is still open after
    ``limit`` hops raises PathLimitError rather than leave paths out.
    """
    if hi is not None and hi < lo:
        raise ValueError(f"path length {lo}..{hi} is empty")
    reached = lambda f: f if ends is None else f.join(ends, "t", "left_semi").select(*f.columns)
    front = _begin(starts, edges)
    found = reached(front) if lo == 0 else None
    last = hi if hi is not None else limit
    lazy = hi is not None and hi <= LAZY_LEVELS
    if not lazy:
        edges = _shared(edges)
    for hop in range(1, last + 1):
        # the last hop goes to wanted ends only
        final = ends is not None and hop == last and hi is not None
        front = _step(front, edges.join(ends.withColumnRenamed("t", "__to"), "__to", "left_semi") if final else edges)
        if not lazy:
            front = _shared(front)
            if front.isEmpty():
                break
        if hop >= lo:
            found = reached(front) if found is None else found.unionAll(reached(front))
    else:
        if hi is None and not _step(front, edges).isEmpty():
            raise PathLimitError(f"paths longer than {limit} hops; give an upper bound")
    return found if found is not None else _begin(starts, edges).where("false")


def shortest(pairs: DataFrame, edges: DataFrame, lo: int, hi: int | None, limit: int, every: bool) -> DataFrame:
    """Shortest paths between ``pairs(s, t)``: one each, or all of the least length with ``every``.

    For lo <= 1 a level holds (start, node, predecessor, relationship) of the nodes that are new to the start: one
    predecessor each, or all of them with ``every``. Whole paths are put together afterwards, backwards from the
    pairs that were met. A search visits each node once per start, and without an upper bound it goes on until all
    pairs are found or no node is new. For lo > 1 paths are followed as they are, and an unbounded search still open
    after ``limit`` hops raises PathLimitError. Pairs with s = t and lo = 0 have the empty path.
    """
    pairs = _shared(pairs)
    lazy = lo <= 1 and hi is not None and hi <= LAZY_SHORTEST
    keep = (lambda df: df) if lazy else _shared
    edges = keep(edges)
    if lo > 1:
        return _shortest_from(pairs, edges, lo, hi, limit, every)
    empty = _begin(pairs.select("s").distinct(), edges)
    found = empty.join(pairs, ["s", "t"]) if lo == 0 else empty.where("false")
    open_pairs = pairs.where("s <> t")
    front = open_pairs.select("s", F.col("s").alias("v")).distinct()
    seen, levels, met = front, [], []
    for hop in range(1, hi + 1) if hi is not None else count(1):
        step = front.join(edges, front["v"] == edges["__from"]).select("s", F.col("__to").alias("v"), F.col("__from").alias("u"), "r")
        step = step.join(seen, ["s", "v"], "left_anti")
        if not every:
            step = step.groupBy("s", "v").agg(F.min_by(F.struct("u", "r"), F.struct("u", F.col("r.id"))).alias("x")).select("s", "v", "x.u", "x.r")
        level = keep(step)
        if not lazy and level.isEmpty():
            break
        levels.append(level)
        front = level.select("s", "v").distinct()
        seen = keep(seen.unionAll(front))
        hit = keep(front.withColumnRenamed("v", "t").join(open_pairs, ["s", "t"]))
        if not lazy and hit.isEmpty():
            continue
        met.append((hop, hit))
        open_pairs = keep(open_pairs.join(hit, ["s", "t"], "left_anti"))
        if not lazy and open_pairs.isEmpty():
            break
        front = front.join(open_pairs.select("s").distinct(), "s", "left_semi")
    rels = dict(found.dtypes)["rels"]
    for hop, hit in met:
        back = hit.select("s", "t", F.col("t").alias("v"), F.array().cast(rels).alias("rels"), F.array().cast("array<bigint>").alias("via"))
        for level in reversed(levels[:hop]):
            back = back.join(level, ["s", "v"]).select("s", "t", F.col("u").alias("v"), F.concat(F.array("r"), "rels").alias("rels"), F.concat(F.array("v"), "via").alias("via"))
        found = found.unionByName(back.select("s", "t", "rels", "via"))
    return found.select("s", "t", "rels", "via")


def _shortest_from(pairs: DataFrame, edges: DataFrame, lo: int, hi: int | None, limit: int, every: bool) -> DataFrame:
    """Shortest paths of at least ``lo`` hops: every path without a repeated node is followed until its pair is met."""
    front = _begin(pairs.select("s").distinct(), edges)
    found, open_pairs = front.where("false"), pairs
    for hop in range(1, (hi if hi is not None else max(lo, limit)) + 1):
        front = _shared(_step(front, edges))
        if front.isEmpty():
            break
        if hop < lo:
            continue
        hit = front.join(open_pairs, ["s", "t"])
        if not every:
            first = Window.partitionBy("s", "t").orderBy(F.transform("rels", lambda r: r["id"]))
            hit = hit.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
        hit = _shared(hit)
        found = found.unionByName(hit)
        open_pairs = _shared(open_pairs.join(hit.select("s", "t").distinct(), ["s", "t"], "left_anti"))
        if open_pairs.isEmpty():
            break
        front = front.join(open_pairs.select("s").distinct(), "s", "left_semi")
    else:
        if hi is None and not _step(front, edges).isEmpty():
            raise PathLimitError(f"shortest paths longer than {limit} hops; give an upper bound")
    return found.select("s", "t", "rels", "via")

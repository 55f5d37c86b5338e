"""Exact top-k inner-product search by no-random-access aggregation over sorted lists.

Every component of the vectors is a sorted list. Lists are read from their better
end (by the sign of the query's weight), one portion after the other, all to the same
depth. What has been read of a vector gives bounds of its score: the components read,
plus at most what the unread ones can add. Unread components lie between the list's
far end and the place where reading stands; and by the Cauchy-Schwarz inequality they
add at most the length of the query's weights there times the length that is left of
the vector, whose whole length is known. The tighter of the two counts, above and below. Once
no more than a few vectors can reach the k-th best lower bound, reading stops and the
scores of these are resolved. A list read to its end needs no bounds.

Vectors are dealt to blocks of bounded size by their place in the table, queries to query
blocks by a hash of their id; each (vector block, query block) cell is one group, in which
the bounds of many queries are matrix products. The best k of the cells meet in a
window per query, which keeps at most k rows of each cell.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LONG = 2**63 - 1
#: Shares of the lists at which reading pauses to look at the bounds.
DEPTHS = (0.55, 0.65, 0.75, 0.85, 1.0)


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of x with q; beyond 64 bits they saturate."""
    out = [sum(a * b for a, b in zip(map(int, row), map(int, q))) for row in x]
    return np.asarray([max(-_LONG - 1, min(_LONG, s)) for s in out], np.int64)


def _resolve(score: np.ndarray, ids: np.ndarray, own: int, k: int):
    keep = ids != own
    score, ids = score[keep], ids[keep]
    if len(score) > 4 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        keep = score >= floor
        score, ids = score[keep], ids[keep]
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


def nra(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, depths=DEPTHS, at_once: int = 128):
    """For each query (ids, scores, entries read) of its k best vectors of a block, its own id excluded.

    x and q hold integers as float64. Products that don't fit 53 bits are summed with Python integers. The entries read
    are those of the sorted lists up to where reading stopped, and those of the vectors then resolved.
    """
    n, m = x.shape
    if not n or not len(q):
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64), 0)] * len(q)
    if m and np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * m >= 2**53:
        return [(*_resolve(_exact(x, v), ids, i, k), n * m) for v, i in zip(q, q_ids)]
    order = np.argsort(x, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    lo, hi, square = x.min(0) if m else np.zeros(0), x.max(0) if m else np.zeros(0), x * x
    length = square.sum(1)[:, None]
    found: list = [None] * len(q)
    open_ = np.arange(len(q))
    few = 4 * k + n // 32  # candidates whose scores cost less to resolve than a portion more costs to read
    for share in depths:
        depth = min(n, math.ceil(n * share))
        ended = depth == n
        read_hi, read_lo = rank >= n - depth, rank < depth
        x_hi, x_lo, s_hi, s_lo = np.where(read_hi, x, 0), np.where(read_lo, x, 0), np.where(read_hi, square, 0), np.where(read_lo, square, 0)
        top, bottom = np.take_along_axis(x, order[n - depth][None], 0)[0], np.take_along_axis(x, order[depth - 1][None], 0)[0]
        still = []
        for part in (open_[i : i + at_once] for i in range(0, len(open_), at_once)):
            pos, neg = np.maximum(q[part], 0).T, np.minimum(q[part], 0).T
            known = x_hi @ pos + x_lo @ neg
            able = np.ones(known.shape, bool)
            if not ended:
                un_hi, un_lo = ~read_hi, ~read_lo
                rest = np.sqrt(np.maximum(length - s_hi @ (pos > 0) - s_lo @ (neg < 0), 0) * (un_hi @ (pos * pos) + un_lo @ (neg * neg)))
                rest *= 1 + 1e-9  # roundings never exclude a vector
                upper = known + np.minimum(un_hi @ (top[:, None] * pos) + un_lo @ (bottom[:, None] * neg), rest)
                lower = known + np.maximum(un_hi @ (lo[:, None] * pos) + un_lo @ (hi[:, None] * neg), -rest)
                own = ids[:, None] == q_ids[part][None]
                lower[own] = upper[own] = -np.inf
                if n > k:
                    able = upper >= np.partition(lower, n - k, axis=0)[n - k]
            for c, at in enumerate(part):
                rows = np.flatnonzero(able[:, c])
                if ended:
                    found[at] = (*_resolve(known[:, c].astype(np.int64), ids, q_ids[at], k), n * m)
                elif len(rows) <= few:
                    resolved = (x[rows] @ q[at]).astype(np.int64)
                    found[at] = (*_resolve(resolved, ids[rows], q_ids[at], k), depth * m + len(rows) * m)
                else:
                    still.append(at)
        open_ = np.asarray(still, np.int64)
        if not len(open_):
            break
    return found


def _cell(k: int, scale: int):
    def run(table):
        import pyarrow as pa

        is_query = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("vec_id").to_numpy(zero_copy_only=False)
        dim = table.column("dim")[0].as_py()
        vec = table.column("vec").combine_chunks()
        flat = np.asarray(vec.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), dim)
        flat = np.floor(flat * scale)
        out: list[list] = [[], [], [], [], []]
        q_ids, whole = ids[is_query], int((~is_query).sum()) * dim
        for q, (found, score, read) in zip(q_ids, nra(flat[~is_query], ids[~is_query], flat[is_query], q_ids, k)):
            # the first row of a query and cell carries what was read; a cell without a result has a row for that alone
            n = max(1, len(found))
            out[0].append(np.full(n, q))
            out[1].append(found if len(found) else np.full(1, -1))
            out[2].append(score if len(found) else np.full(1, -_LONG - 1))
            out[3].append(np.concatenate(([read], np.zeros(n - 1, np.int64))))
            out[4].append(np.concatenate(([whole if len(found) else -1 - whole], np.zeros(n - 1, np.int64))))
        cat = [np.concatenate(o).astype(np.int64) if o else np.zeros(0, np.int64) for o in out]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score", "read", "entries"), cat)})

    return run


def _best_of_cells(vectors: DataFrame, is_query: Column | None, k: int, scale: int, id_col: str, vec_col: str, block: int, query_block: int) -> DataFrame:
    if is_query is None:
        is_query = F.col(id_col) % 100 == 0
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(v.isNotNull() & finite & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), v.alias("vec"), F.size(v).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("is_query")
    )
    n = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    blocks = max(1, math.ceil(n["n"] / block))
    q_blocks = max(1, math.ceil(n["q"] / query_block))
    # by place and not by id, so that no repeated id or vector fills a block
    g = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    h = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(q_blocks)).cast("int")
    queries = rows.where("is_query").dropDuplicates(["vec_id"])
    cells = rows.withColumn("is_query", F.lit(False)).withColumn("g", g).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).unionByName(
        queries.withColumn("h", h).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("vec_id", "vec", "dim", "is_query", "g", "h")
    )
    return cells.groupBy("g", "h", "dim").applyInArrow(_cell(k, scale), "query_id long, vec_id long, score long, read long, entries long")


def top_k_inner_product(
    vectors: DataFrame,
    is_query: Column | None = None,
    k: int = 10,
    scale: int = 1024,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    block: int = 8_192,
    query_block: int = 8_192,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest inner products over floor(scale * x).

    Queries are the rows where ``is_query`` holds (default: id divisible by 100);
    candidates are all rows but those with the query's own id; ties go to the smaller
    id, and a query with fewer candidates gets all of them. Vectors that are null or
    hold a null or non-finite component take no part, nor do rows without an id.
    Vectors of different lengths don't meet. A repeated row is a candidate once for
    each time it occurs, and a query once. Scores beyond 64 bits saturate. Other
    columns are not read; an empty table gives an empty result. Every block is read by the same
    rule, whatever its size.
    """
    best = _best_of_cells(vectors, is_query, k, scale, id_col, vec_col, block, query_block).where("entries >= 0").drop("read", "entries")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def reading(
    vectors: DataFrame, is_query: Column | None = None, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 8_192, query_block: int = 8_192
) -> DataFrame:
    """``(query_id, entries, read)``: list entries that the query could read, and those it did before reading stopped, candidates resolved included."""
    cells = _best_of_cells(vectors, is_query, k, scale, id_col, vec_col, block, query_block)
    entries = F.when(F.col("entries") < 0, -1 - F.col("entries")).otherwise(F.col("entries"))
    return cells.groupBy("query_id").agg(F.sum(entries).alias("entries"), F.sum("read").alias("read"))

"""Exact n-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows.

Jaccard distance d = 1 - |x & y| / |x | y| is a metric. The join works on
distinct shingle sets, each known by a 63-bit hash of the whole set (``sid``);
documents with equal sets are one class, so copies are never paired.

1. *Outer regions.* Nearly all documents of a corpus are at distance 1 from any
   document pivot, and a window of the triangle inequality around distance 1
   holds everything. The outermost pivots are therefore single shingles: a set
   that contains shingle s is nearer to pivot {s} than any set that doesn't.
   Shingles are ordered by frequency (a count sketch of fixed size over all
   documents, then hash). A partner of x misses at most ``n - ceil(t n)`` of x's
   n shingles, so x is replicated into the regions of its first
   ``n - ceil(t n) + 1`` pivots: two linked sets share one of these. Within a
   region, pairs that sizes or positions rule out go; what remains, as
   connected components, are the candidate regions, a superset of the links.
2. *Inner regions.* The sets of a candidate region meet in one task. Pivots are
   documents; each set is at home with the nearest pivot (Voronoi), and a guest of every
   pivot p before that with d(x, p) <= d(x, nearest) + 2 (1 - t), the window that the
   triangle inequality leaves open. Regions are joined recursively; in a region that doesn't
   shrink the intersections of all sets are counted. Two guests of one region meet
   elsewhere, so every pair of sets is decided exactly once and links can be counted.
3. A candidate region above ``region_shingles`` is cut into hashed blocks and
   every pair of its blocks is joined as in 2: no unbounded group meets in one task.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stash, join_checked, small
from .components import connected_components
from .shingles import mix, sets_of

_U = np.uint64


def needed(n, t_num: int, t_den: int):
    """ceil(t * n) in integers."""
    return (n * t_num + t_den - 1) // t_den


def set_id(s: np.ndarray) -> int:
    """63-bit identity of a set of shingle hashes; an empty set has none."""
    return int(mix(np.asarray([mix(s).sum() + _U(len(s))], np.uint64))[0] >> _U(1))


# -- inner join: one region, in memory ---------------------------------------------------------


class _Region:
    """Sets of one region; ``parent`` is a union-find over them, ``links`` counts each set's partners.

    Two sets with a common bit in ``mask`` have met before or will meet elsewhere, and are not compared here.
    """

    def __init__(self, sets: list[np.ndarray], t_num: int, t_den: int, mask=None):
        self.n = np.asarray([len(s) for s in sets], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.n)))
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.items, self.flat = np.unique(flat, return_inverse=True)
        self.flat = self.flat.astype(np.int64)
        self.num, self.den = t_num, t_den
        self.parent = np.arange(len(sets))
        self.links = np.zeros(len(sets), np.int64)
        self.mark = np.zeros(len(self.items) + 1, np.int32)
        self.mask = np.zeros(len(sets), np.int64) if mask is None else np.asarray(mask, np.int64)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def members(self, at: np.ndarray):
        """(item, position in ``at``) of all sets of ``at``, one after the other."""
        n = self.n[at]
        pick = np.repeat(self.start[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return self.flat[pick], np.repeat(np.arange(len(at)), n)

    def shared(self, pivot: int, to: np.ndarray) -> np.ndarray:
        """Intersection sizes of one set with many."""
        own = self.flat[self.start[pivot] : self.start[pivot + 1]]
        self.mark[own] = 1
        n = self.n[to]
        items, _ = self.members(to)
        out = np.add.reduceat(self.mark[items], np.concatenate(([0], np.cumsum(n)[:-1])))
        self.mark[own] = 0
        return out

    def count_links(self, at: np.ndarray, mask: np.ndarray, rows: int = 256) -> None:
        """Decide every pair of ``at`` without a common mask bit.

        Intersections are counted item by item: items of many sets by products of 0/1 matrices, the others by their lists of sets.
        """
        items, owner = self.members(at)
        order = np.argsort(items, kind="stable")
        items, owner = items[order], owner[order]
        cut = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1], [True])))
        size = np.diff(cut)
        common = size > max(8, len(at) // 4)
        column = np.cumsum(common) - 1
        wide = np.zeros((len(at), int(common.sum())), np.float32)
        which = np.repeat(np.arange(len(size)), size)
        wide[owner[common[which]], column[which[common[which]]]] = 1
        # lists of the other items, and for each set the lists that it stands in
        light = (size > 1) & ~common
        held = light[which]
        by_set = np.argsort(owner[held], kind="stable")
        lists_of = which[held][by_set]
        begin = np.searchsorted(owner[held][by_set], np.arange(len(at) + 1))
        n = self.n[at]
        for lo in range(0, len(at), rows):
            hi = min(lo + rows, len(at))
            inter = (wide[lo:hi] @ wide[lo:].T).astype(np.int64)
            for p in range(lo, hi):
                lists = lists_of[begin[p] : begin[p + 1]]
                if len(lists):
                    lengths = size[lists]
                    pick = np.repeat(cut[lists] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
                    others = owner[pick]
                    inter[p - lo] += np.bincount(others[others >= lo] - lo, minlength=len(at) - lo)
            linked = inter * self.den >= (n[lo:hi, None] + n[None, lo:] - inter) * self.num
            linked &= (mask[lo:hi, None] & mask[None, lo:]) == 0
            linked &= np.arange(lo, len(at))[None] > np.arange(lo, hi)[:, None]
            a, b = np.nonzero(linked)
            a, b = at[a + lo], at[b + lo]
            np.add.at(self.links, a, 1)
            np.add.at(self.links, b, 1)
            for i, j in zip(a.tolist(), b.tolist()):
                if self.parent[i] != self.parent[j] or self.parent[i] != min(i, j):
                    self.link(i, j)

    def join(self, at: np.ndarray, mask: np.ndarray | None = None, depth: int = 0, leaf: int = 48, pivots: int = 8) -> None:
        """Decide all pairs of ``at``, recursively."""
        mask = self.mask[at] if mask is None else mask
        if len(at) <= leaf or depth >= 40:
            return self.count_links(at, mask)
        tau = 1 - self.num / self.den + 1e-9
        # pivots: farthest-first from a fixed start, so that regions are apart
        d = np.full(len(at), np.inf)
        dist: list[np.ndarray] = []
        while len(dist) < pivots:
            p = at[0] if not dist else at[int(np.argmax(d))]
            if dist and d.max() <= 0:
                break
            inter = self.shared(p, at)
            dist.append(1 - inter / (self.n[p] + self.n[at] - inter))
            d = np.minimum(d, dist[-1])
        dist = np.stack(dist)
        home = dist.argmin(0)
        # sets at distance 1 from every pivot share no shingle with one; they are at home in a region of their own, whose
        # guests are the sets near enough to the border (d >= 1 - tau) to be linked with one of them
        far = d >= 1
        home[far] = len(dist)
        regions = []
        for k in range(len(dist)):
            guest = (home > k) & ~far & (dist[k] <= d + 2 * tau)
            regions.append((home == k, guest))
        regions.append((far, ~far & (d >= 1 - tau)))
        if any((own | guest).sum() > 0.9 * len(at) for own, guest in regions):
            return self.count_links(at, mask)
        for own, guest in regions:
            inside = own | guest
            if own.any() and inside.sum() > 1:
                self.join(at[inside], mask[inside] | (guest[inside].astype(np.int64) << depth), depth + 1, leaf, pivots)


def join_sets(sets: list[np.ndarray], t_num: int, t_den: int, mask=None) -> tuple[np.ndarray, np.ndarray]:
    """Component label (an index) and number of links of every set; all sets non-empty and different."""
    region = _Region(sets, t_num, t_den, mask)
    region.join(np.argsort(region.n, kind="stable"))
    return np.asarray([region.root(i) for i in range(len(sets))]), region.links


# -- stages on executors -----------------------------------------------------------------------


def _scan(k: int, bits: int):
    """Per row (doc_id, n, sid), and a task's share of the count sketch as compressed rows."""

    def run(batches):
        import pyarrow as pa

        sketch = np.zeros(1 << bits, np.uint32)
        for b in batches:
            n, sid = [], []
            for _, s in sets_of(b.column(1), k):
                n.append(len(s))
                sid.append(set_id(s) if len(s) else None)
                _count(sketch, s, bits)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())],
                names=["doc_id", "key", "n", "sid", "part", "counts"],
            )
        if sketch.any():
            size = min(1 << bits, 1 << 14)
            parts = [(i, zlib.compress(sketch[i * size : (i + 1) * size].tobytes(), 1)) for i in range((1 << bits) // size)]
            m = len(parts)
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(m, pa.int64())] * 4, pa.array([p for p, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())],
                names=["doc_id", "key", "n", "sid", "part", "counts"],
            )

    return run


def _count(sketch: np.ndarray, s: np.ndarray, bits: int) -> None:
    cell, times = np.unique((s >> _U(64 - bits)).astype(np.int64), return_counts=True)
    sketch[cell] += times.astype(np.uint32)


def _sum_parts(table):
    import pyarrow as pa

    total = None
    for c in table.column("counts"):
        x = np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
        total = x.astype(np.uint64) if total is None else total + x
    packed = zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "counts": pa.array([packed], pa.binary())})


def _postings(sketch, k: int, bits: int, t_num: int, t_den: int, salt_over: int):
    """(token, salt, split, sid, n, rank) of the first pivots of every set; a task emits a set once while it remembers it.

    A token that the sketch counts above ``salt_over`` times is split over salts.
    """

    def run(batches):
        import pyarrow as pa

        counts, seen = sketch.value, set()
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for _, s in sets_of(b.column(0), k):
                if not len(s):
                    continue
                sid = set_id(s)
                if sid in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(sid)
                n = len(s)
                take = n - needed(n, t_num, t_den) + 1
                freq = counts[(s >> _U(64 - bits)).astype(np.int64)]
                order = np.lexsort((s, freq))[:take]
                freq = freq[order].astype(np.int64)
                cols[0].append(s[order].view(np.int64))
                cols[1].append(np.where(freq > salt_over, (sid >> 7) % (freq // salt_over + 1), 0))
                cols[2].append(freq > salt_over)
                cols[3].append(np.full(take, sid))
                cols[4].append(np.full(take, n))
                cols[5].append(np.arange(take))
            if cols[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32()))],
                    names=["token", "salt", "split", "sid", "n", "rank"],
                )

    return run


def _candidates(t_num: int, t_den: int, pairs_up_to: int, hold: int = 50_000):
    """Candidate edges (a, b) of sorted postings; with b null, the leader of one salt of a split token.

    A run (one token and salt) of up to ``pairs_up_to`` sets gives the pairs that sizes
    and positions allow. A longer one, or one of a split token, ties all its sets to its
    first; beyond ``hold`` rows only that first set is remembered.
    """

    def edges_of(sid, n, rank, split):
        if split or len(sid) > pairs_up_to:
            return np.full(len(sid) - 1, sid[0]), sid[1:]
        i, j = np.triu_indices(len(sid), 1)
        lo, hi = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        need = -(-(n[i] + n[j]) * t_num // (t_num + t_den))
        ok = (lo * t_den >= hi * t_num) & (np.minimum(n[i] - rank[i], n[j] - rank[j]) >= need)
        return sid[i[ok]], sid[j[ok]]

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64())])
        held, leader = None, None

        def flush(cols, last: bool):
            """Edges of the complete runs; the last run is held back unless ``last``."""
            nonlocal held, leader
            token, salt, split, sid, n, rank = cols
            cut = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]), [True])))
            a_out, b_out, held = [], [], None
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
                key = (token[x], salt[x])
                if leader is not None and leader[0] == key:
                    a_out.append(np.full(y - x, leader[1]))
                    b_out.append(sid[x:y])
                elif y == len(token) and not last:
                    if y - x > hold:
                        leader = (key, sid[x])
                        a_out.append(np.full(y - x, sid[x]))
                        b_out.append(sid[x:y])
                    else:
                        held = [c[x:y] for c in cols]
                elif y - x > 1:
                    u, first = np.unique(sid[x:y], return_index=True)
                    if len(u) > 1:
                        a, b = edges_of(u, n[x:y][first].astype(np.int64), rank[x:y][first].astype(np.int64), split[x])
                        a_out.append(a)
                        b_out.append(b)
            a, b = (np.concatenate(a_out), np.concatenate(b_out)) if a_out else (np.zeros(0, np.int64),) * 2
            edges = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            edges = edges[:, edges[0] != edges[1]]
            first = cut[:-1][split[cut[:-1]]]
            if edges.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1]), pa.nulls(edges.shape[1], pa.int64())], schema=schema)
            if len(first):
                yield pa.RecordBatch.from_arrays([pa.array(sid[first]), pa.nulls(len(first), pa.int64()), pa.array(token[first])], schema=schema)

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate((h, c)) for h, c in zip(held, cols)]
            yield from flush(cols, False)
        if held is not None:
            yield from flush(held, True)

    return run


def _join_regions(k: int, t_num: int, t_den: int):
    """Rows (region, sid, mark, text) sorted by region -> (sid, root, links), root being the smallest sid of its component there.

    Sets with a common bit in ``mark`` are in one block, and are compared where the block is joined with itself.
    """

    def run(batches):
        import pyarrow as pa

        region, sids, sets, marks = None, [], [], []

        def done():
            order = sorted(set(zip(sids, range(len(sids)))))
            kept = [i for p, (s, i) in enumerate(order) if p == 0 or order[p - 1][0] != s]
            own, member = [sids[i] for i in kept], [sets[i] for i in kept]
            root, links = join_sets(member, t_num, t_den, [marks[i] for i in kept])
            label = [own[r] for r in root]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(label, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"])

        for b in batches:
            regions, ids, bits = (b.column(i).to_pylist() for i in range(3))
            for i, s in sets_of(b.column(3), k):
                if not len(s) or set_id(s) != ids[i]:  # another text under a repeated id
                    continue
                if regions[i] != region:
                    if len(sids) > 1:
                        yield done()
                    region, sids, sets, marks = regions[i], [], [], []
                sids.append(ids[i])
                sets.append(s)
                marks.append(bits[i])
        if len(sids) > 1:
            yield done()

    return run


# -- the operator ------------------------------------------------------------------------------


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 4,
    threshold: tuple[int, int] = (85, 100),
    sketch_bits: int | None = None,
    salt_over: int = 20_000,
    pairs_up_to: int = 64,
    region_shingles: int = 4_000_000,
) -> DataFrame:
    """``(id, n_shingles, component_id, n_links)`` for every row of docs.

    Two documents link when their sets of distinct k-word shingles have Jaccard
    similarity at least ``threshold`` (a fraction of integers, compared exactly);
    component_id is the smallest id reachable by links, and n_links the number of other
    sets (different texts, not their copies) that the row's set links with. Texts that are null or hold
    no word have an empty set, link with nothing and keep their own id; repeated
    rows come back as often as they came. Rows without an id take part, as links run through
    them too; their component_id is null only if it holds no id at all. Other columns are not read. An empty
    table gives an empty result. ``sketch_bits`` (default: by the amount of text,
    16 to 22) sets the fixed size of the count sketch, ``pairs_up_to`` the region
    size up to which pairs are filtered one by one (larger regions become one
    candidate region unfiltered), ``region_shingles`` the most shingles that meet
    in one task.
    """
    spark = docs.sparkSession
    t_num, t_den = threshold
    stash = Stash(spark, "jaccard")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # what a text is looked up by: its id, and without one a negative hash of it (texts found by one key are told apart by their sets)
    key = F.coalesce("doc_id", -1 - F.shiftrightunsigned(F.xxhash64("text"), 2))
    base = base.withColumn("key", key)
    if sketch_bits is None:
        total = base.select(F.sum(F.octet_length("text"))).first()[0] or 0
        sketch_bits = min(22, max(16, int(math.log2(total / 192 + 1)) + 1))
    bits = sketch_bits

    seen = stash.put("scan", base.select("doc_id", "text", "key").mapInArrow(_scan(k, bits), "doc_id long, key long, n long, sid long, part int, counts binary"))
    parts = seen.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(_sum_parts, "part int, counts binary").collect()
    counts = np.zeros(1 << bits, np.uint32)
    for p in parts:
        x = np.frombuffer(zlib.decompress(p["counts"]), np.uint32)
        counts[p["part"] * len(x) : (p["part"] + 1) * len(x)] = x
    sketch = spark.sparkContext.broadcast(counts)  # 4 bytes << sketch_bits, whatever the input
    rows = seen.where("part is null").select("doc_id", "key", "n", "sid")
    classes = rows.where("sid is not null").groupBy("sid").agg(
        F.min("doc_id").alias("first_id"), F.coalesce(F.min("doc_id"), F.min("key")).alias("key"), F.max("n").alias("n")
    )

    post = base.select("text").mapInArrow(
        _postings(sketch, k, bits, t_num, t_den, salt_over), "token long, salt int, split boolean, sid long, n int, rank int"
    )
    post = post.repartition("token", "salt").sortWithinPartitions("token", "salt", "sid")
    found = stash.put("edges", post.mapInArrow(_candidates(t_num, t_den, pairs_up_to), "a long, b long, token long"))
    leaders = found.where("b is null").select("token", "a").distinct()
    spread = leaders.join(leaders.groupBy("token").agg(F.min("a").alias("b")), "token").select("a", "b")
    edges = found.where("b is not null").select("a", "b").unionAll(spread)
    cand = connected_components(edges).withColumnsRenamed({"node": "sid", "component": "region"})
    cand = stash.put("candidates", cand.join(classes, "sid"))
    heavy = cand.groupBy("region").agg(F.sum("n").alias("w")).where(F.col("w") > region_shingles)
    heavy = stash.put("heavy", heavy.withColumn("blocks", F.ceil(F.col("w") * 2 / region_shingles).cast("int")))
    any_heavy = not heavy.isEmpty()
    placed = cand.select("sid", "key", F.col("region").cast("string").alias("region"), F.lit(0).cast("long").alias("mark"))
    if any_heavy:
        cut = cand.join(F.broadcast(heavy.select("region", "blocks")) if small(heavy) else heavy.select("region", "blocks"), "region", "left")
        block = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
        bit = lambda n: F.lit(1 << n).cast("long")
        cell = lambda o: F.struct(
            F.concat_ws("/", F.col("region").cast("string"), F.least(block, o).cast("string"), F.greatest(block, o).cast("string")).alias("region"),
            F.when(block == o, F.lit(0).cast("long")).when(block < o, bit(61)).otherwise(bit(60)).alias("mark"),
        )
        whole = F.array(F.struct(F.col("region").cast("string").alias("region"), F.lit(0).cast("long").alias("mark")))
        cells = F.when(F.col("blocks").isNull(), whole).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), cell))
        placed = cut.select("sid", "key", F.explode(cells).alias("c")).select("sid", "key", "c.region", "c.mark")
    texts = join_checked(base.select("key", "text"), placed, "key").select("region", "sid", "mark", "text")
    texts = texts.repartition("region").sortWithinPartitions("region", "sid")
    linked = stash.put("linked", texts.mapInArrow(_join_regions(k, t_num, t_den), "a long, b long, links long"))
    label = linked.select("a", "b")
    if any_heavy:
        label = connected_components(label).withColumnsRenamed({"node": "a", "component": "b"})
    label = label.join(classes.select(F.col("sid").alias("a"), "first_id"), "a")
    lowest = label.groupBy("b").agg(F.min("first_id").alias("component_id"))
    links = linked.groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("n_links"))
    by_sid = label.join(lowest, "b").select(F.col("a").alias("sid"), "component_id")
    by_sid = classes.join(by_sid, "sid", "left").join(links, "sid", "left").select("sid", F.coalesce("component_id", "first_id").alias("component_id"), "n_links")
    return rows.join(by_sid, "sid", "left").select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )

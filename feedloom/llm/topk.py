"""Exact search of the highest inner products by two cover trees, one over queries and one over data.

A node of a tree covers its points by a ball around one of them. Its children are centres chosen farthest-first until
half its radius covers all points (or ``FAN`` are chosen): they lie at least their covering radius apart, and the node's own
centre is the first of them. A pair of nodes is dropped if no point of the one can reach, with any query of the other, the
worst of the k-th best scores that the queries have so far.

Queries meet all rows in blocks: a block of bounded size is indexed and broadcast, each task indexes its rows in
bounded chunks and descends both trees, comparing the leaves with the best bounds first, keeping k rows a query over all its chunks. A first walk over the block's own
queries, which are rows of the data too, gives every task a k-th score to start from. The tasks' rows meet by query.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.operators.stages import written

SCALE = 1024
QUERY_BLOCK = 16_384  # queries that are broadcast at once (8 MB at 64 components)
CHUNK = 8_192  # rows that a task indexes at once
LEAF = 32
FAN = 16
GROUP = 1_024  # queries that descend together: bounds the number of open pairs
POINTS = 512  # points of leaves that are compared at once
NONE = np.iinfo(np.int64).min  # no score yet


class Tree(NamedTuple):
    points: np.ndarray  # in the order of the leaves
    order: np.ndarray  # their places in the input
    center: np.ndarray  # per node
    norm: np.ndarray  # of the centre
    far: np.ndarray  # largest norm of a point
    radius: np.ndarray
    lo: np.ndarray  # points lo:hi belong to the node
    hi: np.ndarray
    first: np.ndarray  # children first:last; none for a leaf
    last: np.ndarray
    parent: np.ndarray


def _centers(points: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres chosen farthest-first (the first is the one ``away`` is measured from), each point's centre and distance."""
    picked, owner = [int(np.argmin(away))], np.zeros(len(points), np.int64)
    away, aim = away.copy(), away.max() / 2
    while len(picked) < FAN and not away.max() <= aim:
        c = int(np.argmax(away))
        d = np.sqrt(((points - points[c]) ** 2).sum(axis=1))
        closer = d < away
        if not closer[c]:  # distances beyond all numbers
            break
        owner[closer], away[closer] = len(picked), d[closer]
        picked.append(c)
    return np.array(picked), owner, away


def cover_tree(points: np.ndarray) -> Tree:
    n = len(points)
    order = np.arange(n)
    norms = np.sqrt((points**2).sum(axis=1))
    root = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1))) if n else 0
    away = np.sqrt(((points - points[root]) ** 2).sum(axis=1)) if n else np.zeros(0)
    lo, hi, center, radius, first, last, parent = [0], [n], [root], [away.max() if n else 0.0], [0], [0], [-1]
    i = 0
    while i < len(lo):  # by levels; a node's points are one stretch of ``order``
        a, b = lo[i], hi[i]
        if b - a > LEAF and radius[i] > 0:
            own = order[a:b].copy()
            picked, owner, near = _centers(points[own], away[own])
            if len(picked) > 1:
                by = np.argsort(owner, kind="stable")
                cuts = a + np.searchsorted(owner[by], np.arange(len(picked) + 1))
                order[a:b], away[own] = own[by], near
                first[i], last[i] = len(lo), len(lo) + len(picked)
                for c, x, y in zip(own[picked], cuts, cuts[1:]):
                    for values, value in ((lo, int(x)), (hi, int(y)), (center, int(c)), (radius, away[order[x:y]].max()), (first, 0), (last, 0), (parent, i)):
                        values.append(value)
        i += 1
    lo, hi = np.array(lo), np.array(hi)
    far = np.array([norms[order[a:b]].max() if b > a else 0.0 for a, b in zip(lo, hi)])
    centers = points[center] if n else np.zeros((1, points.shape[1]))
    norm = norms[center] if n else np.zeros(1)
    return Tree(points[order], order, centers, norm, far, np.array(radius), lo, hi, np.array(first), np.array(last), np.array(parent))


def _bounds(q: Tree, i: np.ndarray, x: Tree, j: np.ndarray) -> np.ndarray:
    """For pairs of nodes (i, j) upper bounds of the inner products of their points."""
    product = np.einsum("nd,nd->n", q.center[i], x.center[j])
    by_product = product + q.radius[i] * x.norm[j] + x.radius[j] * q.norm[i] + q.radius[i] * x.radius[j]
    apart = np.sqrt(np.maximum(q.norm[i] ** 2 + x.norm[j] ** 2 - 2 * product, 0)) * (1 - 1e-9)
    gap = np.maximum(apart - q.radius[i] - x.radius[j], 0)
    by_distance = (q.far[i] ** 2 + x.far[j] ** 2 - gap**2) / 2
    return np.fmin(by_product, by_distance) + 1e-9 * (q.far[i] * x.far[j] + q.far[i] ** 2 + x.far[j] ** 2) + 1e-6


def _children(tree: Tree, nodes: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All children of the nodes, each with what stood beside its parent."""
    count = tree.last[nodes] - tree.first[nodes]
    return _ranges(tree.first[nodes], count), np.repeat(beside, count)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; those beyond a long are its ends."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    exact = [[min(max(sum(int(a) * int(b) for a, b in zip(u, v)), NONE + 1), -NONE - 1) for v in x.tolist()] for u in q.tolist()]
    return np.array(exact, dtype=np.int64)


class Search:
    """The best rows so far of a block of queries (``ids``, ``points``), each with a score that its k-th best has at least."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, floors: np.ndarray, k: int):
        self.tree, self.k = cover_tree(points), k
        self.ids, self.floors = ids[self.tree.order], floors[self.tree.order]
        self.scores = np.full((len(ids), k), NONE)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.worst = np.array([self.floors[a:b].min() if b > a else NONE for a, b in zip(self.tree.lo, self.tree.hi)])

    def _compare(self, i: int, points: np.ndarray, ids: np.ndarray) -> None:
        """Compare the queries of leaf i with all points."""
        a, b = self.tree.lo[i], self.tree.hi[i]
        s = _products(self.tree.points[a:b], points)
        least = np.maximum(self.floors[a:b], self.scores[a:b, -1])
        use = (s >= least[:, None]) & (self.ids[a:b, None] != ids)
        rows = np.flatnonzero(use.any(axis=1))
        if not len(rows):
            return
        columns = np.flatnonzero(use.any(axis=0))
        last = np.iinfo(np.int64).max
        use, s = use[np.ix_(rows, columns)], s[np.ix_(rows, columns)]
        scores = np.concatenate((self.scores[a + rows], np.where(use, s, NONE)), axis=1)
        names = np.concatenate((self.found[a + rows], np.where(use, ids[columns], last)), axis=1)
        best = np.lexsort((names, ~scores), axis=1)[:, : self.k]  # ~s orders from the highest score, without overflow
        self.scores[a + rows], self.found[a + rows] = np.take_along_axis(scores, best, 1), np.take_along_axis(names, best, 1)
        self.worst[i] = np.maximum(self.floors[a:b], self.scores[a:b, -1]).min()
        up = self.tree.parent[i]
        while up >= 0:
            now = self.worst[self.tree.first[up] : self.tree.last[up]].min()
            if now <= self.worst[up]:
                break
            self.worst[up], up = now, self.tree.parent[up]

    def _groups(self) -> list[int]:
        """Nodes that hold all queries, ``GROUP`` each or fewer unless they cannot be split."""
        out, stack = [], [0]
        while stack:
            i = stack.pop()
            if self.tree.hi[i] - self.tree.lo[i] <= GROUP or not self.tree.last[i]:
                out.append(i)
            else:
                stack += range(self.tree.first[i], self.tree.last[i])
        return out

    def meet(self, ids: np.ndarray, points: np.ndarray) -> int:
        """Take in rows. The result is the number of products that were formed."""
        if not len(points) or not len(self.ids):
            return 0
        x = cover_tree(points)
        ids = ids[x.order]
        return sum(self._descend(group, x, ids) for group in self._groups())

    def _descend(self, group: int, x: Tree, ids: np.ndarray) -> int:
        q, i, j = self.tree, np.array([group]), np.array([0])
        leaves = []
        while len(i):  # all open pairs of a level at once
            bound = _bounds(q, i, x, j)
            keep = ~(bound < self.worst[i])
            i, j, bound = i[keep], j[keep], bound[keep]
            inner_q, inner_x = q.last[i] > 0, x.last[j] > 0
            leaf = ~inner_q & ~inner_x
            leaves.append((i[leaf], j[leaf], bound[leaf]))
            by_x = inner_x & (~inner_q | (x.radius[j] >= q.radius[i]))
            by_q = ~leaf & ~by_x
            (new_j, with_i), (new_i, with_j) = _children(x, j[by_x], i[by_x]), _children(q, i[by_q], j[by_q])
            i, j = np.concatenate((with_i, new_i)), np.concatenate((new_j, with_j))
        i, j, bound = (np.concatenate(part) for part in zip(*leaves))
        best_first = np.lexsort((-bound, i))
        i, j, bound = i[best_first], j[best_first], bound[best_first]
        starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, np.int64)
        formed = 0
        for a, b in zip(starts, np.append(starts[1:], len(i))):
            node, many = int(i[a]), np.cumsum(x.hi[j[a:b]] - x.lo[j[a:b]])
            done = 0
            while done < b - a and not bound[a + done] < self.worst[node]:
                # a stretch of leaves with POINTS points or so; later ones meet a higher threshold
                end = max(done + 1, int(np.searchsorted(many, (many[done - 1] if done else 0) + POINTS, side="right")))
                use = j[a + done : a + end][~(bound[a + done : a + end] < self.worst[node])]
                at = _ranges(x.lo[use], x.hi[use] - x.lo[use])
                self._compare(node, x.points[at], ids[at])
                formed += len(at) * int(q.hi[node] - q.lo[node])
                done = end
        return formed

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query in the block, id found, score), unordered."""
        at, nth = np.nonzero((self.scores != NONE) & (self.scores >= self.floors[:, None]))
        return self.tree.order[at], self.found[at, nth], self.scores[at, nth]


def scaled(ids: pa.Array, vectors: pa.Array, scale: int = SCALE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of components: ids and floor(scale * x) of the usable rows."""
    if isinstance(vectors, pa.ChunkedArray):
        ids, vectors = ids.combine_chunks(), vectors.combine_chunks()
    if not len(vectors):
        return {}
    keep = np.array(ids.is_valid()) & np.array(vectors.is_valid())
    ids, vectors = ids.filter(pa.array(keep)), vectors.filter(pa.array(keep))
    names = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.array(vectors.value_lengths(), dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    with np.errstate(all="ignore"):
        flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)  # a null becomes NaN
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    good = bad[bounds[1:]] == bad[bounds[:-1]]
    return {int(d): (names[at], flat[bounds[at][:, None] + np.arange(d)]) for d in np.unique(sizes[good]) for at in [np.flatnonzero(good & (sizes == d))]}


def _local(rows: DataFrame, shared, k: int) -> DataFrame:
    """The best k rows of each task for the queries of a block, (_q, vec_id, score)."""

    def run(batches):
        with np.errstate(all="ignore"):
            searches = {d: (Search(ids, points, floors, k), numbers) for d, (ids, points, floors, numbers) in shared.value.items()}
            held: dict[int, list] = {}
            for batch in batches:
                for d, (ids, points) in scaled(batch.column(0), batch.column(1)).items():
                    if d not in searches:
                        continue
                    parts = held.setdefault(d, [])
                    parts.append((ids, points))
                    if sum(len(i) for i, _ in parts) >= CHUNK:
                        ids, points = (np.concatenate(x) for x in zip(*parts))
                        parts.clear()
                        for a in range(0, len(ids), CHUNK):
                            searches[d][0].meet(ids[a : a + CHUNK], points[a : a + CHUNK])
            for d, parts in held.items():
                if parts:
                    searches[d][0].meet(*(np.concatenate(x) for x in zip(*parts)))
        for search, numbers in searches.values():
            at, found, score = search.rows()
            yield pa.record_batch([pa.array(numbers[at]), pa.array(found), pa.array(score)], ["_q", "vec_id", "score"])

    return rows.mapInArrow(run, "_q long, vec_id long, score long")


def top_products(rows: DataFrame, queries: DataFrame, k: int = 10, vec: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` rows with the highest products, ties to the smaller id.

    Products are of integers, floor(1024 * x) per component, and exact; one beyond the range of a long is the end of that range.
    Rows and queries without an id, with a null vector, or with a null or non-finite component (or one that is not finite
    when multiplied) take no part. A vector meets only those of as many components. No row with the query's own
    id is a candidate of it. Repeated rows are candidates each; a query that repeats id and vector is one, and an id with
    several vectors is answered for each. Fewer candidates than ``k``: all. Empty tables give an empty result.
    Further columns are not read.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(vec).cast("long").alias("_id"), F.col(vector).alias("_vector"))
    asked = written(queries.select(F.col(vec).cast("long").alias("_id"), F.col(vector).alias("_vector")).where("_id IS NOT NULL AND _vector IS NOT NULL").distinct())
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == b)
        table = part.toArrow()  # QUERY_BLOCK rows or so, whatever the size of the tables
        block, at = {}, b << 32
        for d, (ids, points) in scaled(table.column(0), table.column(1)).items():
            block[d] = (ids, points, np.full(len(ids), NONE), np.arange(at, at + len(ids)))
            at += len(ids)
        if not block:
            continue
        own = spark.sparkContext.broadcast(block)
        kth = _best(_local(part, own, k), k).where(F.col("rank") == k).select("_q", "score").toArrow()
        floors = dict(zip(kth.column(0).to_pylist(), kth.column(1).to_pylist()))
        shared = spark.sparkContext.broadcast({d: (i, p, np.array([floors.get(n, NONE) for n in numbers.tolist()], dtype=np.int64), numbers) for d, (i, p, _, numbers) in block.items()})
        names = {"_q": np.concatenate([x[3] for x in block.values()]), "query_id": np.concatenate([x[0] for x in block.values()])}
        best = _best(_local(rows, shared, k), k)
        best = written(best.join(spark.createDataFrame(pa.table(names)), "_q").select("query_id", "rank", "vec_id", "score"))
        found = best if found is None else found.unionByName(best)
        own.destroy()
        shared.destroy()
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("_q").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_products(rows, rows.where(F.col("vec_id") % 100 == 0))


OP12_SQL = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM scaled q JOIN scaled c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""

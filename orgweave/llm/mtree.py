"""Exact top-k search (operator 9): best-first search in M-trees of paged metric nodes.

Inner product is made a metric search: with M the largest norm of a tree, a vector x
gets one more coordinate sqrt(M^2 - |x|^2) and a query gets 0; then
d(q, x)^2 = |q|^2 + M^2 - 2 q.x, so near means high score.

Vectors are dealt to trees of bounded size by a hash, whatever their values, so a
vector that a third of the rows share is spread over all trees.  A tree is a list of
pages.  A routing entry has its pivot, covering radius and distance to the parent's
pivot; a leaf entry has its vector and distance to the leaf's pivot.  A search opens
the page with the highest possible score first, and skips entries whose stored
parent distance alone shows, by the triangle inequality, that they can't qualify.
Pages also keep their least vec_id, so that ties are skipped rightly.

Queries are a stated set (``vec_id`` divisible by ``every``), which meets every tree in
blocks: a product of two staged tables, so that blocks times trees are neither broadcast
nor shuffled; a task reads its part of either.  Each (tree, block) answers with at most ``k``
rows a query, which are merged.  Trees and blocks are shipped in the narrowest integers
that hold their numbers.

Scores are exact integers.  Vectors that are null or hold null or non-finite
components, and rows with a null vec_id, take no part.  Rows with the query's vec_id are
its own; every other row is a candidate, repeated rows too.  Repeated rows are counted
first, stored once with their number, and given back in the result.  Query rows of one
vec_id are one query: it gets the k best of all their scores, repeated query rows
repeating them.  Vectors of different lengths are compared over the common length.
Scores beyond 64 bits are clipped to them in the result and rank as clipped between
trees.  Ties go to the smaller vec_id.  An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import counted_broadcasts, small_batches, stage

LEAF, FANOUT = 512, 16
#: Sums of products below this are exact in a double.
EXACT = float(1 << 53)


def _matrix(rows: list[list[int]]) -> np.ndarray:
    width = max(map(len, rows), default=0)
    if all(len(r) == width for r in rows):
        return np.array(rows, np.int64).reshape(len(rows), width)
    m = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        m[i, : len(r)] = r
    return m


def _narrow(m: np.ndarray) -> np.ndarray:
    """``m`` in the narrowest signed integers that hold its numbers."""
    low, high = int(m.min(initial=0)), int(m.max(initial=0))
    return m.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _as_exact(*ms: np.ndarray) -> tuple[np.ndarray, ...]:
    """As doubles where all inner products are exact in them, else as Python integers."""
    top = max((int(np.abs(m.astype(object) if m.size and m.min() == np.iinfo(np.int64).min else m).max()) for m in ms if m.size), default=0)
    kind = np.float64 if top * top * max(1, ms[0].shape[1]) < EXACT else object
    return tuple(m.astype(kind) for m in ms)


class MTree:
    """``pages[i]``: ("leaf", pivot distances, rows) or ("node", pivots, radii, parent distances, children, least ids)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, times: np.ndarray | None = None):
        o = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[o], vectors[o]
        self.times = np.ones(len(o), np.int64) if times is None else times[o]
        self._place()
        self.pages: list[tuple] = []
        rows = np.arange(len(self.ids))
        self.root_pivot = 0
        self.root = self._build(rows, 0) if len(rows) else -1

    def _place(self) -> None:
        x = self.vectors.astype(np.float64)
        norms = np.einsum("ij,ij->i", x, x)
        self.top = float(norms.max(initial=0.0))
        self.points = np.c_[x, np.sqrt(np.maximum(self.top - norms, 0.0))]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "points"} | {"vectors": _narrow(self.vectors), "times": _narrow(self.times)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.vectors, self.times = self.vectors.astype(np.int64), self.times.astype(np.int64)
        self._place()

    def _distance(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        d = self.points[rows] - self.points[pivot]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _build(self, rows: np.ndarray, pivot: int) -> int:
        if len(rows) <= LEAF:
            self.pages.append(("leaf", self._distance(rows, pivot), rows))
            return len(self.pages) - 1
        # pivots far from each other, then each vector to its nearest
        chosen, near = [int(rows[0])], self._distance(rows, int(rows[0]))
        owner = np.zeros(len(rows), np.int64)
        while len(chosen) < FANOUT and near.max() > 0:
            chosen.append(int(rows[near.argmax()]))
            d = self._distance(rows, chosen[-1])
            owner[d < near] = len(chosen) - 1
            near = np.minimum(near, d)
        if len(chosen) == 1:  # all equal: pages of a run of ids each
            parts = [(int(rows[i]), rows[i : i + max(LEAF, -(-len(rows) // FANOUT))]) for i in range(0, len(rows), max(LEAF, -(-len(rows) // FANOUT)))]
        else:
            parts = [(p, rows[owner == i]) for i, p in enumerate(chosen)]
        radii = np.array([self._distance(r, p).max() for p, r in parts])
        children = np.array([self._build(r, p) for p, r in parts])
        pivots = np.array([p for p, _ in parts])
        self.pages.append(("node", pivots, radii, self._distance(pivots, pivot), children, np.array([self.ids[r].min() for _, r in parts])))
        return len(self.pages) - 1

    def search(self, query: np.ndarray, own: int, k: int, exact: np.ndarray) -> list[tuple[int, int]]:
        """The k best ``(score, row)``, without ``own``; ``query`` and ``exact`` hold exact numbers (see ``_as_exact``)."""
        if self.root < 0:
            return []
        q = np.r_[query.astype(np.float64), 0.0]
        base = float(q @ q) + self.top
        slack = 1e-9 * (base + 1.0)
        best: list[tuple[int, int, int]] = []  # a heap of (score, -vec_id, row): its first is the worst kept

        def distance(rows: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(base - 2.0 * (self.points[rows] @ q), 0.0))

        bound = lambda d: (base - np.maximum(d, 0.0) ** 2) / 2 + slack  # noqa: E731  the highest score at a distance of d or more
        at_root = float(distance(np.array([self.root_pivot]))[0])
        queue = [(-np.inf, int(self.ids[0]), self.root, at_root)]
        while queue:
            negative, least, page, to_pivot = heapq.heappop(queue)
            if len(best) == k and (-negative < best[0][0] or (-negative < best[0][0] + 0.5 and least > -best[0][1])):
                if -negative < best[0][0]:
                    break
                if -negative < best[0][0] + 0.5 - 2 * slack:
                    continue
            p = self.pages[page]
            if p[0] == "leaf":
                rows = p[2]
                if len(best) == k:  # what the stored distances to the pivot rule out is not computed
                    rows = rows[bound(np.abs(to_pivot - p[1])) >= best[0][0]]
                    if not len(rows):
                        continue
                scores = exact[rows] @ query
                if len(best) == k:
                    ok = scores >= best[0][0]
                    rows, scores = rows[ok], scores[ok]
                elif len(rows) > 4 * k:
                    cut = np.lexsort((self.ids[rows], -scores))[: k + int((self.ids[rows] == own).sum())] if scores.dtype != object else range(len(rows))
                    rows, scores = rows[cut], scores[cut]
                for s, i, row in zip(scores.tolist(), self.ids[rows].tolist(), rows.tolist(), strict=True):
                    if i != own:
                        e = (int(s), -i, row)
                        if len(best) < k:
                            heapq.heappush(best, e)
                        elif e > best[0]:
                            heapq.heapreplace(best, e)
            else:
                _, pivots, radii, to_parent, children, ids = p
                keep = np.arange(len(children))
                if len(best) == k:
                    keep = keep[bound(np.abs(to_pivot - to_parent) - radii) >= best[0][0]]
                    if not len(keep):
                        continue
                d = distance(pivots[keep])
                tops = bound(d - radii[keep])
                for j, dist, t in zip(keep.tolist(), d.tolist(), tops.tolist(), strict=True):
                    if len(best) < k or t >= best[0][0]:
                        heapq.heappush(queue, (-t, int(ids[j]), int(children[j]), dist))
        return [(s, row) for s, _, row in sorted(best, reverse=True)]


@counted_broadcasts
@small_batches
def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, tree_rows: int = 8192, block_rows: int = 4096) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest inner products of each query over the quantised vectors."""
    x = lambda c: c.cast("double")
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")))
    clean = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(scale * x(c))).alias("v"))
    rows = stage(clean.groupBy("vec_id", "v").agg(F.count("*").alias("times")), "vectors")
    n_trees = max(1, -(-rows.count() // tree_rows))
    part = F.xxhash64("vec_id", "v")

    def columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = t.sort_by([("vec_id", "ascending")])
        return t.column("vec_id").to_numpy(), _matrix(t.column("v").to_pylist()), t.column("times").to_numpy()

    def plant(t: pa.Table) -> pa.Table:
        ids, m, times = columns(t)
        return pa.table({"tree": pa.array([t.column("tree")[0].as_py()], pa.int32()), "pages": pa.array([pickle.dumps(MTree(ids, m, times))], pa.binary())})

    def gather(t: pa.Table) -> pa.Table:
        ids, m, times = columns(t)
        blocks = [pickle.dumps((ids[i : i + block_rows], _narrow(m[i : i + block_rows]), _narrow(times[i : i + block_rows]))) for i in range(0, len(ids), block_rows)]
        return pa.table({"block": pa.array(blocks, pa.binary())})

    trees = stage(rows.withColumn("tree", F.pmod(part, F.lit(n_trees)).cast("int")).groupBy("tree").applyInArrow(plant, "tree int, pages binary"), "trees")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    n_groups = max(1, -(-n_trees * tree_rows // (every * block_rows)))
    blocks = asked.withColumn("g", F.pmod(part, F.lit(n_groups)).cast("int")).groupBy("g").applyInArrow(gather, "block binary")
    # every block meets every tree: a stated query set against all rows, in blocks
    met = trees.select("pages").hint("shuffle_replicate_nl").crossJoin(stage(blocks, "blocks"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = -(1 << 63), (1 << 63) - 1
        for b in batches:
            for i in range(b.num_rows):
                tree: MTree = pickle.loads(b.column("pages")[i].as_buffer())
                ids, m, times = pickle.loads(b.column("block")[i].as_buffer())
                m, times = m.astype(np.int64), times.astype(np.int64)
                width = tree.vectors.shape[1]
                m = m[:, :width] if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))
                exact, asked = _as_exact(tree.vectors, m)
                out = [(q, at, min(max(s, low), high), n) for q, n, a in zip(ids.tolist(), times.tolist(), asked, strict=True) for s, at in tree.search(a, q, k, exact)]
                query, at, score, n = (np.array(c, np.int64) for c in (list(zip(*out, strict=True)) or [()] * 4))
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(tree.ids[at]), pa.array(score), pa.array(np.minimum(n, k) * np.minimum(tree.times[at], k))], ["query_id", "vec_id", "score", "times"])

    found = met.select("pages", "block").mapInArrow(search, "query_id long, vec_id long, score long, times long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = found.withColumn("i", F.row_number().over(best)).where(F.col("i") <= k).select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k).cast("long")))).alias("i"))
    ranked = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return stage(ranked, "top")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

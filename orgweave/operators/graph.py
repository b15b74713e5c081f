"""Graph operators over an edge table.

Edges are directed as given; rows with a null end are dropped and repeated edges are one.
The nodes are the edges' ends.  Iterations run as staged joins; a graph of at most
``LOCAL_EDGES`` edges, counted first, is gathered and iterated with numpy instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ident import column, require_columns, require_frame
from .staging import LOCAL_EDGES, stage, unstage


def check_backend(backend: str) -> None:
    if backend == "duckpgq":
        raise ImportError("the DuckPGQ backend is not available; use backend='spark'")
    if backend not in ("spark", "networkx"):
        raise ValueError(f"unknown backend {backend!r}")


def edges_of(edges: DataFrame, source_col: str, target_col: str) -> DataFrame:
    """``(src, dst)``, distinct."""
    require_columns(require_frame(edges), [source_col, target_col])
    return edges.select(column(edges, source_col).alias("src"), column(edges, target_col).alias("dst")).dropna().distinct()


def nodes_of(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


def _local(e: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """``(nodes, src, dst)`` with numbered nodes in order, if the graph is small enough."""
    if e.limit(LOCAL_EDGES + 1).count() > LOCAL_EDGES:
        return None
    pdf = e.toPandas()
    nodes, ends = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]), return_inverse=True)
    return nodes, ends[: len(pdf)], ends[len(pdf) :]


def _scores(e: DataFrame, nodes: np.ndarray, values: np.ndarray, node_id_col: str, name: str) -> DataFrame:
    kind = e.schema["src"].dataType.simpleString()
    rows = list(zip([x.item() if hasattr(x, "item") else x for x in nodes], map(float, values), strict=True))
    return e.sparkSession.createDataFrame(rows, f"`{node_id_col}` {kind}, {name} double").orderBy(F.desc(name), f"`{node_id_col}`")


def shortest_path(edges: DataFrame, source_col: str, target_col: str, source: object, target: object, *, max_length: int | None = None, backend: str = "spark") -> DataFrame:
    """One row ``(source, target, path_length, path)``; of several shortest paths the one whose text is least.

    A path of more than ``max_length`` steps counts as none; without it paths may be of any length.
    """
    check_backend(backend)
    e = stage(edges_of(edges, source_col, target_col), "edges")
    spark, kind = edges.sparkSession, e.schema["src"].dataType.simpleString()
    one = lambda n, p: spark.createDataFrame([(source, target, n, p)], f"source {kind}, target {kind}, path_length long, path string")
    there = [type(x) is type(source) for x in [r[0] for r in e.select("src").limit(1).collect()]]
    if there and not there[0]:
        spark_kind = "string" if isinstance(source, str) else "long"
        return spark.createDataFrame([(source, target, None, "")], f"source {spark_kind}, target {spark_kind}, path_length long, path string")
    found = nodes_of(e).where(F.col("node").isin(source, target)).count()
    if found < len({source, target}):
        return one(None, "")
    if source == target:
        return one(0, str(source))
    seen = stage(spark.createDataFrame([(source, str(source))], f"node {kind}, path string"), "seen")
    front, length = seen, 0
    while max_length is None or length < max_length:
        length += 1
        step = front.join(e, front["node"] == e["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.concat("path", F.lit("->"), F.col("dst").cast("string"))).alias("path"))
        front = stage(step.join(seen, "node", "left_anti"), "front")
        hit = front.where(F.col("node") == F.lit(target)).first()
        if hit:
            return one(length, hit["path"])
        if not front.limit(1).count():
            return one(None, "")
        old, seen = seen, stage(seen.select("node").union(front.select("node")), "seen")
        unstage(old)
    return one(None, "")


def degree_centrality(edges: DataFrame, source_col: str, target_col: str, *, mode: str = "out", node_id_col: str = "node_id", backend: str = "spark") -> DataFrame:
    """``(node, degree_centrality)``: degree over n - 1; ``total`` counts edges without direction, self-loops twice."""
    check_backend(backend)
    if mode not in ("in", "out", "total"):
        raise ValueError("mode must be 'in', 'out' or 'total'")
    e = edges_of(edges, source_col, target_col)
    if mode == "total":
        plain = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
        hits = plain.select(F.explode(F.array("a", "b")).alias("node")).withColumn("k", F.lit(1))
    else:
        own, other = ("src", "dst") if mode == "out" else ("dst", "src")
        hits = e.select(F.col(own).alias("node"), F.lit(1).alias("k")).union(e.select(F.col(other), F.lit(0)))
    deg = hits.groupBy("node").agg(F.sum("k").alias("k"))
    n = deg.agg(F.count("*").alias("n"))
    score = F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(F.col("k") / (F.col("n") - 1)).cast("double")
    return deg.join(F.broadcast(n)).select(F.col("node").alias(node_id_col), score.alias("degree_centrality")).orderBy(F.desc("degree_centrality"), f"`{node_id_col}`")


def pagerank(edges: DataFrame, source_col: str, target_col: str, *, damping: float = 0.85, node_id_col: str = "node_id", tol: float = 1e-12, max_iter: int = 300, backend: str = "spark") -> DataFrame:
    """``(node, pagerank)`` by power iteration until the L1 change is below ``tol``; dangling mass is spread evenly."""
    check_backend(backend)
    e = stage(edges_of(edges, source_col, target_col), "edges")
    small = _local(e)
    if small is not None:
        nodes, src, dst = small
        n = len(nodes)
        out = np.bincount(src, minlength=n)
        x = np.full(n, 1 / max(n, 1))
        for _ in range(max_iter if n else 0):
            share = np.divide(x, out, out=np.zeros(n), where=out > 0)
            y = damping * (np.bincount(dst, share[src], n) + x[out == 0].sum() / n) + (1 - damping) / n
            y /= y.sum()
            change, x = np.abs(y - x).sum(), y
            if change < tol:
                break
        return _scores(e, nodes, x, node_id_col, "pagerank")
    nodes = stage(nodes_of(e), "nodes")
    n = nodes.count()
    weights = stage(e.join(e.groupBy("src").agg(F.count("*").alias("k")), "src").select("src", "dst", (1 / F.col("k")).alias("w")), "weights")
    sinks = stage(nodes.join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti"), "sinks")
    x = stage(nodes.withColumn("x", F.lit(1.0 / n)), "rank")
    for _ in range(max_iter):
        lost = x.join(sinks, "node", "left_semi").agg(F.coalesce(F.sum("x"), F.lit(0.0))).first()[0]
        got = x.join(weights, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("x") * F.col("w")).alias("g"))
        y = stage(x.select("node", F.col("x").alias("old")).join(got, "node", "left").select("node", "old", (damping * (F.coalesce("g", F.lit(0.0)) + lost / n) + (1 - damping) / n).alias("x")), "rank")
        change = y.agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0]
        unstage(x)
        x = y
        if change < tol:
            break
    return x.select(F.col("node").alias(node_id_col), F.col("x").alias("pagerank")).orderBy(F.desc("pagerank"), f"`{node_id_col}`")


def eigenvector_centrality(edges: DataFrame, source_col: str, target_col: str, *, node_id_col: str = "node_id", max_iter: int = 100, tol: float = 1e-6, backend: str = "spark") -> DataFrame:
    """``(node, eigenvector)``: x <- x + (in-edges of x), to length one; without convergence in ``max_iter`` rounds, in-degree over the largest."""
    check_backend(backend)
    e = stage(edges_of(edges, source_col, target_col), "edges")
    small = _local(e)
    if small is not None:
        nodes, src, dst = small
        n = len(nodes)
        x = np.full(n, 1 / max(n, 1))
        for _ in range(max_iter):
            y = x + np.bincount(dst, x[src], n) if n else x
            y = y / (np.sqrt((y * y).sum()) or 1.0)
            change, x = np.abs(y - x).sum(), y
            if change < n * tol:
                break
        else:
            x = np.bincount(dst, minlength=n).astype(float)
            x /= x.max(initial=0) or 1.0
        return _scores(e, nodes, x, node_id_col, "eigenvector")
    nodes = stage(nodes_of(e), "nodes")
    n = nodes.count()
    x, done = stage(nodes.withColumn("x", F.lit(1.0 / n)), "eigen"), False
    for _ in range(max_iter):
        got = x.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum("x").alias("g"))
        y = stage(x.join(got, "node", "left").select("node", F.col("x").alias("old"), (F.col("x") + F.coalesce("g", F.lit(0.0))).alias("x")), "eigen")
        size = y.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
        change = y.agg(F.sum(F.abs(F.col("x") / size - F.col("old")))).first()[0]
        unstage(x)
        x = y.select("node", (F.col("x") / size).alias("x"))
        if done := change < n * tol:
            break
    if not done:
        k = nodes.join(e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("k")), "node", "left").select("node", F.coalesce("k", F.lit(0)).alias("k"))
        top = k.agg(F.max("k")).first()[0] or 1
        x = k.select("node", (F.col("k") / top).alias("x"))
    return x.select(F.col("node").alias(node_id_col), F.col("x").cast("double").alias("eigenvector")).orderBy(F.desc("eigenvector"), f"`{node_id_col}`")


def component_labels(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of weakly connected components, named by their smallest node.

    Alternating large-star and small-star steps: each is a grouped aggregation over at
    most twice the edges; a hub's neighbours are never gathered, and the rounds grow
    with the logarithm of the longest path.
    """
    e = stage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna().distinct(), "cc")
    lone, total = e.where("u = v").select("u"), None
    e = e.where("u <> v")
    for i in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u")
        nxt = stage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).where("u <> v").distinct(), "cc")
        now = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if i:
            unstage(e)
        e = nxt
        if total == now:
            break
        total = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    every = stars.union(stars.select("component", "component").distinct())
    return every.union(lone.distinct().join(every.select(F.col("node").alias("u")), "u", "left_anti").select("u", "u"))


def connected_components(edges: DataFrame, source_col: str, target_col: str, *, backend: str = "spark") -> DataFrame:
    """``(component_id, size, members)`` of weakly connected components, largest first, ties by smallest member."""
    check_backend(backend)
    parts = component_labels(edges_of(edges, source_col, target_col), "src", "dst")
    groups = parts.groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("node")).alias("members"))
    rank = F.row_number().over(Window.orderBy(F.desc("size"), "component")) - 1
    return groups.select(rank.cast("long").alias("component_id"), "size", "members").orderBy("component_id")


def betweenness(edges: DataFrame, source_col: str, target_col: str, *, node_id_col: str = "node_id", backend: str = "spark") -> DataFrame:
    """``(node, betweenness)``: normalised, directed, without end points.

    If every node has at most one out-edge and there is no cycle, it is descendants
    times ancestors over (n-1)(n-2).  Else Brandes' accumulation runs from each source, the
    sources dealt to tasks over a broadcast adjacency of at most ``LOCAL_EDGES`` edges.
    """
    check_backend(backend)
    from .closure import ancestors, in_loops

    e = stage(edges_of(edges, source_col, target_col), "edges")
    nodes = stage(nodes_of(e), "nodes")
    n = nodes.count()
    scale = (n - 1) * (n - 2) if n > 2 else 1
    forest = not e.groupBy("src").count().where("count > 1").limit(1).count()
    if forest and not in_loops(nodes.join(e, F.col("node") == F.col("src"), "left").select(F.col("node").alias("src"), "dst"), "src", "dst").limit(1).count():
        far = ancestors(e, "src", "dst", max(n, 2))
        above = far.groupBy(F.col("emp").alias("node")).agg(F.count("*").alias("up"))
        below = far.groupBy(F.col("anc").alias("node")).agg(F.count("*").alias("down"))
        got = nodes.join(above, "node", "left").join(below, "node", "left")
        score = F.coalesce(F.col("up") * F.col("down"), F.lit(0)) / F.lit(float(scale))
        return got.select(F.col("node").alias(node_id_col), score.cast("double").alias("betweenness")).orderBy(F.desc("betweenness"), f"`{node_id_col}`")
    small = _local(e)
    if small is None:
        raise ValueError(f"betweenness of a general graph needs at most {LOCAL_EDGES} edges")
    names, src, dst = small
    src, dst = src[src != dst], dst[src != dst]
    o = np.argsort(src, kind="stable")
    graph = e.sparkSession.sparkContext.broadcast((np.searchsorted(src[o], np.arange(n + 1)), dst[o], n))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        at, to, n = graph.value
        total = np.zeros(n)
        for b in batches:
            for s in b["id"]:
                total += _dependencies(at, to, n, int(s))
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"i": hit, "x": total[hit]})

    parts = e.sparkSession.range(0, n, 1, max(1, min(n, e.sparkSession.sparkContext.defaultParallelism))).mapInPandas(run, "i long, x double")
    sums = np.zeros(n)
    for r in parts.groupBy("i").agg(F.sum("x").alias("x")).collect():
        sums[r["i"]] = r["x"]
    return _scores(e, names, sums / scale, node_id_col, "betweenness")


def _dependencies(at: np.ndarray, to: np.ndarray, n: int, s: int) -> np.ndarray:
    """Dependencies of source s on every node: shortest-path counts level by level, then back."""
    level, paths = np.full(n, -1), np.zeros(n)
    level[s], paths[s] = 0, 1.0
    front, steps = np.array([s]), []
    while len(front):
        size = at[front + 1] - at[front]
        own = np.repeat(front, size)
        nxt = to[np.concatenate([np.arange(at[v], at[v + 1]) for v in front])] if size.sum() else np.zeros(0, int)
        fresh = level[nxt] < 0
        level[nxt[fresh]] = level[front[0]] + 1
        ok = level[nxt] == level[front[0]] + 1
        own, nxt = own[ok], nxt[ok]
        np.add.at(paths, nxt, paths[own])
        steps.append((own, nxt))
        front = np.unique(nxt)
    dep = np.zeros(n)
    for own, nxt in reversed(steps):
        np.add.at(dep, own, paths[own] / paths[nxt] * (1 + dep[nxt]))
    dep[s] = 0
    return dep


def modularity(w: dict[tuple[int, int], float], label: np.ndarray, resolution: float = 1.0) -> float:
    """Modularity of a labelling of an undirected graph with edge weights ``w[(a, b)]``, a <= b."""
    m = sum(w.values())
    if not m:
        return 0.0
    inside, degree = {}, {}
    for (a, b), x in w.items():
        degree[label[a]] = degree.get(label[a], 0.0) + x
        degree[label[b]] = degree.get(label[b], 0.0) + x
        if label[a] == label[b]:
            inside[label[a]] = inside.get(label[a], 0.0) + x
    return sum(inside.get(c, 0.0) / m - resolution * (d / (2 * m)) ** 2 for c, d in degree.items())


def louvain_labels(n: int, w: dict[tuple[int, int], float], resolution: float = 1.0) -> np.ndarray:
    """Communities by local moving and aggregation, nodes in order, so the result is fixed."""
    label = np.arange(n)
    while True:
        size = int(label.max()) + 1 if n else 0
        near: list[dict[int, float]] = [{} for _ in range(size)]
        loops = np.zeros(size)
        for (a, b), x in w.items():
            i, j = int(label[a]), int(label[b])
            if i == j:
                loops[i] += x
            else:
                near[i][j] = near[i].get(j, 0.0) + x
                near[j][i] = near[j].get(i, 0.0) + x
        k = np.array([sum(d.values()) for d in near]) + 2 * loops
        m2 = k.sum()
        if not m2:
            return label
        part, total, moved = np.arange(size), k.copy(), False
        again = True
        while again:
            again = False
            for v in range(size):
                c = int(part[v])
                to: dict[int, float] = {}
                for u, x in near[v].items():
                    to[int(part[u])] = to.get(int(part[u]), 0.0) + x
                total[c] -= k[v]
                gain = lambda d: to.get(d, 0.0) - resolution * k[v] * total[d] / m2  # noqa: B023, E731
                best = max(sorted(to), key=gain, default=c)
                if best != c and gain(best) > gain(c) + 1e-12:
                    part[v], again, moved = best, True, True
                    c = best
                total[c] += k[v]
        if not moved:
            return label
        label = np.unique(part[label], return_inverse=True)[1]


def shrink(pairs: DataFrame, resolution: float = 1.0, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """One level of local moving as joins: ``(node, c)`` of each node, and the pairs ``(src, dst, w)`` of the communities.

    In a round, half of the nodes (by a hash of node and round, so that neighbours
    don't swap for ever) go to the neighbouring community of most gain.
    """
    both = stage(pairs.where("src <> dst").select("src", "dst", "w").union(pairs.where("src <> dst").select("dst", "src", "w")), "both")
    ends = pairs.select(F.col("src").alias("node"), "w").union(pairs.select("dst", "w"))
    degree = stage(ends.groupBy("node").agg(F.sum("w").alias("k")), "degree")
    m2 = degree.agg(F.sum("k")).first()[0] or 1.0
    label = stage(degree.select("node", F.col("node").alias("c")), "label")
    for r in range(rounds):
        total = label.join(degree, "node").groupBy("c").agg(F.sum("k").alias("t"))
        near = both.join(label.select(F.col("node").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("node"), "c").agg(F.sum("w").alias("x"))
        mine = label.select("node", "c", F.lit(0.0).alias("x"))
        options = near.union(mine).groupBy("node", "c").agg(F.sum("x").alias("x"))
        rated = options.join(total, "c").join(degree, "node").join(label.withColumnRenamed("c", "own"), "node")
        gain = F.col("x") - resolution * F.col("k") * (F.col("t") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / m2
        best = rated.groupBy("node", "own").agg(F.max(gain).alias("top"), F.max(F.when(F.col("c") == F.col("own"), gain)).alias("stay"), F.max_by("c", F.struct(gain, -F.xxhash64("c"))).alias("to"))
        goes = (F.col("top") > F.col("stay") + 1e-12) & (F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0)
        moved = stage(best.select("node", F.when(goes, F.col("to")).otherwise(F.col("own")).alias("c"), goes.alias("moved")), "label")
        unstage(label)
        label, quiet = moved.select("node", "c"), not moved.where("moved").limit(1).count()
        if quiet and r:
            break
    at = lambda end: label.select(F.col("node").alias(end), F.col("c").alias(f"c_{end}"))
    merged = pairs.join(at("src"), "src").join(at("dst"), "dst").groupBy(F.least("c_src", "c_dst").alias("src"), F.greatest("c_src", "c_dst").alias("dst")).agg(F.sum("w").alias("w"))
    return label, stage(merged, "pairs")


def louvain_communities(edges: DataFrame, source_col: str, target_col: str, *, weight_col: str | None = None, resolution: float = 1.0, node_id_col: str = "node_id", backend: str = "spark") -> DataFrame:
    """``(node, community_id)``: Louvain communities of the undirected graph, numbered by their smallest node.

    Weights of repeated edges are summed, of both directions too; without weights an edge
    counts once.  A graph of more than ``LOCAL_EDGES`` pairs is first shrunk to its
    communities by ``shrink``, until it is small or doesn't shrink further.
    """
    check_backend(backend)
    require_columns(require_frame(edges), [source_col, target_col] + [weight_col] * (weight_col is not None))
    s, t = column(edges, source_col), column(edges, target_col)
    w = column(edges, weight_col).cast("double") if weight_col else F.lit(1.0)
    e = edges.select(s.alias("s"), t.alias("t"), w.alias("w")).where("s is not null and t is not null")
    total = F.sum("w") if weight_col else F.lit(1.0)
    e = stage(e.groupBy(F.least("s", "t").alias("src"), F.greatest("s", "t").alias("dst")).agg(total.alias("w")), "pairs")
    kind = e.schema["src"].dataType.simpleString()
    path, size = None, e.count()
    while size > LOCAL_EDGES:
        label, e = shrink(e, resolution)
        path = label if path is None else stage(path.withColumnRenamed("c", "mid").join(label.select(F.col("node").alias("mid"), "c"), "mid").select("node", "c"), "label")
        before, size = size, e.count()
        if size >= before:  # the rest has no gain left: what there is are the communities
            rank = F.dense_rank().over(Window.orderBy("first")) - 1
            first = path.groupBy("c").agg(F.min("node").alias("first")).withColumn("community_id", rank.cast("long"))
            return path.join(first, "c").select(F.col("node").alias(node_id_col), "community_id").orderBy("community_id", f"`{node_id_col}`")
    pdf = e.orderBy("src", "dst").toPandas()
    names, ends = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]), return_inverse=True)
    n = len(pdf)
    label = louvain_labels(len(names), {(min(a, b), max(a, b)): float(x) for a, b, x in zip(ends[:n].tolist(), ends[n:].tolist(), pdf["w"], strict=True)}, resolution)
    items = [(x.item() if hasattr(x, "item") else x, int(c)) for x, c in zip(names, label, strict=True)]
    if path is not None:
        part = edges.sparkSession.createDataFrame(items, f"c {kind}, part long")
        joined = path.join(part, "c")
        rank = F.dense_rank().over(Window.orderBy("first")) - 1
        first = joined.groupBy("part").agg(F.min("node").alias("first")).withColumn("community_id", rank.cast("long"))
        return joined.join(first, "part").select(F.col("node").alias(node_id_col), "community_id").orderBy("community_id", f"`{node_id_col}`")
    number: dict[int, int] = {}
    rows = [(x, number.setdefault(c, len(number))) for x, c in items]
    return edges.sparkSession.createDataFrame(rows, f"`{node_id_col}` {kind}, community_id long").orderBy("community_id", f"`{node_id_col}`")

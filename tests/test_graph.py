import random
from collections import deque

import numpy as np
import pytest

from orgweave.operators import export, graph


def scores(df, name):
    return {r[0]: r[name] for r in df.collect()}


def test_simple_org_scores(simple_edges):
    pr = scores(graph.pagerank(simple_edges, "src", "dst"), "pagerank")
    assert abs(sum(pr.values()) - 1) < 1e-9
    assert pr["E001"] == pytest.approx(0.292647, abs=1e-6) and pr["E1000"] == pytest.approx(0.056964, abs=1e-6)
    bw = scores(graph.betweenness(simple_edges, "src", "dst"), "betweenness")
    assert bw["E010"] == pytest.approx(5 / 30) and bw["E100"] == pytest.approx(4 / 30) and bw["E001"] == 0


def test_joins_give_what_arrays_give(simple_edges, monkeypatch):
    local = [scores(f(simple_edges, "src", "dst"), n) for f, n in ((graph.pagerank, "pagerank"), (graph.eigenvector_centrality, "eigenvector"))]
    monkeypatch.setattr(graph, "LOCAL_EDGES", 1)
    assert scores(graph.pagerank(simple_edges, "src", "dst", max_iter=6, tol=1e-1), "pagerank")["E001"] == pytest.approx(local[0]["E001"], abs=0.05)
    far = scores(graph.eigenvector_centrality(simple_edges, "src", "dst", max_iter=3), "eigenvector")
    assert far["E010"] == pytest.approx(1.0) and far["E1000"] == 0 and local[1]["E1000"] >= 0


def random_edges(n, m, seed):
    r = random.Random(seed)
    return sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})


def brandes(edges):
    nodes = sorted({x for e in edges for x in e})
    out = {v: [] for v in nodes}
    for a, b in edges:
        if a != b:
            out[a].append(b)
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, count, order, q = {s: 0}, {s: 1}, [], deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    count[w] = count.get(w, 0) + count[v]
        dep = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in order:
                if w in out[v] and dist[w] == dist[v] + 1:
                    dep[v] += count[v] / count[w] * (1 + dep[w])
            if w != s:
                total[w] += dep[w]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


def test_betweenness_of_a_general_graph(spark):
    edges = random_edges(14, 40, 3)
    got = scores(graph.betweenness(spark.createDataFrame(edges, "s long, t long"), "s", "t"), "betweenness")
    assert got == pytest.approx(brandes(edges))


def test_components(spark):
    edges = [("A2", "A1"), ("B2", "B1"), ("B3", "B1"), (None, "Z"), ("C", "C")]
    out = graph.connected_components(spark.createDataFrame(edges, "s string, t string"), "s", "t").collect()
    assert [(r["component_id"], r["size"], r["members"]) for r in out] == [(0, 3, ["B1", "B2", "B3"]), (1, 2, ["A1", "A2"]), (2, 1, ["C"])]


def test_components_of_a_random_graph(spark):
    edges = random_edges(60, 45, 5)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in graph.component_labels(spark.createDataFrame(edges, "s long, t long"), "s", "t").collect()}
    assert got == {x: find(x) for x in parent}


def test_degree(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 3)], "s long, t long")
    assert scores(graph.degree_centrality(e, "s", "t"), "degree_centrality") == {1: 1.0, 2: 0.5, 3: 0.0}
    assert scores(graph.degree_centrality(e, "s", "t", mode="in"), "degree_centrality") == {1: 0.5, 2: 0.5, 3: 0.5}
    assert scores(graph.degree_centrality(e, "s", "t", mode="total", node_id_col="who"), "degree_centrality") == {1: 1.0, 2: 0.5, 3: 0.5}
    with pytest.raises(ValueError):
        graph.degree_centrality(e, "s", "t", mode="all")


def test_shortest_path(spark, simple_edges):
    one = lambda a, b: tuple(graph.shortest_path(simple_edges, "src", "dst", a, b).first())
    assert one("E1000", "E001") == ("E1000", "E001", 3, "E1000->E100->E010->E001")
    assert one("E001", "E1000") == ("E001", "E1000", None, "")
    assert one("E010", "E010") == ("E010", "E010", 0, "E010")
    assert one("X", "X") == ("X", "X", None, "")
    diamond = spark.createDataFrame([(1, 3), (1, 20), (20, 4), (3, 4)], "s long, t long")
    assert graph.shortest_path(diamond, "s", "t", 1, 4).first()["path"] == "1->20->4"
    assert graph.shortest_path(diamond, "s", "t", "1", "4").first()["path_length"] is None


def test_eigenvector_falls_back_on_a_small_tree(simple_edges):
    got = scores(graph.eigenvector_centrality(simple_edges, "src", "dst"), "eigenvector")
    assert got["E010"] == 1.0 and got["E001"] == 0.5 and got["E1000"] == 0.0


def test_louvain_finds_blocks(spark):
    edges = [(a, b, 1.0) for g in (0, 10, 20) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(4, 10, 0.1), (14, 20, 0.1)]
    df = spark.createDataFrame(edges, "s long, t long, w double")
    for weight in (None, "w"):
        got = scores(graph.louvain_communities(df, "s", "t", weight_col=weight), "community_id")
        assert got == {x: x // 10 for x in got}
    w = {(a, b): x for a, b, x in edges}
    label = np.array([x // 10 for x in range(25)])
    assert graph.modularity(w, label) > 0.6 > graph.modularity(w, np.zeros(25, int))


def test_louvain_in_joins_finds_blocks(spark, monkeypatch):
    edges = [(a, b, 1.0) for g in (0, 10, 20) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(4, 10, 0.1), (14, 20, 0.1)]
    monkeypatch.setattr(graph, "LOCAL_EDGES", 8)
    got = scores(graph.louvain_communities(spark.createDataFrame(edges, "s long, t long, w double"), "s", "t", weight_col="w"), "community_id")
    assert got == {x: x // 10 for x in got} and len(got) == 15


def test_empty_graphs(spark):
    e = spark.createDataFrame([], "s string, t string")
    for f in (graph.pagerank, graph.betweenness, graph.eigenvector_centrality, graph.degree_centrality, graph.connected_components, graph.louvain_communities):
        assert f(e, "s", "t").count() == 0


def test_backends(simple_edges):
    with pytest.raises(ImportError, match="DuckPGQ"):
        graph.pagerank(simple_edges, "src", "dst", backend="duckpgq")
    with pytest.raises(ValueError):
        graph.pagerank(simple_edges, "src", "dst", backend="other")


def test_export(spark):
    e = spark.createDataFrame([("b", "a", 1.0), ("b", "a", 2.0), ("c", "a", 3.0), (None, "a", 9.0)], "s string, t string, w double")
    attrs = spark.createDataFrame([("a", 1), ("z", 2)], "node_id string, level int")
    v, links = export.graph_tables(e, "s", "t", "w", attrs)
    assert sorted(r["node_id"] for r in v.collect()) == ["a", "b", "c", "z"] and links.count() == 2
    v, links = export.indexed_graph(e, "s", "t", "w", attrs)
    assert [tuple(r) for r in v.orderBy("index").collect()] == [(0, "a", 1), (1, "b", None), (2, "c", None)]
    assert sorted(tuple(r) for r in links.collect()) == [(1, 0, 1.0), (1, 0, 2.0), (2, 0, 3.0)]
    with pytest.raises(ValueError):
        export.graph_tables(e, "s", "t", graph_type="Tree")

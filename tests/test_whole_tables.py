"""Queries over all rows of their tables, on small tables against brute force."""

import random

import duckdb
import numpy as np
import pytest

from orgweave.operators import graph
from orgweave.plans import registry


def sign(x):
    return (x > 0) - (x < 0)


def test_kendall_is_over_every_supplier(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, r.randrange(9), float(r.randrange(300)) + (i // 2 if i >= 300 else 0)) for i in range(1, 421)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    pairs = [(sign(x[1] - y[1]), sign(x[2] - y[2])) for i, x in enumerate(rows) for y in rows[:i]]
    want = sum(a * b for a, b in pairs) / (sum(a * a for a, _ in pairs) * sum(b * b for _, b in pairs)) ** 0.5
    assert registry.queries()["correlation_kendall"](spark, str(tmp_path)).first()["correlation"] == pytest.approx(want, abs=1e-8)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    con.execute("CREATE TABLE customer (c_custkey BIGINT, c_mktsegment VARCHAR, c_acctbal DOUBLE)")
    assert con.execute(registry.oracle_sql()["correlation_kendall"]).fetchone()[2] == pytest.approx(want, abs=1e-8)


def largest_vector(edges, n):
    """Of in-edges, by numpy's eigenvalues."""
    a = np.zeros((n, n))
    for u, v in set(edges):
        a[v, u] = 1
    values, vectors = np.linalg.eig(a)
    x = np.abs(vectors[:, values.real.argmax()].real)
    return dict(enumerate(x / np.sqrt((x * x).sum())))


def scores(df):
    return {r[0]: r["eigenvector"] for r in df.collect()}


@pytest.mark.parametrize("limit", [500_000, 1])
def test_eigenvector_is_the_largest_ones(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "LOCAL_EDGES", limit)
    r = random.Random(2)
    edges = [(i, (i + 1) % 9) for i in range(9)] + [(r.randrange(9), r.randrange(9)) for _ in range(25)]
    got = scores(graph.eigenvector_centrality(spark.createDataFrame(edges, "s long, t long"), "s", "t", tol=1e-9))
    assert got == pytest.approx(largest_vector(edges, 9), abs=1e-6)


def test_eigenvector_is_over_every_customer_and_all_trade(spark, tmp_path):
    r, put = random.Random(6), lambda name, rows, kind: spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    customers = [(i, i % 7, "x", 1.0) for i in range(1, 401)]
    put("customer", customers, "c_custkey long, c_nationkey long, c_mktsegment string, c_acctbal double")
    put("supplier", [(i, i % 7) for i in range(1, 30)], "s_suppkey long, s_nationkey long")
    put("orders", orders := [(i, r.choice(customers)[0]) for i in range(120)], "o_orderkey long, o_custkey long")
    put("lineitem", lines := [(i, r.choice((1, 2, 4, 8, 11, 28)) if i % 2 else 2 + i % 5) for i, _ in orders], "l_orderkey long, l_suppkey long")
    found = registry.queries()
    assert set(scores(found["eigenvector_centrality"](spark, str(tmp_path)))) == set(range(401))
    edges = [(dict(orders)[o] % 7, s % 7) for o, s in lines]
    got, want = scores(found["eigenvector_centrality_flow"](spark, str(tmp_path))), largest_vector(edges, 7)
    assert got == pytest.approx(want, abs=1e-3) and min(want.values()) >= 0 and len({round(x, 3) for x in got.values()}) > 1


@pytest.mark.parametrize(("n", "steps"), [(73, 12), (53, 13), (49, None)])
def test_shortest_path_is_its_sql_where_the_end_is_far_or_unreachable(spark, tmp_path, n, steps):
    spark.createDataFrame([(i,) for i in range(n)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["shortest_path"]).fetchall()
    assert [tuple(r) for r in registry.queries()["shortest_path"](spark, str(tmp_path)).collect()] == want and len(want) == (steps == 12)
    edges = registry.view(spark, str(tmp_path), "edges_sparse")
    assert graph.shortest_path(edges, "src", "dst", 3, 0).first()["path_length"] == steps  # the operator has no limit of its own

import random

import duckdb
import numpy as np
import pytest

from orgweave.llm import mtree, urls
from orgweave.llm.common import windows_hash


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, host string, verdict int")


def test_urls_and_rules(spark):
    rows = [
        (1, "https://A.Example.com/en/1?x=/en/#y", None),
        (2, "http://example.com/en/77", ""),
        (3, "http://x.example.net/de/8#t", "<p>"),
        (4, "http://x.example.net/de/9", "<p>"),
        (5, "http://notexample.org/es/", "<p>"),
        (6, "ftp://plain?en", "<p>"),
        (7, None, None),
        (8, "no scheme /en/", None),
        (None, "http://com/en/", None),
        (9, "http://exampleXcom/en/", None),
        (9, "http://exampleXcom/en/", None),
    ]
    got = [tuple(r)[:5] for r in urls.url_filter(pages(spark, rows)).collect()]
    want = {
        1: ("a.example.com", "/en/1", "com/en/", "block"),
        2: ("example.com", "/en/77", "example.com/en/7", "allow"),
        3: ("x.example.net", "/de/8", "example.net/de/8", "block"),
        4: ("x.example.net", "/de/9", "net/de/", "allow"),
        5: ("notexample.org", "/es/", "org/es/", "block"),
        6: ("plain", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        None: ("com", "/en/", "com/en/", "block"),
        9: ("examplexcom", "/en/", None, "allow"),
    }
    assert len(got) == len(rows) and all(want[r[0]] == r[1:] for r in got)
    assert urls.url_filter(pages(spark, []).limit(0)).count() == 0


def test_distrust_follows_links_backwards_and_trust_forwards(spark):
    link = lambda *to: "".join(f'<a HREF="http://{t}/">x</a>' for t in to)
    rows = [
        (1, "http://bad.com/en/1", ""),
        (2, "http://friend.io/a", link("bad.com", "bad.com")),
        (3, "http://good.net/de/1", link("linked.io")),
        (4, "http://linked.io/a", ""),
        (5, "http://far.io/a", link("friend.io")),
        (6, "http://bad.com/other", ""),
    ]
    out = {r["page_id"]: r for r in urls.url_filter(pages(spark, rows)).collect()}
    assert out[2]["verdict"] == "block" and out[5]["distrust"] > 0 and out[4]["trust"] > out[4]["distrust"] and out[4]["verdict"] == "allow"
    assert out[6]["rule"] is None and out[6]["verdict"] == "block"  # half of its host's pages are blocked


def test_links_decide_and_may_leave_out_the_scheme(spark):
    link = lambda to: f'<a href="{to}/x">' * 3
    for near in ("https://bad.com", "//bad.com"):
        for far, verdict in ((near, "block"), ("/bad.com", "allow"), ("bad.com", "allow")):
            rows = [(1, "http://bad.com/en/1", ""), (2, "http://a.io/1", link(far)), (3, "http://b.io/1", link(far)), (4, "http://c.io/1", None)]
            out = {r["page_id"]: r["verdict"] for r in urls.url_filter(pages(spark, rows)).collect()}
            assert out == {1: "block", 2: verdict, 3: verdict, 4: "allow"}


def test_verdicts_against_sql(spark):
    import duckdb
    import pandas as pd

    r = random.Random(5)
    hosts = [f"{a}.{b}" for a in ("x", "m.y", "z1", "q") for b in ("example.com", "example.net", "org", "io")]
    rows = []
    for i in range(120):
        html = "".join(f"<a href='{r.choice(['https:', 'HTTP:', ''])}//{r.choice(hosts)}/p'>" for _ in range(r.randint(0, 3)))
        rows.append((i, f"https://{r.choice(hosts)}/{r.choice(['en', 'de', 'es', 'fr'])}/{r.randint(1, 99)}?a", html))
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    cols = ["page_id", "host", "path", "rule", "verdict"]
    want = sorted(tuple(None if x is None or x != x else x for x in t) for t in con.execute(urls.sql()).df()[cols].itertuples(index=False))
    got = sorted(tuple(x) for x in urls.url_filter(pages(spark, rows)).select(cols).collect())
    assert got == want and len({t[4] for t in got if t[3] is None}) == 2


def test_propagation_against_a_dense_walk(spark):
    r = random.Random(2)
    links = sorted({(f"h{r.randrange(12)}", f"h{r.randrange(12)}") for _ in range(40)})
    links = [(a, b, r.randint(1, 5)) for a, b in links if a != b]
    seeds = [("h1", 1.0, 0.0), ("h2", 0.0, 0.5), ("h3", 0.0, 1.0)]
    got = {x["host"]: (x["trust"], x["distrust"]) for x in urls.propagate(spark.createDataFrame(links, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, trusted double, blocked double"), rounds=10).collect()}
    names = [f"h{i}" for i in range(12)]
    for k in (0, 1):
        w = np.zeros((12, 12))
        for a, b, n in links:
            i, j = names.index(a), names.index(b)
            w[(i, j) if k == 0 else (j, i)] += n
        w = np.divide(w, w.sum(1, keepdims=True), out=np.zeros_like(w), where=w.sum(1, keepdims=True) > 0)
        s = np.zeros(12)
        for h, t, d in seeds:
            s[names.index(h)] = (t, d)[k] * 0.15
        x = s
        for _ in range(10):
            x = s + 0.85 * x @ w
        assert np.allclose(x, [got.get(h, (0, 0))[k] for h in names])


def brute(rows, k=5, every=50):
    v = [(i, tuple(int(np.floor(256 * float(x))) for x in e)) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for q in sorted({i for i, _ in v if i % every == 0}):
        s = sorted((-sum(x * y for x, y in zip(a, b)), i) for own, a in v if own == q for i, b in v if i != q)[:k]
        out += [(q, n + 1, i, -s0) for n, (s0, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("tree_rows", [8192, 37])
def test_top_k_is_exact(spark, tree_rows):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(300)]
    rows += [(400 + i, [0.5] * 6) for i in range(120)]  # ties, which the smaller ids win
    rows += [(100, None), (101, [None] + [0.1] * 5), (102, [float("nan")] + [0.1] * 5), (103, [float("inf")] * 6), (None, [0.1] * 6), (450, [0.5] * 6), (501, [9.0, 9.0])]
    df = spark.createDataFrame([(i, e, 1, "t") for i, e in rows], "vec_id long, embedding array<double>, label int, tree string")
    got = sorted(tuple(x) for x in mtree.exact_top_k(df, tree_rows=tree_rows, block_rows=3).collect())
    assert got == brute(rows)
    assert mtree.exact_top_k(df.limit(0)).count() == 0


def test_every_row_is_a_candidate(spark, tmp_path):
    """Repeated rows, different vectors under one vec_id, a repeated query; against brute force and the SQL."""
    rows = [(i, [float(i % 3), 1.0]) for i in (0, 1, 1, 2, 3, 3, 3, 50, 50, 51)] + [(3, [9.0, 9.0]), (100, [1.0, 2.0]), (100, [2.0, 1.0])] + [(7, [4.0, 4.0])] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    path = str(tmp_path / "embeddings")
    df.write.parquet(path)
    got = sorted(tuple(x) for x in mtree.exact_top_k(df, tree_rows=3, block_rows=2).collect())
    want = duckdb.sql(f"WITH embeddings AS (FROM '{path}/*.parquet'), " + mtree.SQL.strip().removeprefix("WITH ")).fetchall()
    assert got == brute(rows) == sorted(want)
    assert max(sum(g[0] == q for g in got) for q in (0, 50, 100)) == 5


def test_blocks_times_trees_are_not_broadcast(spark, monkeypatch):
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(mtree, "stage", lambda df, name, keep=mtree.stage: (plan(df), keep(df, name))[1])
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(200)]
    out = mtree.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tree_rows=20, block_rows=2)
    plan(out)
    assert not any("Broadcast" in p for p in plans) and any("CartesianProduct" in p for p in plans)
    assert sorted(tuple(x) for x in out.collect()) == brute(rows)


def test_top_k_of_few_and_of_large_numbers(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0]), (7, [3.0e9])], "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in mtree.exact_top_k(df).collect())
    assert got == [(0, 1, 7, 256 * 256 * 3 * 10**9), (0, 2, 50, 256 * 512), (50, 1, 7, 512 * 256 * 3 * 10**9), (50, 2, 0, 512 * 256)]


def test_m_tree_pages_hold_their_bounds():
    r = np.random.default_rng(1)
    t = mtree.MTree(np.arange(3000), r.integers(-99, 99, (3000, 8)))
    for p in t.pages:
        if p[0] == "node":
            for pivot, radius, child in zip(p[1], p[2], p[4], strict=True):
                page, rows, todo = None, [], [child]
                while todo:
                    page = t.pages[todo.pop()]
                    if page[0] == "leaf":
                        rows += page[2].tolist()
                    else:
                        todo += page[4].tolist()
                assert t._distance(np.array(rows), int(pivot)).max() <= radius + 1e-9


@pytest.mark.parametrize("k", [1, 2, 5, 16, 50])
def test_window_hashes_see_only_their_window(k):
    h = np.random.default_rng(k).integers(0, 2**63, 100).astype(np.uint64)
    assert windows_hash(h, k)[20] == windows_hash(np.r_[h[:7], h[20 : 20 + k], h[:3]], k)[7] and len(windows_hash(h, k)) == 101 - k

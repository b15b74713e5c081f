"""HR-shaped views over the driver's tables; each is a pair of Spark and DuckDB SQL over the same arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

#: ``//`` is integer division, ``{str}`` the string type; see ``text``.
VIEWS = {
    "org": "SELECT c_custkey AS employee_id, CASE WHEN c_custkey > 0 THEN (c_custkey - 1) // 8 END AS supervisor_id, c_mktsegment AS department, c_acctbal AS salary, c_custkey % 2 AS gender FROM customer",
    "org_str": "SELECT concat('E', lpad(CAST(employee_id AS {str}), 6, '0')) AS employee_id, CASE WHEN supervisor_id IS NULL THEN '' ELSE concat('E', lpad(CAST(supervisor_id AS {str}), 6, '0')) END AS supervisor_id FROM org",
    "org_bad": "SELECT c_custkey AS employee_id, CASE WHEN c_custkey = 0 THEN NULL WHEN c_custkey % 97 = 5 THEN 900000 + c_custkey WHEN c_custkey % 101 = 7 THEN c_custkey WHEN c_custkey = 20 THEN 21 WHEN c_custkey = 21 THEN 22 WHEN c_custkey = 22 THEN 20 WHEN c_custkey % 211 = 9 THEN NULL ELSE (c_custkey - 1) // 8 END AS supervisor_id FROM customer",
    "org_deep": "SELECT s_suppkey AS employee_id, CASE WHEN (s_suppkey - (SELECT min(s_suppkey) FROM supplier)) % 100 > 0 THEN s_suppkey - 1 END AS supervisor_id FROM supplier",
    "attendance": "SELECT user_id AS employee_id, ts, event_type, value FROM events",
    "comp_hist": "SELECT o_custkey AS employee_id, CAST(o_orderdate AS DATE) AS effective_date, o_totalprice AS salary, o_orderkey FROM orders",
    "edges_flow": "SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS weight FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "edges_sparse": "SELECT s_suppkey AS src, (7 * s_suppkey + 3) % (SELECT count(*) FROM supplier) AS dst FROM supplier UNION ALL SELECT s_suppkey, (49 * s_suppkey + 24) % (SELECT count(*) FROM supplier) FROM supplier",
    "org_edges": "SELECT employee_id AS src, supervisor_id AS dst FROM org WHERE supervisor_id IS NOT NULL",
    "outcome": "SELECT d.doc_id, d.n_chars, d.lang, l.quality, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
}


def text(name: str, engine: str) -> str:
    sql = VIEWS[name]
    return sql.replace("//", "div").format(str="STRING") if engine == "spark" else sql.format(str="VARCHAR")


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the views it needs in front, those they build on first."""
    need: list[str] = []

    def add(n: str) -> None:
        for other in VIEWS:
            if other != n and f"FROM {other}" in VIEWS[n] and other not in need:
                add(other)
        if n not in need:
            need.append(n)

    for n in names:
        add(n)
    head = ", ".join(f"{n} AS ({text(n, 'duckdb')})" for n in need)
    return f"WITH RECURSIVE {head}{', ' if sql.startswith('+') else ' '}{sql.lstrip('+')}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame; the driver's tables it reads are bound, not registered."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in _tables_of(name)}
    needs = [n for n in VIEWS if n != name and f"FROM {n}" in VIEWS[name]]
    frames |= {n: view(spark, sf_dir, n) for n in needs}
    sql = text(name, "spark")
    for t in frames:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **frames)


def _tables_of(name: str) -> set[str]:
    return set(re.findall(r"\b(?:FROM|JOIN) (\w+)", VIEWS[name])) & set(TABLES)

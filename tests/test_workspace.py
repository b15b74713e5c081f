from datetime import date, timedelta

import pandas as pd
import pytest

import orgweave
from orgweave.operators import cleaning, slices
from orgweave.sources import tables


@pytest.fixture(scope="module")
def ws(spark):
    w = orgweave.Workspace(spark)
    hris = [("E001", None, "Exec", 3), ("E010", "E001", "Eng", 2), ("E011", "E001", "Ops", 2), ("E100", "E010", "Eng", 1), ("E101", "E010", "Eng", 1), ("E102", "E011", "Ops", 1), ("E103", "E011", "Ops", 1)]
    w.load_hris(pd.DataFrame(hris, columns=["employee_id", "supervisor_id", "department", "job_level"]).assign(hire_date=pd.Timestamp("2020-01-01")))
    days = [(e, pd.Timestamp("2026-01-01") + pd.Timedelta(days=d), 1) for e in ("E100", "E101") for d in range(14)]
    w.load_attendance(pd.DataFrame(days, columns=["employee_id", "date", "present"]))
    return w


def test_from_edges_to_metrics(ws):
    edges = ws.build_org_edges()
    assert edges.count() == 6
    got = ws.join_hris(ws.pagerank(edges, "employee_id", "supervisor_id"))
    assert got.count() == 7 and "pagerank" in got.columns and got.orderBy(got.pagerank.desc()).first()["employee_id"] == "E001"
    assert ws.connected_components(edges, "employee_id", "supervisor_id").first()["size"] == 7
    assert ws.build_org_edges(active_as_of="2019-01-01").count() == 0
    assert ws.sql("select count(*) as n from hris").first()["n"] == 7 and ws.table("hris").count() == 7


def test_loaders(ws, spark):
    for name in ("compensation", "turnover", "survey", "retirement", "promotions", "skills"):
        assert getattr(ws, f"load_{name}")(spark.createDataFrame([("E1", 1)], "employee_id string, x int")).count() == 1
    with pytest.raises(ValueError):
        ws.load_hris(spark.createDataFrame([(1,)], "x int"))
    with pytest.raises(ValueError):
        ws.table("hris; drop")


def test_validate_keys(ws, spark):
    ws.validate_keys("hris")
    ws.validate_keys("attendance", date_col="date", date_lower="2026-01-01")
    with pytest.raises(ValueError, match="not loaded"):
        ws.validate_keys("nothing")
    with pytest.raises(ValueError, match="before"):
        ws.validate_keys("attendance", date_col="date", date_lower="2026-01-05")
    with pytest.raises(ValueError, match="bound"):
        ws.validate_keys("attendance", date_col="date", date_upper="soon")
    day = date(2026, 1, 1)
    cases = {"NULL": [(None, day)], "NULL or empty": [("", day)], "duplicate row": [("a", day)] * 2, "future": [("a", date.today() + timedelta(9))]}
    for says, rows in cases.items():
        ws.load(spark.createDataFrame(rows, "employee_id string, d date"), "broken")
        with pytest.raises(ValueError, match=says):
            ws.validate_keys("broken", date_col="d")
    with pytest.raises(ValueError, match="duplicate value"):
        ws.load(spark.createDataFrame([("a",), ("a",)], "employee_id string"), "broken")
        ws.validate_keys("broken")


def test_filter_noise(spark):
    df = spark.createDataFrame([("a", "2020-01-01"), ("a", "2020-01-02"), ("b", "2020-01-01"), ("t", "2020-01-01"), (None, "2020-01-01"), ("a", "never"), ("a", "2999-01-01"), ("a", None)], "employee_id string, d string")
    assert cleaning.filter_noise(df).count() == 7
    got = cleaning.filter_noise(df, date_col="d", test_ids=["t"], min_records=2)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "2020-01-01"), ("a", "2020-01-02")]


def test_deduplicate(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "employee_id string, n int")
    keep = lambda k: sorted(r["n"] for r in cleaning.deduplicate(df, keep=k, order_by="n").collect())
    assert (keep("first"), keep("last"), keep(False)) == ([1, 3, 5], [2, 4, 5], [5])
    with pytest.raises(ValueError):
        cleaning.deduplicate(df, keep="middle")


@pytest.mark.parametrize(("freq", "n", "label"), [("D", 14, "2026-01-01"), ("w", 3, "2026-W00"), ("M", 1, "2026-01"), ("Q", 1, "2026-Q1"), ("Y", 1, "2026")])
def test_slices_cover_every_row_once(ws, freq, n, label):
    got = ws.build_temporal_slices("attendance", "date", freq)
    assert len(got) == n and got[0][0] == label and sum(s[3].count() for s in got) == 28
    assert all(start <= end for _, start, end, _ in got)


def test_slices_refuse(ws, spark):
    with pytest.raises(ValueError):
        slices.temporal_slices(ws.table("attendance"), "date", "H")
    assert slices.temporal_slices(spark.createDataFrame([(None,)], "d date"), "d") == []


def test_tables(spark, tmp_path):
    tidy = spark.createDataFrame([("a", 1.0)], "term string, `p.value` double")
    name, _ = tables.tidy_to_table(tidy)
    assert spark.table(name).columns == ["term", "p_value"] and tidy.columns[1] == "p.value"
    out, _ = tables.to_table(pd.DataFrame({"x": [1, 2]}), "numbers", spark)
    assert out.count() == 2
    with pytest.raises(ValueError):
        tables.to_table(tidy, "a b")
    tables.write_csv(out, str(tmp_path / "c"))
    tables.write_parquet(out, str(tmp_path / "p"))
    assert tables.read_csv(spark, str(tmp_path / "c"), "x long").count() == tables.read_parquet(spark, str(tmp_path / "p")).count() == 2


def test_registered_queries_have_unique_sql_columns():
    from orgweave.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 45

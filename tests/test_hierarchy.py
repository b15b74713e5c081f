import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from orgweave.operators import hierarchy as H
from orgweave.operators.checks import check_key

SCHEMA = "employee_id string, supervisor_id string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect())


def test_long_has_every_ancestor_with_its_path(simple_org):
    out = H.hierarchy_long(simple_org, "employee_id", "supervisor_id")
    assert out.columns == ["employee_id", "supervisor_id", "depth", "path"]
    got = {(r[0], r[1]): (r[2], r[3]) for r in out.collect()}
    assert len(got) == 14
    assert got["E1000", "E001"] == (3, "E1000->E100->E010->E001")
    assert not any(e == "E001" for e, _ in got)


def test_long_cuts_at_max_depth(simple_org):
    assert max(r["depth"] for r in H.long(simple_org, "employee_id", "supervisor_id", max_depth=2).collect()) == 2


def test_stats(simple_org):
    got = {r["manager_id"]: r for r in H.hierarchy_stats(simple_org, "employee_id", "supervisor_id").collect()}
    r = got["E010"]
    assert (r["direct_reports"], r["indirect_reports"], r["total_reports"], r["team_size"], r["levels_below"]) == (2, 3, 5, 5, 2)
    assert got["E100"]["levels_below"] == 1 and "E1000" not in got


def test_wide_pads_and_leaves_roots_out(simple_org):
    out = H.hierarchy_wide(simple_org, "employee_id", "supervisor_id", max_depth=4)
    assert out.columns == ["employee_id", "Level_1", "Level_2", "Level_3", "Level_4"]
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    assert got["E1000"] == ("E100", "E010", "E001", None) and "E001" not in got
    assert "E001" in {r[0] for r in H.hierarchy_wide(simple_org, "employee_id", "supervisor_id", 2, include_roots=True).collect()}


def test_wide_names_and_limits(spark, simple_org):
    other = simple_org.toDF("emp no", "boss")
    assert H.wide(other, "emp no", "boss", 1, "Up").columns == ["emp no", "Up1"]
    for bad in (0, 101):
        with pytest.raises(ValueError, match="default"):
            H.hierarchy_wide(simple_org, "employee_id", "supervisor_id", bad)
    with pytest.raises(ValueError):
        H.hierarchy_wide(simple_org, "employee_id", "supervisor_id", 3, "a b")


def test_valid_finds_nothing_in_a_tree(simple_org):
    assert H.hierarchy_valid(simple_org, "employee_id", "supervisor_id").count() == 0


def test_valid_finds_each_issue(spark):
    org = spark.createDataFrame([("E001", None), ("E002", ""), ("E010", "E001"), ("E011", "E999"), ("E012", "E012")], SCHEMA)
    got = H.hierarchy_valid(org, "employee_id", "supervisor_id")
    kinds = {(r["issue_type"], r["employee_id"]) for r in got.collect()}
    assert kinds == {("self_reference", "E012"), ("broken_chain", "E011"), ("multiple_roots", None), ("loop", "E012")}
    assert "E999" in got.where("issue_type = 'broken_chain'").first()["detail"]


@pytest.mark.parametrize("n", [3, 4, 10])
def test_valid_loops_of_any_length(spark, n):
    org = spark.createDataFrame([(f"N{i}", f"N{(i - 1) % n}") for i in range(n)] + [("below", "N0")], SCHEMA)
    assert rows(H.valid(org, "employee_id", "supervisor_id").where("issue_type = 'loop'"), "employee_id") == sorted([(f"N{i}",) for i in range(n)] + [("below",)])


def test_numeric_keys_keep_their_type(spark):
    org = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2)], "employee_id int, supervisor_id int")
    assert rows(H.hierarchy_long(org, "employee_id", "supervisor_id"), "employee_id", "supervisor_id") == [(2, 1), (3, 1), (4, 1), (4, 2)]
    assert dict(H.hierarchy_wide(org, "employee_id", "supervisor_id", 2).dtypes)["Level_1"] == "int"
    assert H.hierarchy_valid(org, "employee_id", "supervisor_id").count() == 0


def test_empty_table(spark):
    org = spark.createDataFrame([], SCHEMA)
    for f in (H.hierarchy_valid, H.hierarchy_long, H.hierarchy_wide, H.hierarchy_stats):
        assert f(org, "employee_id", "supervisor_id").count() == 0


def test_keys_are_checked(spark, simple_org):
    with pytest.raises(TypeError):
        H.hierarchy_stats([1], "a", "b")
    with pytest.raises(ValueError, match="not found"):
        H.hierarchy_stats(simple_org, "employee_id", "nobody")
    with pytest.raises(ValueError, match="NULL"):
        check_key(spark.createDataFrame([(None, "a"), ("b", "a")], SCHEMA), "employee_id")
    with pytest.raises(ValueError, match="duplicate"):
        H.hierarchy_long(spark.createDataFrame([("a", None), ("a", None)], SCHEMA), "employee_id", "supervisor_id")


def test_hostile_column_name(spark):
    name = "sup`id; DROP TABLE x; --"
    org = spark.createDataFrame([("a", None), ("b", "a")], "employee_id string, s string").withColumnRenamed("s", name)
    assert H.hierarchy_stats(org, "employee_id", name).count() == 1


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-1, 8), min_size=1, max_size=9))
def test_closure_against_walks(spark, boss):
    org = spark.createDataFrame([(i, b if b >= 0 else None) for i, b in enumerate(boss)], "employee_id int, supervisor_id int")
    want = []
    for e in range(len(boss)):
        at, d = e, 0
        while 0 <= at < len(boss) and boss[at] >= 0 and d < 6:
            at, d = boss[at], d + 1
            want.append((e, at, d))
    assert rows(H.hierarchy_long(org, "employee_id", "supervisor_id", 6), "employee_id", "supervisor_id", "depth") == sorted(want)

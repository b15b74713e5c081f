import math

import numpy as np
import pandas as pd
import pytest

from orgweave.functions import special
from orgweave.operators import association, models, plots
from orgweave.operators.mrqap import matrix_of, mrqap


@pytest.fixture(scope="module")
def people():
    r = np.random.default_rng(20260620)
    n = 200
    base = {"Eng": 95000, "Ops": 78000, "Sales": 85000, "HR": 72000}
    team = np.clip(r.poisson(5, n), 0, 25)
    tenure = np.clip(r.gamma(2, 2, n), 0, 25)
    dept = r.choice(list(base), n, p=[0.5, 0.2, 0.2, 0.1])
    salary = np.round([base[d] for d in dept] + 2500 * team + 800 * tenure + r.normal(0, 12000, n))
    leave = (r.random(n) < 1 / (1 + np.exp(2 + 3e-5 * (salary - 80000) + 0.3 * tenure - 0.05 * team))).astype(int)
    return pd.DataFrame({"team": team, "tenure": tenure, "salary": salary, "department": dept, "gender": r.choice(["M", "F"], n, p=[0.55, 0.45]), "attrition": leave})


@pytest.fixture(scope="module")
def df(spark, people):
    return spark.createDataFrame(people)


def frame(d):
    return d.toPandas().set_index("term")


def numpy_ols(people, cols, y="salary"):
    x = np.column_stack([np.ones(len(people)), people[cols].to_numpy(float)])
    b = np.linalg.solve(x.T @ x, x.T @ people[y])
    return x, b, people[y].to_numpy() - x @ b


def test_tails_against_the_jvm(spark):
    d = spark._jvm.org.apache.commons.math3.distribution
    for df, x in ((3, 0.4), (17, 2.2), (200, 5.0)):
        assert special.t_two_sided(x, df) == pytest.approx(2 * (1 - d.TDistribution(float(df)).cumulativeProbability(x)), rel=1e-8, abs=1e-12)
        assert special.chi2_sf(x * 3, df) == pytest.approx(1 - d.ChiSquaredDistribution(float(df)).cumulativeProbability(x * 3), rel=1e-8, abs=1e-12)
        assert special.f_sf(x, 4, df) == pytest.approx(1 - d.FDistribution(4.0, float(df)).cumulativeProbability(x), rel=1e-8, abs=1e-12)
        assert special.t_critical(0.05, df) == pytest.approx(d.TDistribution(float(df)).inverseCumulativeProbability(0.975), rel=1e-8)
    assert special.normal_critical(0.05) == pytest.approx(1.959963984540054)


def test_ols_against_numpy(df, people):
    tidy, glance = models.ols(df, "salary ~ team + tenure")
    x, b, e = numpy_ols(people, ["team", "tenure"])
    t, g = frame(tidy), glance.first()
    dof = len(people) - 3
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (e @ e) / dof)
    assert t["estimate"].to_numpy() == pytest.approx(b)
    assert t["std.error"].to_numpy() == pytest.approx(se)
    assert list(t.columns) == ["estimate", "std.error", "statistic", "p.value", "conf.low", "conf.high"]
    assert g["rsquared"] == pytest.approx(1 - e @ e / ((people.salary - people.salary.mean()) ** 2).sum())
    assert g["aic"] == pytest.approx(-2 * g["llf"] + 6) and g["nobs"] == 200
    assert t.loc["team", "p.value"] < 0.001


@pytest.mark.parametrize("kind", ["HC0", "HC1", "HC3", "cluster"])
def test_robust_covariances(df, people, kind):
    t = frame(models.ols(df, "salary ~ team", cov_type=kind, groups="department" if kind == "cluster" else None)[0])
    x, b, e = numpy_ols(people, ["team"])
    inv = np.linalg.inv(x.T @ x)
    n, k = x.shape
    if kind == "cluster":
        s = np.array([x[people.department == g].T @ e[people.department == g] for g in people.department.unique()])
        meat = s.T @ s * len(s) / (len(s) - 1) * (n - 1) / (n - k)
    else:
        h = np.einsum("ij,jk,ik->i", x, inv, x)
        w = e**2 / (1 - h) ** 2 if kind == "HC3" else e**2
        meat = (x.T * w) @ x * (n / (n - k) if kind == "HC1" else 1)
    assert t["std.error"].to_numpy() == pytest.approx(np.sqrt(np.diag(inv @ meat @ inv)))


def test_categories_interactions_and_no_intercept(df, people):
    t = frame(models.ols(df, "salary ~ team + C(department)")[0])
    assert list(t.index) == ["Intercept", "team", "C(department)[T.HR]", "C(department)[T.Ops]", "C(department)[T.Sales]"]
    assert {"team:tenure"} < set(frame(models.ols(df, "salary ~ team * tenure")[0]).index)
    none = frame(models.ols(df, "salary ~ department - 1")[0])
    assert none.loc["department[Eng]", "estimate"] == pytest.approx(people[people.department == "Eng"].salary.mean())
    with pytest.raises(ValueError):
        models.ols(df, "salary ~ nobody")
    with pytest.raises(ValueError):
        models.ols(df, "salary team")


def test_logistic_against_numpy(df, people):
    tidy, glance = models.logistic(df, "attrition ~ salary + tenure + team")
    z = people[["salary", "tenure", "team"]]
    x = np.column_stack([np.ones(200), ((z - z.mean()) / z.std()).to_numpy()])
    b = np.zeros(4)
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x.T * (p * (1 - p))) @ x, x.T @ (people.attrition - p))
    t, g = frame(tidy), glance.first()
    assert t["estimate"].to_numpy()[1:] == pytest.approx(b[1:] / z.std().to_numpy(), rel=1e-5)
    assert g["deviance"] == pytest.approx(-2 * g["llf"]) and 0 < g["pseudo_rsquared"] < 1
    with pytest.raises(ValueError):
        models.logistic(df, "team ~ salary")


def test_anova(df, people):
    t = frame(models.anova(df, "salary ~ department"))
    groups = [g.salary for _, g in people.groupby("department")]
    ss = sum(len(g) * (g.mean() - people.salary.mean()) ** 2 for g in groups)
    assert t.loc["department", "sum_sq"] == pytest.approx(ss) and t.loc["department", "df"] == 3 and t.loc["department", "p.value"] < 0.01
    one = frame(models.anova(df, "salary ~ team + department", anova_type=1))
    assert one["sum_sq"].sum() == pytest.approx(((people.salary - people.salary.mean()) ** 2).sum())
    assert frame(models.anova(df, "salary ~ team + department", anova_type=3)).index[0] == "Intercept"
    with pytest.raises(ValueError):
        models.anova(df, "salary ~ team", anova_type=4)


def test_vif_and_compare(df, people):
    r = people.team.corr(people.tenure)
    assert models.vif(df, "salary ~ team + tenure").to_numpy() == pytest.approx([1 / (1 - r * r)] * 2)
    out = models.model_compare({"a": models.ols(df, "salary ~ team"), "b": models.fit_ols(df, "salary ~ team + tenure")})
    assert out.columns[:5] == ["model", "aic", "bic", "llf", "nobs"] and out.count() == 2


def test_augment(df):
    fit = models.fit_ols(df, "salary ~ team")
    assert models.augment(df, fit).selectExpr("sum(`.resid`) as s").first()["s"] == pytest.approx(0, abs=1e-4)


def test_correlation(df, people):
    got = {(r[0], r[1]): r for r in association.correlation(df, ["team", "tenure", "salary"]).collect()}
    assert len(got) == 3 and got["team", "salary"]["correlation"] == pytest.approx(people.team.corr(people.salary))
    s = association.correlation(df, col1="team", col2="salary", method="spearman").first()["correlation"]
    assert s == pytest.approx(people.team.rank().corr(people.salary.rank()))
    k = association.correlation(df, col1="team", col2="salary", method="kendall").first()
    a, b = people.team.to_numpy(), people.salary.to_numpy()
    x, y = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
    assert k["correlation"] == pytest.approx((x * y).sum() / math.sqrt((x * x).sum() * (y * y).sum())) and k["p.value"] < 0.001
    for bad in ({}, {"columns": ["team"], "col1": "team", "col2": "salary"}):
        with pytest.raises(ValueError):
            association.correlation(df, **bad)


def test_chi_square(df, people):
    table, _ = association.chi_square(df, "department", "gender")
    o = pd.crosstab(people.department, people.gender).to_numpy()
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    r = table.first()
    assert (r["chi2"], r["dof"]) == (pytest.approx(((o - e) ** 2 / e).sum()), 3) and r["p_value"] == pytest.approx(special.chi2_sf(r["chi2"], 3))


def test_plot_data(df):
    (label, facts, line), = plots.ols_data(df, ["team"], "salary")
    assert label == "salary ~ team" and facts["slope"] > 1000 and (line["low"] < line["fit"]).all()
    assert plots.residual_data(df, ["team"], "salary")[0][1].count() == 200
    assert len(plots.coefficient_data(models.ols(df, "salary ~ team")[0])) == 2


def test_mrqap_local_and_spread(spark):
    r = np.random.default_rng(1)
    y, x = r.random((12, 12)), [r.random((12, 12)) for _ in range(2)]
    a, b = mrqap(y, x, 100), mrqap(y, x, 100, spark=spark)
    assert a["p_values"] == b["p_values"] and np.allclose(a["permutation_betas"], b["permutation_betas"]) and all(0 <= p <= 1 for p in a["p_values"])
    strong = mrqap(2 * x[0] + 0.01 * y, x, 200)
    assert strong["r2"] > 0.99 and strong["p_values"][1] == 0.0
    with pytest.raises(ValueError):
        mrqap(y, [np.zeros((3, 3))])
    with pytest.raises(ValueError):
        mrqap(y, [])
    cells = spark.createDataFrame([(0, 1, 2.0), (2, 0, 3.0)], "i int, j int, v double")
    assert matrix_of(cells).tolist() == [[0, 2, 0], [0, 0, 0], [3, 0, 0]]

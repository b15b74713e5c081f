"""Formulas and models: OLS, logistic regression, ANOVA, VIF.

A formula becomes column expressions; one aggregation gives the centred and scaled Gram
matrix (k x k, whatever the rows), which is solved on the driver.  Robust covariances
and each Newton step of the logistic fit are one more aggregation each.
"""

from __future__ import annotations

import itertools
import math
import re
import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from ..functions.ident import column, require_columns
from ..functions.special import chi2_sf, f_sf, normal_critical, normal_two_sided, t_critical, t_two_sided

TIDY = "term string, estimate double, `std.error` double, statistic double, `p.value` double, `conf.low` double, `conf.high` double"
#: Levels of a categorical predictor; each is a column of the Gram matrix.
MAX_LEVELS = 500


@dataclass
class Design:
    """Rows without nulls, the outcome, and each term's columns ``(name, expression)``; the first term is the intercept."""

    rows: DataFrame
    y: Column
    terms: list[tuple[str, list[tuple[str, Column]]]] = field(default_factory=list)

    @property
    def columns(self) -> list[tuple[str, Column]]:
        return [c for _, cols in self.terms for c in cols]

    @property
    def spans(self) -> list[tuple[str, list[int]]]:
        out, at = [], 0
        for name, cols in self.terms:
            out.append((name, list(range(at, at + len(cols)))))
            at += len(cols)
        return out


def _split(text: str, sep: str) -> list[str]:
    """Split at ``sep`` outside parentheses."""
    parts, depth = [""], 0
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == sep and not depth:
            parts.append("")
        else:
            parts[-1] += ch
    return [p.strip() for p in parts]


def parse_formula(formula: str) -> tuple[str, list[tuple[str, ...]], bool]:
    """``y ~ a + C(b) + a:b + a*b - 1``: the outcome, the terms as tuples of factors, and whether there is an intercept."""
    if formula.count("~") != 1:
        raise ValueError(f"a formula needs one '~': {formula!r}")
    left, right = (x.strip() for x in formula.split("~"))
    intercept, terms = True, []
    for part in _split(re.sub(r"-\s*1\b", "+ 0", right), "+"):
        if part in ("0", "1", ""):
            intercept = intercept and part != "0"
            continue
        factors = _split(part, "*")
        for k in range(1, len(factors) + 1):
            for combo in itertools.combinations(factors, k):
                term = tuple(f for c in combo for f in _split(c, ":"))
                if term not in terms:
                    terms.append(term)
    terms.sort(key=len)
    return left, terms, intercept


def design(df: DataFrame, formula: str) -> Design:
    outcome, terms, intercept = parse_formula(formula)
    base = lambda f: m[1].strip() if (m := re.fullmatch(r"C\((.*)\)", f)) else f
    used = list(dict.fromkeys([outcome, *(base(f) for t in terms for f in t)]))
    require_columns(df, used)
    rows = df.select(*(column(df, c) for c in used)).dropna()
    kinds = {f.name: f.dataType for f in rows.schema}
    if not isinstance(kinds[outcome], (NumericType, BooleanType)):
        raise ValueError(f"the outcome {outcome!r} is not numeric")
    factors = {f for t in terms for f in t}
    coded = {f for f in factors if f.startswith("C(") or isinstance(kinds[base(f)], StringType)}
    levels: dict[str, list] = {}
    for f in sorted(coded):
        found = [r[0] for r in rows.select(column(rows, base(f))).distinct().limit(MAX_LEVELS + 1).collect()]
        if len(found) > MAX_LEVELS:
            raise ValueError(f"{f!r} has more than {MAX_LEVELS} levels")
        levels[f] = sorted(found)
    num = lambda c: column(rows, c).cast("double")

    def parts(f: str, full: bool) -> list[tuple[str, Column]]:
        if f not in coded:
            return [(f, num(f))]
        shown = levels[f] if full else levels[f][1:]
        return [(f"{f}[{'' if full else 'T.'}{v}]", F.when(column(rows, base(f)) == F.lit(v), 1.0).otherwise(0.0)) for v in shown]

    out = Design(rows, num(outcome))
    if intercept:
        out.terms.append(("Intercept", [("Intercept", F.lit(1.0))]))
    whole = intercept
    for t in terms:
        cols: list[tuple[str, Column]] = []
        for k, f in enumerate(t):
            full = not whole and f in coded and len(t) == 1
            whole = whole or full
            p = parts(f, full)
            cols = p if not k else [(f"{a}:{b}", x * y) for a, x in cols for b, y in p]
        out.terms.append((":".join(t), cols))
    return out


@dataclass
class Gram:
    n: int
    xx: np.ndarray
    xy: np.ndarray
    yy: float
    y_mean: float
    x_mean: np.ndarray
    scale: np.ndarray


def gram(d: Design) -> Gram:
    """Products of scaled columns about their means, moved back to the origin in double precision on the driver.

    Centring first keeps a salary and a rank of one model from cancelling each other's digits.
    """
    cols = [c for _, c in d.columns]
    k = len(cols)
    head = d.rows.agg(F.count("*").alias("n"), F.avg(d.y).alias("y"), *(x for i, c in enumerate(cols) for x in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")))).first()
    n = head["n"]
    if not n:
        raise ValueError("no complete rows to fit")
    const = [(head[f"s{i}"] or 0.0) <= 1e-14 * abs(head[f"m{i}"] or 0.0) for i in range(k)]
    mean = np.array([0.0 if const[i] else head[f"m{i}"] for i in range(k)])
    scale = np.array([(abs(head[f"m{i}"]) or 1.0) if const[i] else head[f"s{i}"] for i in range(k)])
    z = [(c - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(cols, mean, scale, strict=True)]
    v = d.y - F.lit(float(head["y"]))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = d.rows.select(*(c.alias(f"z{i}") for i, c in enumerate(z)), v.alias("v")).agg(
        *(F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs), *(F.sum(F.col(f"z{i}") * F.col("v")) for i in range(k)), F.sum(F.col("v") * F.col("v"))
    ).first()
    xx = np.zeros((k, k))
    for (i, j), x in zip(pairs, row, strict=False):
        xx[i, j] = xx[j, i] = x
    return Gram(n, xx, np.array(row[len(pairs) : len(pairs) + k]), row[-1], head["y"], mean, scale)


def _solve(xx: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Coefficients, inverse and rank."""
    inverse = np.linalg.pinv(xx, rcond=1e-12, hermitian=True)
    return inverse @ xy, inverse, int(np.linalg.matrix_rank(xx, tol=1e-10 * max(np.abs(xx).max(), 1e-300), hermitian=True))


def _rss(g: Gram, keep: list[int], intercept: bool) -> tuple[float, int]:
    if not keep:
        return (g.yy + (0 if intercept else g.n * g.y_mean**2)), 0
    xx, xy = g.xx[np.ix_(keep, keep)], g.xy[keep]
    beta, _, rank = _solve(xx, xy)
    return max(g.yy - xy @ beta, 0.0), rank


class Fit:
    """Coefficients in original units, their covariance, and what summaries need."""

    def __init__(self, d: Design, names: list[str], beta: np.ndarray, cov: np.ndarray, df: float, use_t: bool, glance: dict, alpha: float):
        self.design, self.names, self.beta, self.cov, self.df, self.use_t, self.stats, self.alpha = d, names, beta, cov, df, use_t, glance, alpha

    def tidy_rows(self) -> list[tuple]:
        se = np.sqrt(np.maximum(np.diag(self.cov), 0))
        crit = t_critical(self.alpha, self.df) if self.use_t else normal_critical(self.alpha)
        rows = []
        for name, b, s in zip(self.names, self.beta, se, strict=True):
            stat = b / s if s > 0 else math.nan
            p = t_two_sided(stat, self.df) if self.use_t else normal_two_sided(stat)
            rows.append((name, float(b), float(s), float(stat), float(p), float(b - crit * s), float(b + crit * s)))
        return rows

    def frames(self) -> tuple[DataFrame, DataFrame]:
        spark = self.design.rows.sparkSession
        return spark.createDataFrame(self.tidy_rows(), TIDY), spark.createDataFrame([tuple(self.stats.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'double'}" for k, v in self.stats.items()))

    def linear(self) -> Column:
        return sum((F.lit(float(b)) * c for b, (_, c) in zip(self.beta, self.design.columns, strict=True)), F.lit(0.0))


def _originals(g: Gram, names: list[str]) -> np.ndarray:
    """The matrix that turns coefficients of scaled, centred columns to those of the originals."""
    t = np.diag(1 / g.scale)
    if "Intercept" in names:
        i = names.index("Intercept")
        t[i, :] -= g.x_mean / g.scale
        t[i, i] = 1 / g.scale[i]
    return t


def _weighted(d: Design, cols: list[Column], weight: Column, extra: list[Column] = ()) -> tuple[np.ndarray, list]:
    """Sum of ``weight * x x'`` and of the extra columns."""
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    base = d.rows.select(*(c.alias(f"z{i}") for i, c in enumerate(cols)), weight.alias("w"), *(c.alias(f"e{i}") for i, c in enumerate(extra)))
    row = base.agg(*(F.sum(F.col("w") * F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs), *(F.sum(f"e{i}") for i in range(len(extra)))).first()
    m = np.zeros((k, k))
    for (i, j), x in zip(pairs, row, strict=False):
        m[i, j] = m[j, i] = x
    return m, list(row[len(pairs) :])


def fit_ols(df: DataFrame, formula: str, cov_type: str = "nonrobust", alpha: float = 0.05, groups: str | None = None) -> Fit:
    if cov_type not in ("nonrobust", "HC0", "HC1", "HC2", "HC3", "cluster"):
        raise ValueError(f"unknown cov_type {cov_type!r}")
    if cov_type == "cluster":
        if groups is None:
            raise ValueError("cov_type='cluster' needs groups, a column of cluster names")
        require_columns(df, [groups])
        df = df.where(column(df, groups).isNotNull())
    d = design(df, formula)
    names = [n for n, _ in d.columns]
    intercept = "Intercept" in names
    g = gram(d) if intercept else _raw_gram(d)
    b, inverse, rank = _solve(g.xx, g.xy)
    if intercept:
        b[names.index("Intercept")] += g.y_mean  # the outcome was centred, the intercept's column is 1
    rss = max(g.yy - g.xy @ inverse @ g.xy, 0.0)
    n, dof = g.n, g.n - rank
    t = _originals(g, names)
    beta = t @ b
    sigma2 = rss / dof if dof > 0 else math.nan
    tss = g.yy
    model_df = rank - intercept
    if cov_type == "nonrobust":
        cov = sigma2 * t @ inverse @ t.T
    else:
        z = [(c - F.lit(float(m))) / F.lit(float(s)) for (_, c), m, s in zip(d.columns, g.x_mean, g.scale, strict=True)]
        e = d.y - sum((F.lit(float(x)) * c for x, c in zip(b, z, strict=True)), F.lit(0.0))
        if cov_type == "cluster":
            with_group = design_rows(df, d, groups)
            score = with_group.select(F.col("_g"), *((e * c).alias(f"s{i}") for i, c in enumerate(z))).groupBy("_g").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(z))))
            k = len(z)
            pairs = [(i, j) for i in range(k) for j in range(i, k)]
            row = score.agg(F.count("*"), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i, j in pairs)).first()
            meat = np.zeros((k, k))
            for (i, j), x in zip(pairs, row[1:], strict=True):
                meat[i, j] = meat[j, i] = x
            count = row[0]
            meat *= count / (count - 1) * (n - 1) / dof
        else:
            w = e * e
            if cov_type in ("HC2", "HC3"):
                h = sum((F.lit(float(inverse[i, j])) * z[i] * z[j] for i in range(len(z)) for j in range(len(z))), F.lit(0.0))
                w = w / F.pow(1 - h, 1 if cov_type == "HC2" else 2)
            meat, _ = _weighted(d, z, w)
            if cov_type == "HC1":
                meat *= n / dof
        cov = t @ (inverse @ meat @ inverse) @ t.T
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(max(rss, 1e-300) / n) + 1)
    r2 = 1 - rss / tss if tss > 0 else math.nan
    f_stat = (tss - rss) / model_df / sigma2 if model_df > 0 and sigma2 > 0 else math.nan
    glance = {
        "rsquared": r2, "rsquared_adj": 1 - (1 - r2) * (n - intercept) / dof if dof > 0 else math.nan, "f_statistic": f_stat, "f_pvalue": f_sf(f_stat, model_df, dof),
        "llf": llf, "aic": -2 * llf + 2 * rank, "bic": -2 * llf + rank * math.log(n), "nobs": int(n), "df_model": float(model_df), "df_resid": float(dof),
    }
    glance = {k: float(v) if k != "nobs" else v for k, v in glance.items()}
    return Fit(d, names, beta, cov, dof, cov_type == "nonrobust", glance, alpha)


def design_rows(df: DataFrame, d: Design, groups: str) -> DataFrame:
    """The model's rows with their cluster, under the same column names."""
    names = d.rows.columns
    return df.select(*(column(df, c) for c in names), column(df, groups).alias("_g")).dropna(subset=names)


def _raw_gram(d: Design) -> Gram:
    """Without an intercept: plain sums about zero."""
    k = len(d.columns)
    xx, rest = _weighted(d, [c for _, c in d.columns], F.lit(1.0), [c * d.y for _, c in d.columns] + [d.y * d.y, F.lit(1)])
    return Gram(int(rest[k + 1]), xx, np.array(rest[:k]), rest[k], 0.0, np.zeros(k), np.ones(k))


def fit_logistic(df: DataFrame, formula: str, alpha: float = 0.05, max_iter: int = 35, tol: float = 1e-10) -> Fit:
    d = design(df, formula)
    names = [n for n, _ in d.columns]
    g = gram(d) if "Intercept" in names else _raw_gram(d)
    low, high, ones = d.rows.agg(F.min(d.y), F.max(d.y), F.count_if((d.y != 0) & (d.y != 1))).first()
    if ones:
        raise ValueError("the outcome must be 0 or 1")
    z = [(c - F.lit(float(m))) / F.lit(float(s)) for (_, c), m, s in zip(d.columns, g.x_mean, g.scale, strict=True)]
    k, n = len(z), g.n

    def at(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        eta = sum((F.lit(float(x)) * c for x, c in zip(b, z, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-eta))
        ll = d.y * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta)))
        hess, rest = _weighted(d, z, p * (1 - p), [*((d.y - p) * c for c in z), ll])
        return hess, np.array(rest[:k]), rest[k]

    b = np.zeros(k)
    hess, grad, ll = at(b)
    for _ in range(max_iter):
        step, _, _ = _solve(hess, grad)
        size = 1.0
        while True:
            nh, ng, nl = at(b + size * step)
            if nl >= ll - 1e-9 * abs(ll) or size < 1e-4:
                break
            size /= 2
        b, change = b + size * step, abs(nl - ll)
        hess, grad, ll = nh, ng, nl
        if change < tol * (abs(ll) + 1):
            break
    else:
        warnings.warn("the logistic fit did not converge; outcomes may be separated", stacklevel=2)
    _, inverse, rank = _solve(hess, grad)
    t = _originals(g, names)
    mean = g.y_mean if "Intercept" in names else d.rows.agg(F.avg(d.y)).first()[0]
    null = n * (mean * math.log(mean) + (1 - mean) * math.log(1 - mean)) if 0 < mean < 1 else 0.0
    glance = {
        "pseudo_rsquared": 1 - ll / null if null else math.nan, "llf": ll, "llnull": null, "llr_pvalue": chi2_sf(2 * (ll - null), rank - 1), "aic": -2 * ll + 2 * rank,
        "bic": -2 * ll + rank * math.log(n), "deviance": -2 * ll, "null_deviance": -2 * null, "nobs": int(n), "df_model": float(rank - 1), "df_resid": float(n - rank),
    }
    glance = {x: float(v) if x != "nobs" else v for x, v in glance.items()}
    return Fit(d, names, t @ b, t @ inverse @ t.T, math.inf, False, glance, alpha)


def ols(df: DataFrame, formula: str, *, cov_type: str = "nonrobust", alpha: float = 0.05, groups: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(tidy, glance)`` of a least-squares fit; t statistics, or z with a robust or cluster covariance."""
    return fit_ols(df, formula, cov_type, alpha, groups).frames()


def logistic(df: DataFrame, formula: str, *, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """``(tidy, glance)`` of a logistic fit in log-odds."""
    return fit_logistic(df, formula, alpha).frames()


def augment(df: DataFrame, fit: Fit) -> DataFrame:
    """``df``'s rows that the model used, with ``.fitted`` and ``.resid``; other columns stay."""
    names = fit.design.rows.columns
    fitted = fit.linear() if fit.use_t or math.isfinite(fit.df) else 1 / (1 + F.exp(-fit.linear()))
    rows = df.dropna(subset=names)
    return rows.select("*", fitted.alias(".fitted"), (fit.design.y - fitted).alias(".resid"))


def anova(df: DataFrame, formula: str, *, anova_type: int = 2) -> DataFrame:
    """``(term, sum_sq, df, statistic, p.value)`` of each term and the residual, from sub-models of one Gram matrix."""
    if anova_type not in (1, 2, 3):
        raise ValueError("anova_type must be 1, 2 or 3")
    d = design(df, formula)
    names = [n for n, _ in d.columns]
    intercept = "Intercept" in names
    g = gram(d) if intercept else _raw_gram(d)
    if intercept and anova_type == 3:  # a test of the intercept needs sums about zero
        g = _raw_gram(d)
    spans = d.spans
    everything = [i for _, s in spans for i in s]
    rss, rank = _rss(g, everything, intercept)
    dof = g.n - rank
    rows, before = [], [i for t, s in spans if t == "Intercept" for i in s]
    for term, span in spans:
        if term == "Intercept" and anova_type != 3:
            continue
        if anova_type == 1:
            small, big = list(before), before + span
            before = big
        elif anova_type == 2:
            own = set(term.split(":"))
            others = [i for t, s in spans if t != term and not (own < set(t.split(":"))) for i in s]
            small, big = others, others + span
        else:
            small, big = [i for i in everything if i not in span], everything
        (r0, k0), (r1, k1) = _rss(g, small, intercept), _rss(g, big, intercept)
        ss, k = r0 - r1, k1 - k0
        f = ss / k / (rss / dof) if k > 0 and dof > 0 and rss > 0 else math.nan
        rows.append((term, float(ss), float(k), float(f), float(f_sf(f, k, dof))))
    rows.append(("Residual", float(rss), float(dof), None, None))
    return df.sparkSession.createDataFrame(rows, "term string, sum_sq double, df double, statistic double, `p.value` double")


def vif(df: DataFrame, formula: str) -> pd.Series:
    """Variance inflation factor of each predictor: the diagonal of the inverse correlation matrix."""
    d = design(df, formula)
    names = [n for n, _ in d.columns]
    g = gram(d)
    keep = [i for i, n in enumerate(names) if n != "Intercept"]
    c = g.xx[np.ix_(keep, keep)]
    s = np.sqrt(np.diag(c))
    c = c / np.outer(s, s)
    return pd.Series(np.diag(np.linalg.pinv(c, hermitian=True)), index=[names[i] for i in keep], name="vif")


def model_compare(models: dict[str, tuple[DataFrame, DataFrame] | Fit], spark: SparkSession | None = None) -> DataFrame:
    """``(model, aic, bic, llf, nobs, ...)``: one row a model, in the order given."""
    rows = [{"model": k} | (m.stats if isinstance(m, Fit) else (m[1] if isinstance(m, tuple) else m).first().asDict()) for k, m in models.items()]
    first = ["model", "aic", "bic", "llf", "nobs"]
    names = first + [c for c in dict.fromkeys(c for r in rows for c in r) if c not in first]
    frame = next((m.design.rows if isinstance(m, Fit) else m[1] if isinstance(m, tuple) else m for m in models.values()), None)
    spark = spark or (frame.sparkSession if frame is not None else SparkSession.getActiveSession())
    kind = lambda c: "string" if c == "model" else "long" if c == "nobs" else "double"
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], ", ".join(f"{c} {kind(c)}" for c in names))

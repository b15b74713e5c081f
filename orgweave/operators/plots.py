"""Data for plots as DataFrames or small frames, and figures where matplotlib is installed."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ident import column
from ..functions.special import t_critical
from .models import fit_ols

#: Points drawn; the lines are fitted on all rows.
POINTS = 5000


def _pyplot():
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError:
        return None
    return plt


def _needs() -> object:
    plt = _pyplot()
    if plt is None:
        raise ImportError("figures need matplotlib; the *_data functions give the same as tables")
    return plt


def points(df: DataFrame, x: str, y: str) -> pd.DataFrame:
    """At most about ``POINTS`` rows of two columns, for drawing."""
    two = df.select(column(df, x).cast("double").alias("x"), column(df, y).cast("double").alias("y")).dropna()
    n = two.count()
    return (two if n <= POINTS else two.sample(POINTS / n, seed=1)).toPandas()


def ols_data(df: DataFrame, x: Sequence[str], y: str, steps: int = 50, alpha: float = 0.05) -> list[tuple[str, dict, pd.DataFrame]]:
    """``(label, {slope, rsquared, p}, line (x, fit, low, high))`` of y on each predictor alone."""
    out = []
    for name in x:
        fit = fit_ols(df, f"{y} ~ {name}")
        low, high = fit.design.rows.agg(F.min(name), F.max(name)).first()
        at = np.linspace(float(low), float(high), steps)
        basis = np.column_stack([np.ones(steps), at])
        mid = basis @ fit.beta
        half = t_critical(alpha, fit.df) * np.sqrt(np.einsum("ij,jk,ik->i", basis, fit.cov, basis))
        out.append((f"{y} ~ {name}", {"slope": float(fit.beta[1]), "rsquared": fit.stats["rsquared"], "p": fit.tidy_rows()[1][4]}, pd.DataFrame({"x": at, "fit": mid, "low": mid - half, "high": mid + half})))
    return out


def residual_data(df: DataFrame, x: Sequence[str], y: str) -> list[tuple[str, DataFrame]]:
    """``(label, (x, residual))`` of y on each predictor alone."""
    out = []
    for name in x:
        fit = fit_ols(df, f"{y} ~ {name}")
        out.append((f"{y} ~ {name}", fit.design.rows.select(F.col(f"`{name}`").cast("double").alias("x"), (fit.design.y - fit.linear()).alias("residual"))))
    return out


def coefficient_data(tidy: DataFrame, sort: bool = True) -> pd.DataFrame:
    """Terms with their intervals, for a forest plot."""
    pdf = tidy.select("term", "estimate", "`conf.low`", "`conf.high`").toPandas()
    return pdf.sort_values("estimate", kind="stable").reset_index(drop=True) if sort else pdf


def plot_ols(df: DataFrame, x: Sequence[str], y: str) -> list[tuple[str, object]]:
    plt, out = _needs(), []
    for name, (label, facts, line) in zip(x, ols_data(df, x, y), strict=True):
        fig, ax = plt.subplots()
        dots = points(df, name, y)
        ax.scatter(dots["x"], dots["y"], s=8, alpha=0.5)
        ax.plot(line["x"], line["fit"])
        ax.fill_between(line["x"], line["low"], line["high"], alpha=0.2)
        ax.set(xlabel=name, ylabel=y, title=f"slope {facts['slope']:.4g}, R2 {facts['rsquared']:.3f}, p {facts['p']:.3g}")
        out.append((label, fig))
    return out


def plot_residuals(df: DataFrame, x: Sequence[str] | str, y: str) -> list[tuple[str, object]]:
    plt, out = _needs(), []
    for label, rows in residual_data(df, [x] if isinstance(x, str) else x, y):
        fig, ax = plt.subplots()
        dots = points(rows, "x", "residual")
        ax.scatter(dots["x"], dots["y"], s=8, alpha=0.5)
        ax.axhline(0, lw=1)
        ax.set(title=label, ylabel="residual")
        out.append((label, fig))
    return out


def plot_coefficients(tidy: DataFrame, *, reference_line: float = 0.0, sort: bool = True) -> tuple[object, object]:
    plt, pdf = _needs(), coefficient_data(tidy, sort)
    fig, ax = plt.subplots()
    at = np.arange(len(pdf))
    ax.errorbar(pdf["estimate"], at, xerr=[pdf["estimate"] - pdf["conf.low"], pdf["conf.high"] - pdf["estimate"]], fmt="o")
    ax.axvline(reference_line, ls="--", lw=1)
    ax.set(yticks=at, yticklabels=pdf["term"])
    return fig, ax


def bars(grid: DataFrame, x: str, y: str) -> object | None:
    """Shares of y within x, or None without matplotlib."""
    plt = _pyplot()
    if plt is None:
        return None
    pdf = grid.toPandas().pivot(index="x", columns="y", values="observed").sort_index()
    fig, ax = plt.subplots()
    pdf.div(pdf.sum(axis=1), axis=0).plot.bar(stacked=True, ax=ax, xlabel=x, ylabel=f"share of {y}")
    return fig


def save_figure(fig: object, path: str, *, dpi: int = 120) -> str:
    """Save a figure, making its folder."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    fig.savefig(path, dpi=dpi, bbox_inches="tight")
    return path

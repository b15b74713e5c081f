"""Correlation and chi-square."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ident import column, require_columns
from ..functions.special import chi2_sf, normal_two_sided, t_two_sided
from .staging import stage

#: Rows up to which Kendall's tau is counted on the driver.
KENDALL_ROWS = 2_000_000


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """``(value, rank)`` of each distinct value, ties sharing the mean rank.

    Counts by value are dealt by range; only one total a partition is summed in one place.
    """
    counts = stage(df.groupBy(value).agg(F.count("*").alias("_k")).repartitionByRange(value).withColumn("_p", F.spark_partition_id()), "ranks")
    inside = Window.partitionBy("_p").orderBy(value)
    totals = counts.groupBy("_p").agg(F.sum("_k").alias("_t"))
    before = totals.select("_p", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    upto = F.sum("_k").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_upto", upto).join(F.broadcast(before), "_p").select(value, (F.col("_before") + F.col("_upto") - (F.col("_k") - 1) / 2).alias("rank"))


def _kendall(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """tau-b and its asymptotic p-value with ties; discordant pairs by counting inversions in merges."""
    n = len(x)
    o = np.lexsort((y, x))
    x, y = x[o], np.unique(y[o], return_inverse=True)[1]
    ties = lambda *cols: np.unique(np.stack(cols), axis=1, return_counts=True)[1].astype(float)
    tx, ty, txy = ties(x), ties(y), ties(x, y)
    pairs = lambda t: float((t * (t - 1) / 2).sum())
    swaps, width, a = 0, 1, y.astype(np.int64)
    while width < n:  # each round merges neighbours of sorted runs; all runs at once
        block = np.arange(n) // (2 * width)
        right = (np.arange(n) // width) % 2 == 1
        order = np.lexsort((right, a, block))
        r = right[order]
        lefts = np.bincount(block[~right], minlength=block[-1] + 1)
        seen = np.cumsum(~r) - np.r_[0, np.cumsum(lefts)][block[order]]
        swaps += int((lefts[block[order]] - seen)[r].sum())
        a = a[order]
        width *= 2
    total, nx, ny, nxy = n * (n - 1) / 2, pairs(tx), pairs(ty), pairs(txy)
    s = total - nx - ny + nxy - 2 * swaps
    if total in (nx, ny):
        return math.nan, math.nan
    tau = s / math.sqrt((total - nx) * (total - ny))
    m = n * (n - 1)
    v = (m * (2 * n + 5) - (tx * (tx - 1) * (2 * tx + 5)).sum() - (ty * (ty - 1) * (2 * ty + 5)).sum()) / 18
    v += 4 * nx * ny / (2 * m) + ((tx * (tx - 1) * (tx - 2)).sum() * (ty * (ty - 1) * (ty - 2)).sum() / (9 * m * (n - 2)) if n > 2 else 0)
    return tau, normal_two_sided(s / math.sqrt(v)) if v > 0 else math.nan


def correlation(df: DataFrame, columns: Sequence[str] | None = None, *, col1: str | None = None, col2: str | None = None, method: str = "pearson") -> DataFrame:
    """``(term1, term2, correlation, p.value)`` of each pair; rows null in one of a pair are left out of it."""
    if (columns is None) == (col1 is None or col2 is None):
        raise ValueError("give either columns, or col1 and col2")
    if method not in ("pearson", "spearman", "kendall"):
        raise ValueError("method must be 'pearson', 'spearman' or 'kendall'")
    names = list(columns) if columns is not None else [col1, col2]
    require_columns(df, names)
    pairs = list(itertools.combinations(names, 2))
    num = {c: column(df, c).cast("double") for c in names}
    rows = []
    if method == "pearson":  # all pairs in one pass
        both = lambda a, b: num[a].isNotNull() & num[b].isNotNull()
        aggs = [x for i, (a, b) in enumerate(pairs) for x in (F.corr(F.when(both(a, b), num[a]), F.when(both(a, b), num[b])).alias(f"r{i}"), F.count_if(both(a, b)).alias(f"n{i}"))]
        found = df.agg(*aggs).first() if pairs else {}
        rows = [(a, b, found[f"r{i}"], found[f"n{i}"]) for i, (a, b) in enumerate(pairs)]
    for a, b in pairs if method != "pearson" else ():
        two = df.select(num[a].alias("a"), num[b].alias("b")).dropna()
        if method == "spearman":
            ra, rb = (average_ranks(two, c).select(c, F.col("rank").alias(f"r{c}")) for c in "ab")
            r, n = two.join(ra, "a").join(rb, "b").agg(F.corr("ra", "rb"), F.count("*")).first()
            rows.append((a, b, r, n))
        else:
            n = two.count()
            if n > KENDALL_ROWS:
                raise ValueError(f"Kendall's tau needs at most {KENDALL_ROWS} rows")
            pdf = two.toPandas()
            rows.append((a, b, *_kendall(pdf["a"].to_numpy(), pdf["b"].to_numpy())))
    if method != "kendall":
        p = lambda r, n: math.nan if r is None or math.isnan(r) else t_two_sided(r * math.sqrt((n - 2) / max(1 - r * r, 1e-300)), n - 2) if n > 2 else math.nan
        rows = [(a, b, r, p(r, n)) for a, b, r, n in rows]
    return df.sparkSession.createDataFrame(rows, "term1 string, term2 string, correlation double, `p.value` double")


def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    """``(x, y, observed, expected)`` of every pair of levels, those without rows too."""
    require_columns(df, [x, y])
    cells = df.select(column(df, x).cast("string").alias("x"), column(df, y).cast("string").alias("y")).dropna().groupBy("x", "y").agg(F.count("*").alias("observed"))
    mx, my = cells.groupBy("x").agg(F.sum("observed").alias("nx")), cells.groupBy("y").agg(F.sum("observed").alias("ny"))
    n = cells.agg(F.sum("observed").alias("n"))
    grid = mx.join(F.broadcast(n)).join(my)  # levels by levels: the table itself, not its rows
    return grid.join(cells, ["x", "y"], "left").select("x", "y", F.coalesce("observed", F.lit(0)).alias("observed"), (F.col("nx") * F.col("ny") / F.col("n")).alias("expected"))


def chi_square_table(df: DataFrame, x: str, y: str, correction: bool = True) -> DataFrame:
    """``(chi2, p_value, dof)``; with one degree of freedom Yates' correction unless ``correction=False``."""
    grid = contingency(df, x, y)
    gap = F.abs(F.col("observed") - F.col("expected"))
    cut = F.greatest(gap - F.least(gap, F.lit(0.5)), F.lit(0.0))
    r = grid.agg(F.sum(gap * gap / F.col("expected")).alias("plain"), F.sum(cut * cut / F.col("expected")).alias("yates"), F.countDistinct("x").alias("kx"), F.countDistinct("y").alias("ky")).first()
    dof = max(r["kx"] - 1, 0) * max(r["ky"] - 1, 0)
    chi2 = (r["yates"] if dof == 1 and correction else r["plain"]) or 0.0
    return df.sparkSession.createDataFrame([(float(chi2), float(chi2_sf(chi2, dof)) if dof else 1.0, int(dof))], "chi2 double, p_value double, dof long")


def chi_square(df: DataFrame, x: str, y: str, *, correction: bool = True) -> tuple[DataFrame, object]:
    """``(table, figure)``; the figure is None where matplotlib is not installed."""
    from .plots import bars

    return chi_square_table(df, x, y, correction), bars(contingency(df, x, y), x, y)

"""Matrix permutation regression (MRQAP)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.special import t_two_sided


def _lower(m: np.ndarray) -> np.ndarray:
    return m[np.tril_indices(len(m), -1)]


def mrqap(y: np.ndarray, x_matrices: Sequence[np.ndarray], n_permutations: int = 1000, *, method: str = "pearson", spark: SparkSession | None = None) -> dict:
    """Regression of a square matrix on others, with p-values from permuting rows and columns of ``y`` together.

    The permutations come one after the other from a generator seeded with 42.  With
    ``spark`` they are dealt to tasks over broadcast matrices; the result is the same.
    """
    y = np.asarray(y, float)
    xs = [np.asarray(x, float) for x in x_matrices]
    if not xs:
        raise ValueError("at least one predictor matrix is needed")
    if y.ndim != 2 or y.shape[0] != y.shape[1] or any(x.shape != y.shape for x in xs):
        raise ValueError("all matrices must be square and of one shape")
    design = np.column_stack([np.ones(len(_lower(y))), *map(_lower, xs)])
    gram = design.T @ design
    if np.linalg.cond(gram) > 1e12:
        gram = gram + 1e-6 * np.eye(len(gram))
    solver = np.linalg.solve(gram, design.T)
    vec = _lower(y)
    beta = solver @ vec
    sst = ((vec - vec.mean()) ** 2).sum()
    r2 = 1 - ((vec - design @ beta) ** 2).sum() / sst if sst > 0 else 0.0
    rng = np.random.default_rng(42)
    order = [rng.permutation(len(y)) for _ in range(n_permutations)]
    if spark is not None and n_permutations:
        shared = spark.sparkContext.broadcast((y, solver))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            y, solver = shared.value
            for b in batches:
                yield pd.DataFrame({"i": b["i"], "beta": [(solver @ _lower(y[np.ix_(p, p)])).tolist() for p in b["p"]]})

        rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(order)], "i long, p array<long>")
        found = rows.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "i long, beta array<double>").collect()
        betas = np.array([r["beta"] for r in sorted(found)])
    else:
        betas = np.array([solver @ _lower(y[np.ix_(p, p)]) for p in order]).reshape(-1, len(beta))
    x0 = _lower(xs[0])
    r = float(np.corrcoef(vec, x0)[0, 1]) if vec.std() > 0 and x0.std() > 0 else float("nan")
    df = len(vec) - 2
    p = t_two_sided(r * (df / max(1 - r * r, 1e-300)) ** 0.5, df) if r == r else float("nan")
    return {
        "coefficients": beta.tolist(),
        "p_values": ((np.abs(betas) >= np.abs(beta)).mean(axis=0) if n_permutations else np.full(len(beta), np.nan)).tolist(),
        "r2": float(r2),
        "permutation_betas": betas,
        "correlation": {"correlation": r, "p_value": p},
        "method": method,
    }


def matrix_of(cells: DataFrame, i: str = "i", j: str = "j", v: str = "v", n: int | None = None) -> np.ndarray:
    """A dense matrix of a coordinate table; cells not there are 0."""
    pdf = cells.select(i, j, v).toPandas()
    n = n if n is not None else int(pdf[[i, j]].to_numpy().max()) + 1
    m = np.zeros((n, n))
    m[pdf[i], pdf[j]] = pdf[v]
    return m

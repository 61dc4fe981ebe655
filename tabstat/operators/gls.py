"""Generalised least squares with correlated errors: AR(1) over an ordered table, any Omega over a small one."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.operators.linalg import MOST
from tabstat.operators.regression import Model
from tabstat.plans.gram import moments, solve
from tabstat.plans.ordered import number


def _model(features: Sequence[str], target: str, n: int, cross: np.ndarray) -> Model:
    """From the cross products of the whitened constant, features and target."""
    inverse = solve(cross[:-1, :-1], np.eye(len(cross) - 1))
    beta = inverse @ cross[:-1, -1]
    rss = cross[-1, -1] - beta @ cross[:-1, -1]
    sigma2 = rss / (n - len(beta)) if n > len(beta) else math.nan
    model = Model(list(features), target, float(beta[0]), beta[1:], cov=sigma2 * inverse, stats={"n": n, "sigma2": float(sigma2)})
    model.stderr = np.sqrt(np.diag(model.cov))
    return model


def fit_ar1(df: DataFrame, features: Sequence[str], target: str, order_by: Sequence[str], rho: float) -> Model:
    """Least squares under Omega[i, j] = rho ** abs(i - j) along the order; abs(rho) < 1.

    Each row less rho times the one before it, the first times sqrt(1 - rho ** 2):
    an equi-join on position and one Gram matrix, for series of any length. Rows
    with nulls are left out before they are numbered.
    """
    if not abs(rho) < 1:
        raise ValueError("rho must lie between -1 and 1")
    names = [f"_x{i}" for i in range(len(features) + 2)]
    keys = [f"_o{i}" for i in range(len(order_by))]
    rows = df.dropna(subset=[*features, target])
    values = [F.lit(1.0), *(F.col(c).cast("double") for c in [*features, target])]
    placed = number(rows.select(*(v.alias(c) for v, c in zip(values, names, strict=True)), *(F.col(c).alias(k) for c, k in zip(order_by, keys, strict=True))), keys, "_t")
    before = placed.select((F.col("_t") + 1).alias("_t"), *(F.col(c).alias(f"{c}b") for c in names))
    first = math.sqrt(1 - rho * rho)
    white = placed.join(before, "_t", "left").select(*(F.when(F.col("_t") == 0, F.col(c) * first).otherwise(F.col(c) - F.col(f"{c}b") * rho).alias(c) for c in names))
    g = moments(white, names)
    return _model(features, target, int(g.n), g.raw()[1:, 1:])


def fit_dense(df: DataFrame, features: Sequence[str], target: str, order_by: Sequence[str], omega: np.ndarray) -> Model:
    """Least squares under any positive definite Omega, its rows and columns in the order: on the driver, for MOST rows at most."""
    n = len(omega)
    if omega.shape != (n, n) or n > MOST:
        raise ValueError(f"Omega must be square, of {MOST} rows at most")
    rows = df.dropna(subset=[*features, target]).orderBy(*order_by).select(*features, target).limit(n + 1).collect()
    if len(rows) != n:
        raise ValueError(f"Omega has {n} rows, the table hasn't")
    data = np.column_stack([np.ones(n), np.array(rows, float).reshape(n, -1)])
    white = np.linalg.solve(np.linalg.cholesky(omega), data)
    return _model(features, target, n, white.T @ white)

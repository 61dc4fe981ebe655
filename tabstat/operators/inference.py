"""Coefficient covariances and tests. Heavy sums are distributed; what is solved is p by p."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstat.plans import dist
from tabstat.plans.gram import Gram, moments, solve
from tabstat.plans.ordered import lagged, number

KINDS = ("classical", "HC3", "HAC", "cluster")


def design(features: Sequence[str], intercept: bool) -> list[Column]:
    return [*([F.lit(1.0)] if intercept else []), *(F.col(c).cast("double") for c in features)]


def _outer(rows: DataFrame, z: list[Column], weight: Column) -> np.ndarray:
    """Sum of weight * z z' by one aggregation."""
    p = len(z)
    found = rows.agg(*(F.sum(weight * z[i] * z[j]).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p))).first()
    out = np.empty((p, p))
    for i in range(p):
        for j in range(i, p):
            out[i, j] = out[j, i] = found[f"q{i}_{j}"] or 0.0
    return out


def meat(df: DataFrame, features: Sequence[str], residual: str, inverse: np.ndarray, kind: str, *, n: int, intercept: bool = True, cluster: str | None = None, order_by: Sequence[str] = ()) -> np.ndarray:
    """The middle of a sandwich covariance: HC3, HAC (Newey-West) or cluster."""
    z, e, p = design(features, intercept), F.col(residual), len(inverse)
    if kind == "HC3":
        h = sum((F.lit(float(inverse[i, j])) * z[i] * z[j] for i in range(p) for j in range(p)), F.lit(0.0))
        return _outer(df, z, (e / (1 - h)) * (e / (1 - h)))
    score = [(e * x).alias(f"s{i}") for i, x in enumerate(z)]
    names = [f"s{i}" for i in range(p)]
    if kind == "cluster":
        if cluster is None:
            raise ValueError("cluster needs a column")
        sums = df.groupBy(cluster).agg(*(F.sum(s).alias(x) for s, x in zip(score, names, strict=True)))
        groups = df.select(cluster).distinct().count()
        return _outer(sums, [F.col(x) for x in names], F.lit(1.0)) * groups / (groups - 1) * (n - 1) / (n - p)
    if kind == "HAC":
        lags = int(4 * (n / 100) ** (2 / 9))
        rows = number(df.select(*score, *(c for c in order_by)), order_by, "_t").select("_t", *names)
        pairs = lagged(rows, "_t", lags, names)
        sums = pairs.groupBy("lag").agg(*(F.sum(F.col(a) * F.col(f"{b}_lag")).alias(f"{a}_{b}") for a in names for b in names))
        out = np.zeros((p, p))
        for r in sums.collect():
            gamma = np.array([[r[f"{a}_{b}"] or 0.0 for b in names] for a in names])
            out += gamma if r.lag == 0 else (1 - r.lag / (lags + 1)) * (gamma + gamma.T)
        return out
    raise ValueError(f"unknown covariance {kind!r}")


def fisher_test(r2: float, df1: int, df2: int, beta: np.ndarray | None = None, cov: np.ndarray | None = None, kind: str = "classical") -> float:
    """F of all slopes: from R2, or for robust covariances the Wald form over the slopes."""
    if kind == "classical":
        return r2 * df2 / (df1 * (1 - r2)) if r2 < 1 else math.inf
    slopes = slice(1, None)
    return float(beta[slopes] @ solve(cov[slopes, slopes], beta[slopes]) / df1)


def vif(g: Gram, features: int) -> np.ndarray:
    """Variance inflation: the diagonal of the inverse correlation matrix; inf above R2 = 0.9999."""
    c = g.centred[:features, :features]
    s = np.sqrt(np.diag(c))
    corr = c / np.outer(s, s)
    if features == 1:
        return np.ones(1)
    try:
        out = np.diag(solve(corr, np.eye(features))).copy()
    except ValueError:
        return np.full(features, math.inf)
    out[out >= 1e4] = math.inf
    return out


def breusch_pagan(df: DataFrame, features: Sequence[str], residual: str) -> tuple[float, float]:
    """(LM, p value): R2 of squared residuals on the features, times n."""
    g = moments(df, [*features, F.col(residual) * F.col(residual)], [*features, "e2"])
    k = len(features)
    beta = solve(g.centred[:k, :k], g.centred[:k, k])
    lm = float(g.n * (beta @ g.centred[:k, k]) / g.centred[k, k])
    return lm, dist.chi2_p_value(lm, k)

"""Aggregates and model-quality statistics: each is a lazy one-row DataFrame or a column expression."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstat.functions.transforms import clipped
from tabstat.plans.ordered import lagged, number, quantiles


def mean(c: str) -> Column:
    return F.avg(c)


def variance(c: str) -> Column:
    """Sample variance; null below two rows."""
    return F.when(F.count(c) > 1, F.var_samp(c))


def covariance(a: str, b: str) -> Column:
    """Sample covariance; null below two rows."""
    return F.when(F.count(F.col(a) + F.col(b)) > 1, F.covar_samp(a, b))


def r_squared(y: str, p: str) -> Column:
    gap = F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))
    total = F.var_pop(y) * F.count(y)
    return F.when(total != 0, 1 - gap / total)


def r_adjusted(r2: float, n: int, p: int) -> float:
    if n - p - 1 == 0:
        raise ValueError("no degrees of freedom left")
    return 1 - (1 - r2) * (n - 1) / (n - p - 1)


def mae(y: str, p: str | None = None) -> Column:
    return F.avg(F.abs(F.col(y) - (F.col(p) if p else F.lit(0.0))))


def mse(y: str, p: str | None = None) -> Column:
    gap = F.col(y) - (F.col(p) if p else F.lit(0.0))
    return F.avg(gap * gap)


def rmse(y: str, p: str | None = None) -> Column:
    return F.sqrt(mse(y, p))


def log_likelihood(y: str, p: str, kind: str = "gaussian") -> Column:
    """Gaussian, with the variance at its estimate, or Bernoulli."""
    if kind == "gaussian":
        n, rss = F.count(y).cast("double"), F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))
        return -n / 2 * (F.log(F.lit(2 * math.pi) * rss / n) + 1)
    if kind != "bernoulli":
        raise ValueError(f"unknown kind {kind!r}")
    q = clipped(F.col(p))
    return F.sum(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))


def with_residuals(df: DataFrame, y: str, p: str, name: str = "residual") -> DataFrame:
    return df.withColumn(name, F.col(y) - F.col(p))


def residual_summary(df: DataFrame, c: str) -> DataFrame:
    """mean, sd, max_abs and exact quartiles (linear interpolation)."""
    q = quantiles(df, c, (0.25, 0.5, 0.75)) or [None] * 3
    return df.agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.max(F.abs(c)).alias("max_abs"), *(F.lit(v).cast("double").alias(f"q{i + 1}") for i, v in enumerate(q)))


def durbin_watson(df: DataFrame, c: str, order_by: Sequence[str]) -> DataFrame:
    """One row, ``rho``: 1 - DW / 2."""
    rows = number(df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("_e"), *(x for x in order_by if x != c)), order_by, "_t")
    pairs = lagged(rows, "_t", 1, ["_e"])
    gap = F.when(F.col("lag") == 1, (F.col("_e") - F.col("_e_lag")) * (F.col("_e") - F.col("_e_lag")))
    return pairs.agg((1 - F.sum(gap) / F.sum(F.when(F.col("lag") == 0, F.col("_e") * F.col("_e"))) / 2).alias("rho"))


def aic(df: float, log_lik: float) -> float:
    return 2 * df - 2 * log_lik


def bic(df: float, log_lik: float, n: int) -> float:
    return df * math.log(n) - 2 * log_lik

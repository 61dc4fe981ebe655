"""Scaling and transforms: statistics from one aggregation, joined back as a single row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstat.functions import transforms
from tabstat.plans.ordered import quantiles

METHODS = ("standard", "mean", "minmax", "robust")


def scale(df: DataFrame, column: str, method: str = "standard", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """df with the column scaled. Raises if it has no spread.

    standard: (x - mean) / sample sd. mean: (x - mean) / (max - min). minmax: to
    low..high. robust: (x - median) / (Q3 - Q1). Nulls stay null. The statistics
    are read first: one row, by exact aggregates.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    c = F.col(column).cast("double")
    if method == "robust":
        q = quantiles(df, column, (0.25, 0.5, 0.75))
        centre, width = (q[1], q[2] - q[0]) if q else (None, None)
    else:
        r = df.agg(F.avg(c).alias("m"), F.stddev_samp(c).alias("s"), F.min(c).alias("a"), F.max(c).alias("b")).first()
        span = None if r.a is None else r.b - r.a
        centre, width = {"standard": (r.m, r.s), "mean": (r.m, span), "minmax": (r.a, span)}[method]
    if not width:
        raise ValueError(f"{column!r} has no spread")
    out = (c - F.lit(float(centre))) / F.lit(float(width))
    if method == "minmax":
        out = F.lit(float(low)) + out * F.lit(float(high - low))
    return df.withColumn(column, out)


def transform(df: DataFrame, column: str, method: str, lam: float = 1.0) -> DataFrame:
    """df with the column transformed by log, box_cox, yeo_johnson or power."""
    c = F.col(column).cast("double")
    ways: dict[str, Column] = {"log": transforms.log(c), "box_cox": transforms.box_cox(c, lam), "yeo_johnson": transforms.yeo_johnson(c, lam), "power": transforms.power(c, lam)}
    if method not in ways:
        raise ValueError(f"unknown method {method!r}")
    return df.withColumn(column, ways[method])

"""Exact splits and folds. Rows are put in the order of a key, or of its hash with a seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstat.plans.ordered import number


def shuffle_key(key: str, seed: int | None) -> list[Column]:
    """Order by the key, or for a seed by a hash that doesn't depend on how rows are dealt."""
    return [F.col(key)] if seed is None else [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]


def _shares(pct: float | Sequence[float]) -> list[float]:
    shares = [float(pct)] if isinstance(pct, (int, float)) else [float(x) for x in pct]
    if not 1 <= len(shares) <= 2 or any(not 1 <= x <= 99 for x in shares) or (len(shares) == 2 and sum(shares) >= 99):
        raise ValueError("percentages must be within 1..99, and a sum of two below 99")
    return shares


def train_test_split(df: DataFrame, key: str, pct: float | Sequence[float] = 80, seed: int | None = None) -> DataFrame:
    """df with a column ``split``: train and test, or train, valid and test for two percentages.

    Sizes are exact: round(n * pct / 100), and at least one row for what follows.
    """
    shares = _shares(pct)
    rows = number(df, shuffle_key(key, seed), "_at")
    n = rows.count()
    train = min(int(n * shares[0] / 100 + 0.5), n - len(shares))
    valid = max(int(n * shares[1] / 100 + 0.5), 1) if len(shares) == 2 else 0
    name = F.when(F.col("_at") < train, "train").when(F.col("_at") < train + valid, "valid").otherwise("test")
    return rows.withColumn("split", name).drop("_at")


def stratified_split(df: DataFrame, key: str, label: str, pct: float | Sequence[float] = 80, seed: int | None = None) -> DataFrame:
    """train_test_split inside each class. A class smaller than the number of parts raises.

    Rows are numbered over (label, order) with one range sort, and a class's first
    place is taken off: no class is gathered in one task.
    """
    shares = _shares(pct)
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    if not sizes.where(F.col("_n") < len(shares) + 1).isEmpty():
        raise ValueError("a class has too few rows")
    rows = number(df, [F.col(label), *shuffle_key(key, seed)], "_at")
    first = rows.groupBy(label).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).withColumnRenamed(label, "_label")
    rows = rows.join(F.broadcast(first) if first.count() <= 100_000 else first, rows[label].eqNullSafe(F.col("_label"))).withColumn("_at", F.col("_at") - F.col("_first"))
    train = F.least(F.floor(F.col("_n") * shares[0] / 100 + 0.5), F.col("_n") - len(shares))
    valid = F.least(F.greatest(F.floor(F.col("_n") * shares[1] / 100 + 0.5), F.lit(1)), F.col("_n") - train - 1) if len(shares) == 2 else F.lit(0)
    name = F.when(F.col("_at") < train, "train").when(F.col("_at") < train + valid, "valid").otherwise("test")
    return rows.select(*df.columns, name.alias("split"))


def folds(df: DataFrame, key: str, k: int = 5, seed: int | None = None, name: str = "fold") -> DataFrame:
    """df with a fold of 0..k-1 for each row: consecutive runs of floor(n / k) rows. The last n mod k rows are left out."""
    if k < 2:
        raise ValueError("k must be at least 2")
    rows = number(df, shuffle_key(key, seed), "_at")
    size = rows.count() // k
    if not size:
        raise ValueError("fewer rows than folds")
    return rows.where(F.col("_at") < size * k).withColumn(name, F.floor(F.col("_at") / size).cast("int")).drop("_at")

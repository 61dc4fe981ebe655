"""Vector kernels on array columns, and aggregates with the same meaning on scalar columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays; null where their lengths differ."""
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: (x * y).cast("double"))))


def scaled(a: Column, factor: float) -> Column:
    return F.transform(a, lambda x: x * factor)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def norm(a: Column, p: float = 2, power: float = 1) -> Column:
    """(sum of abs(x)**p) ** (power / p)."""
    return F.pow(_sum(F.transform(a, lambda x: F.pow(F.abs(x), F.lit(float(p))))), F.lit(power / p))


def distance(a: Column, b: Column, p: float = 2, power: float = 1, sign: int = -1) -> Column:
    """norm(a - b), or of a + b with sign=1."""
    return norm(subtract(a, b) if sign < 0 else add(a, b), p, power)


def distance_present(a: Column, b: Column, p: float = 2, power: float = 1) -> Column:
    """Distance over the places where both are present, divided by their number before the root; null if none."""
    gaps = F.filter(subtract(a, b), lambda x: x.isNotNull())
    return F.when(F.size(gaps) > 0, F.pow(_sum(F.transform(gaps, lambda x: F.pow(F.abs(x), F.lit(float(p))))) / F.size(gaps), F.lit(power / p)))


def gower(a: list[Column], b: list[Column], categorical: list[bool], ranges: list[float]) -> Column:
    """Mean over the jointly present places of (differs) or abs(difference) / range (0 where the range is 0)."""
    terms, present = [], []
    for x, y, cat, width in zip(a, b, categorical, ranges, strict=True):
        both = x.isNotNull() & y.isNotNull()
        gap = (x != y).cast("double") if cat else (F.abs(x - y) / width if width else F.lit(0.0))
        terms.append(F.when(both, gap).otherwise(0.0))
        present.append(both.cast("int"))
    n = reduce(Column.__add__, present)
    return F.when(n > 0, reduce(Column.__add__, terms) / n)


def range_except(most: int, exclude: int) -> Column:
    """0..most without exclude."""
    return F.filter(F.sequence(F.lit(0), F.lit(most)), lambda x: x != exclude)


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """One row, ``mode``: the most frequent value, the least of several."""
    return df.where(F.col(column).isNotNull()).groupBy(column).count().agg(F.min_by(column, F.struct(-F.col("count"), F.col(column))).alias("mode"))


def with_mid_ranks(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """df with average ranks (1-based; ties share the mean of their places; nulls last and null).

    Ranks come from cumulated counts of distinct values, so only those are put in order.
    """
    from tabstat.plans.ordered import number

    counts = number(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n")), ["_v"], "_i")
    step = 1 << 12
    blocks = counts.groupBy(F.floor(F.col("_i") / step).alias("_b")).agg(F.sum("_n").alias("_t"))
    before = blocks.select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_before"))
    inside = Window.partitionBy("_b").orderBy("_i")
    ranks = counts.withColumn("_b", F.floor(F.col("_i") / step)).join(before, "_b").select("_v", (F.col("_before") + F.sum("_n").over(inside) - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranks, df[column] == ranks["_v"], "left").drop("_v")


def value_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: max - min of each column over its present values."""
    return df.agg(*((F.max(c) - F.min(c)).cast("double").alias(c) for c in columns))


def all_integers(column: str) -> Column:
    """Aggregate: whether all present values are whole."""
    return F.bool_and(F.col(column).isNull() | (F.col(column) == F.floor(column)))

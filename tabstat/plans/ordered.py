"""Row positions under a global order, without a window over one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstat.plans.shared import write_table


def number(df: DataFrame, order_by: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """df with the 0-based position of each row in the order.

    Rows are dealt by range and sorted in their partitions; the driver only sees
    one count per partition. The sorted table is written first, as positions must
    not change when a lost partition is made again.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    if not keys:
        raise ValueError("order_by is required: rows of a DataFrame have no order of their own")
    ranged = write_table(df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", 33)
    counts = sorted((r.p, r.n) for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets += [F.lit(p), F.lit(total)]
        total += n
    base = F.create_map(*offsets)[part] if offsets else F.lit(0)
    return ranged.select(*df.columns, (base + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("bigint").alias(name))


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float] | None:
    """Exact quantiles with linear interpolation, nulls left out; None without values.

    Values get their positions by a range sort, and only those next to the wanted
    places are read: no task sees more than its range.
    """
    rows = number(df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v")), ["_v"], "_at")
    n = rows.count()
    if not n:
        return None
    places = [s * (n - 1) for s in shares]
    near = {r._at: r._v for r in rows.where(F.col("_at").isin(sorted({int(p) for p in places} | {min(int(p) + 1, n - 1) for p in places}))).collect()}
    return [near[int(p)] + (p - int(p)) * (near[min(int(p) + 1, n - 1)] - near[int(p)]) for p in places]


def lagged(df: DataFrame, pos: str, lags: int, columns: Sequence[str]) -> DataFrame:
    """Each row with the rows lag = 0..lags places before it: columns, ``lag`` and ``<column>_lag``.

    An equi-join on position, so a series of any length spreads over all tasks.
    """
    before = df.select(F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), "*").select(
        "lag", (F.col(pos) + F.col("lag")).alias("_to"), *(F.col(c).alias(f"{c}_lag") for c in columns)
    )
    return df.select(F.col(pos).alias("_to"), *columns).join(before, "_to").withColumnRenamed("_to", pos)

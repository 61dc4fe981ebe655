"""Missing values: statistics, neighbours in the order, and nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabstat.functions.vectors import gower, most_frequent
from tabstat.plans.ordered import number, quantiles
from tabstat.plans.shared import write_table

METHODS = ("mean", "median", "mode", "forward", "backward")
#: Positions in one stretch when values are carried over the whole order.
_STRETCH = 1 << 16
#: Shares into which the donors of a cell are split.
_SHARES = 16


def impute(df: DataFrame, column: str, method: str = "mean", order_by: Sequence[str] = ()) -> DataFrame:
    """df with the column's nulls filled: by the mean, median or mode of the others, or by the last (forward) or next (backward) value in the order.

    A null that has nothing to fill it stays null.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if method in ("forward", "backward"):
        return _carry(df, column, list(order_by), method == "forward")
    if method == "mode":
        found = most_frequent(df, column).first()
        value = found[0] if found else None
    else:
        value = df.agg(F.avg(column)).first()[0] if method == "mean" else (quantiles(df, column, [0.5]) or [None])[0]
    return df if value is None else df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def _carry(df: DataFrame, column: str, order_by: list[str], forward: bool) -> DataFrame:
    """Carries values inside stretches of the order, and the last value of each stretch to the next ones.

    Only one row for each stretch goes through a single task.
    """
    rows = number(df, order_by, "_t").withColumn("_s", F.floor(F.col("_t") / _STRETCH))
    last = rows.where(F.col(column).isNotNull()).groupBy("_s").agg((F.max_by if forward else F.min_by)(column, "_t").alias("_v"))
    edge = rows.groupBy("_s").agg(F.count("*")).select("_s").join(last, "_s", "left")
    line = Window.orderBy(F.col("_s") if forward else F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select("_s", F.last("_v", ignorenulls=True).over(line).alias("_before"))
    inside = Window.partitionBy("_s").orderBy("_t" if forward else F.col("_t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(column, ignorenulls=True).over(inside), F.col("_before"))
    return rows.join(edge, "_s").withColumn(column, filled).select(*df.columns)


def knn_impute(df: DataFrame, key: str, columns: Sequence[str], k: int = 5, p: float = 2, categorical: Sequence[str] = (), block: int = 2000) -> DataFrame:
    """df with nulls of the columns filled from the k nearest rows that have the value.

    Distance: (sum of abs differences ** p over jointly present columns / their
    number) ** (1 / p), or Gower's with p=-1. A donor at distance 0 is copied.
    Otherwise a categorical or whole-valued column takes the value with the most inverse-distance weight,
    and any other the weighted mean. Distances use the original values, ties go to
    the lower key, and a cell without donors stays null.

    A distance reads only the columns that the row with the null has. Rows with equal
    values in them are one: each different row with nulls meets each different row
    of donors, which stands for its first k by key. Those with nulls come in blocks:
    each is a bounded broadcast, and the k best of a cell are found in shares first.
    """
    columns = list(columns)
    size = range(len(columns))
    whole = df.agg(*(F.bool_and(F.col(c).isNull() | (F.col(c) == F.floor(c))).alias(c) for c in columns)).first()
    widths = df.agg(*((F.max(c) - F.min(c)).cast("double").alias(c) for c in columns)).first()
    base = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), *(F.col(c).cast("double").alias(f"d{i}") for i, c in enumerate(columns)))
    missing = base.where(reduce(Column.__or__, [F.col(f"d{i}").isNull() for i in size]))
    # Where rows share a key, a list also holds those that a row of that key leaves out.
    room = k + (base.groupBy("_k").count().agg(F.max("count")).first()[0] or 1) - 1
    kinds = missing.select(*(F.col(f"d{i}").alias(f"q{i}") for i in size)).distinct()
    gone = F.concat(*(F.col(f"q{i}").isNull().cast("int").cast("string") for i in size))
    masks = [r[0] for r in kinds.select(gone).distinct().collect()]
    kinds = write_table(kinds.withColumn("_m", gone))

    def first(rows: DataFrame, by: list, order: list[str]) -> DataFrame:
        """The first of the rows of each place, in each task's share first: no cell's donors meet in one place."""
        share = F.pmod(F.xxhash64("k"), F.lit(_SHARES))
        return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by, share).orderBy(*order))).where(F.col("_r") <= room).drop("_r")

    # A row's values in the columns that a mask leaves, once for each mask and each masked column that it has.
    cells = F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"d{i}").alias("v")) for i in size))
    donors = base.select("*", F.explode(F.array(*map(F.lit, masks)) if masks else F.array().cast("array<string>")).alias("_m")).select("*", F.explode(cells).alias("x"))
    donors = donors.where(F.col("x.v").isNotNull() & (F.substring("_m", F.col("x.c") + 1, F.lit(1)) == "1"))
    donors = donors.select("_m", "x.c", F.col("_k").alias("k"), "x.v", *(F.when(F.substring("_m", i + 1, 1) == "0", F.col(f"d{i}")).alias(f"d{i}") for i in size))
    place = ["_m", "c", *(f"d{i}" for i in size)]
    some = first(donors, place, ["k"]).groupBy(*place).agg(F.expr(f"slice(array_sort(collect_list(struct(k, v))), 1, {room})").alias("some"))
    some = write_table(some)
    blocks = max(1, -(-kinds.count() // block))
    found = None
    for b in range(blocks):
        asked = kinds.where(F.pmod(F.xxhash64(*(f"q{i}" for i in size)), F.lit(blocks)) == b)
        pairs = some.join(F.broadcast(asked), "_m")
        mine, theirs = [F.col(f"q{i}") for i in size], [F.col(f"d{i}") for i in size]
        if p < 0:
            gap = gower(mine, theirs, [c in categorical for c in columns], [widths[c] or 0.0 for c in columns])
        else:
            terms = [F.when(x.isNotNull() & y.isNotNull(), F.pow(F.abs(x - y), F.lit(float(p)))) for x, y in zip(mine, theirs, strict=True)]
            n = sum((t.isNotNull().cast("int") for t in terms), F.lit(0))
            gap = F.when(n > 0, F.pow(sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0)) / n, F.lit(1 / p)))
        asks = [f"q{i}" for i in size]
        near = pairs.select(*asks, "c", gap.alias("d"), "some").where("d IS NOT NULL").select(*asks, "c", "d", F.explode("some").alias("s")).select(*asks, "c", "d", "s.k", "s.v")
        near = first(near, [*asks, "c"], ["d", "k"]).groupBy(*asks, "c").agg(F.expr(f"slice(array_sort(collect_list(struct(d, k, v))), 1, {room})").alias("near"))
        found = near if found is None else found.union(near)
    # Each row takes its kind's list without its own key; rows of one key pool theirs.
    own = missing.join(found, reduce(Column.__and__, [F.col(f"d{i}").eqNullSafe(F.col(f"q{i}")) for i in size]))
    own = own.select(F.col("_k").alias("_q"), "c", F.filter("near", lambda x: x.k != F.col("_k")).alias("near"))
    found = own.groupBy("_q", "c").agg(F.expr(f"slice(array_sort(flatten(collect_list(near))), 1, {int(k)})").alias("near"))
    flags = F.array(*(F.lit(bool(whole[c]) or c in categorical) for c in columns))
    vote = F.expr("""array_sort(transform(array_distinct(transform(near, x -> x.v)), u -> named_struct('w', -aggregate(near, 0D, (s, x) -> s + CASE WHEN x.v = u THEN 1 / x.d ELSE 0D END), 'v', u)))[0].v""")
    mean = F.expr("aggregate(near, 0D, (s, x) -> s + x.v / x.d) / aggregate(near, 0D, (s, x) -> s + 1 / x.d)")
    value = F.when(F.col("near")[0]["d"] == 0, F.col("near")[0]["v"]).when(flags[F.col("c")], vote).otherwise(mean)
    fills = found.select("_q", "c", value.alias("v")).groupBy("_q").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("_fill"))
    out = df.join(fills, df[key] == fills["_q"], "left")
    return out.select(*(F.coalesce(df[c], F.try_element_at("_fill", F.lit(columns.index(c))).cast(df.schema[c].dataType)).alias(c) if c in columns else df[c] for c in df.columns))

"""Column and row manipulation, category codes, one-hot columns, transposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabstat.plans.ordered import number


def columns_of(df: DataFrame, which: Sequence[int | str] | int | str) -> list[str]:
    """Names of columns given by name or 0-based index. Unknown names raise ValueError, bad indexes IndexError."""
    names = []
    for c in [which] if isinstance(which, (int, str)) else which:
        if isinstance(c, int):
            if not 0 <= c < len(df.columns):
                raise IndexError(f"no column {c}")
            c = df.columns[c]
        elif c not in df.columns:
            raise ValueError(f"no column {c!r}")
        names.append(c)
    return names


def select(df: DataFrame, which: Sequence[int | str] | int | str) -> DataFrame:
    return df.select(*columns_of(df, which))


def transfer(df: DataFrame, which: Sequence[int | str] | int | str) -> tuple[DataFrame, DataFrame]:
    """(what is left, the chosen columns in df's order)."""
    chosen = set(columns_of(df, which))
    return df.drop(*chosen), df.select(*(c for c in df.columns if c in chosen))


def drop_columns(df: DataFrame, which: Sequence[int | str] | int | str) -> DataFrame:
    return df.drop(*columns_of(df, which))


def split_rows(df: DataFrame, key: str, values: Sequence) -> tuple[DataFrame, DataFrame]:
    """(rows left, rows taken): those whose key is among the values. A null key is left."""
    if len(values) <= 1000:
        taken = F.coalesce(F.col(key).isin(list(values)), F.lit(False))
        return df.where(~taken), df.where(taken)
    listed = df.sparkSession.createDataFrame([(v,) for v in values], T.StructType([T.StructField(key, df.schema[key].dataType)]))
    return df.join(listed, key, "left_anti"), df.join(listed, key, "left_semi")


def drop_rows(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    return split_rows(df, key, values)[0]


def cell(df: DataFrame, key: str, value, column: int | str) -> DataFrame:
    """The cells of a column in the rows with that key."""
    return df.where(F.col(key) == value).select(*columns_of(df, column))


def row_vector(df: DataFrame, columns: Sequence[str], name: str = "row") -> DataFrame:
    """df with the columns as one array of doubles."""
    return df.withColumn(name, F.array(*(F.col(c).cast("double") for c in columns)))


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def dictionary(df: DataFrame, column: str, order_by: Sequence[str]) -> DataFrame:
    """(label, code): codes 0, 1, ... by first appearance in the order; booleans are 1 and 0.

    Null has no code. Only the distinct labels are put in order.
    """
    kind = df.schema[column].dataType
    labels = df.where(F.col(column).isNotNull())
    text = F.lower(F.col(column).cast("string"))
    if isinstance(kind, T.BooleanType):
        return labels.select(F.col(column).alias("label")).distinct().withColumn("code", F.col("label").cast("int"))
    first = labels.groupBy(F.col(column).alias("label")).agg(F.min(F.struct(*order_by)).alias("_first"), F.min(text.isin("true", "false")).alias("_bool"))
    if first.agg(F.min("_bool")).first()[0]:
        return first.select("label", (F.lower(F.col("label").cast("string")) == "true").cast("int").alias("code"))
    return number(first.select("label", "_first"), ["_first", "label"], "code").select("label", F.col("code").cast("int").alias("code"))


def encode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """df with the column's codes in place of its labels. Labels without a code become null."""
    kind = df.columns
    own = codes.select(F.col("label").alias("_label"), F.col("code").alias("_code"))
    return df.join(own, df[column] == own["_label"], "left").select(*(F.col("_code").alias(c) if c == column else df[c] for c in kind))


def decode(df: DataFrame, column: str, codes: DataFrame, unknown: str = "(no label)") -> DataFrame:
    """df with labels in place of codes; a code without a label becomes ``unknown``, null stays null."""
    own = codes.select(F.col("label").alias("_label"), F.col("code").alias("_code"))
    label = F.when(df[column].isNull(), F.lit(None)).otherwise(F.coalesce(F.col("_label").cast("string"), F.lit(unknown)))
    return df.join(own, df[column] == own["_code"], "left").select(*(label.alias(c) if c == column else df[c] for c in df.columns))


def with_categories(df: DataFrame, column: str, codes: DataFrame, most: int = 10_000) -> DataFrame:
    """df with the dictionary in the column's metadata, which survives select. At most ``most`` labels."""
    rows = codes.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labels")
    return df.withColumn(column, F.col(column).alias(column, metadata={"categories": {str(r.label): int(r.code) for r in rows}}))


def decoded(df: DataFrame, unknown: str = "(no label)") -> DataFrame:
    """df with labels in place of codes in every column that has its dictionary (with_categories)."""
    out = df
    for f in df.schema:
        if "categories" in f.metadata:
            codes = df.sparkSession.createDataFrame([(k, v) for k, v in f.metadata["categories"].items()], "label string, code int")
            out = decode(out, f.name, codes, unknown)
    return out


def clear_categories(df: DataFrame) -> DataFrame:
    """df without column metadata; data stay."""
    return df.select(*(F.col(c).alias(c, metadata={}) for c in df.columns))


def one_hot(df: DataFrame, column: str, categories: Sequence | None = None, most: int = 1000) -> DataFrame:
    """df with a 0/1 column for each category, sorted, in place of the column. Null rows are all 0.

    A numeric column isn't a category and raises. Categories are looked up if not given.
    """
    if not isinstance(df.schema[column].dataType, (T.StringType, T.BooleanType, T.IntegerType, T.ShortType, T.ByteType)):
        raise ValueError(f"{column!r} isn't categorical")
    if categories is None:
        rows = df.select(column).where(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} categories")
        categories = sorted(r[0] for r in rows)
    return df.select(*(c for c in df.columns if c != column), *(F.when(F.col(column) == v, 1.0).otherwise(0.0).alias(str(v)) for v in categories))


def to_long(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Matrix entries (i, j, v): i is the key, j the 0-based column."""
    return df.select(F.col(key).cast("bigint").alias("i"), F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("j", "v")).select("i", F.col("j").cast("bigint").alias("j"), "v")


def display(df: DataFrame, rows: int = 20) -> str:
    """The first rows as text, codes as they are."""
    return df._show_string(rows, False)


def display_decoded(df: DataFrame, rows: int = 20) -> str:
    """The first rows as text, with labels for codes; only these rows are decoded."""
    return display(decoded(df.limit(rows)), rows)

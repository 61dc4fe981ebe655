"""Tables from files. Strings stay strings; NaN becomes null in CSV, and in Parquet on request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values are null everywhere: Spark's aggregates skip null, but not NaN."""
    return df.select(*(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema))


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: str | T.StructType | None = None, nan: str = "NaN") -> DataFrame:
    """A delimited file. Without a schema, types are inferred by column; without a header, columns are c1, c2, ...

    Empty cells and cells that say ``nan`` are null. A column of true and false is boolean. A missing file raises.
    """
    reader = spark.read.option("sep", sep).option("header", header).option("mode", "FAILFAST").option("nanValue", nan).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    if not header and schema is None:
        df = df.toDF(*(f"c{i + 1}" for i in range(len(df.columns))))
    return nan_to_null(df)


def read_parquet(spark: SparkSession, path: str, nan_is_null: bool = False) -> DataFrame:
    """A Parquet table. nan_is_null makes NaN null, at the price of filters on doubles: they no longer reach the files."""
    df = spark.read.parquet(path)
    return nan_to_null(df) if nan_is_null else df


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.option("sep", sep).option("header", header).csv(path)

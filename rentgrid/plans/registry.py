"""Named queries over the given tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded double without negative zero, as the SQL twins write it."""
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded (sums of doubles depend on their order)."""
    return df.select(*[r(c, digits).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])

"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is spread over ``SALTS`` tasks.
HOT_ROWS = 1_000_000
SALTS = 64


def attach_per_key(df: DataFrame, per_key: DataFrame, keys: Sequence[str], size: str,
                   hot_rows: int = HOT_ROWS, salts: int = SALTS, keep_size: bool = True,
                   how: str = "left") -> DataFrame:
    """Join a table with one row per key, splitting the keys that are hot in ``df``.

    ``size`` names the column of ``per_key`` with the number of rows of ``df``
    behind that key. The keys above ``hot_rows`` number at most
    ``rows / hot_rows``, so the list of them is small whatever the data, and is
    the only thing broadcast. Their rows get a salt and their one row of
    ``per_key`` is repeated once per salt. The other keys join as usual.
    """
    keys = list(keys)
    hot = per_key.where(F.col(size) > hot_rows).select(*keys, F.lit(True).alias("_hot"))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*df.columns), F.lit(salts))).otherwise(F.lit(0))
    left = (df.join(F.broadcast(hot), keys, "left")
            .withColumn("_salt", spread.cast("int")).drop("_hot"))
    copies = F.when(F.col(size) > hot_rows, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0)))
    right = per_key.withColumn("_salt", F.explode(copies))
    if not keep_size:
        right = right.drop(size)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def skewed_join(big: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner",
                hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """Equi join in which some keys may hold a large part of ``big``.

    Keys with more than ``hot_rows`` rows are found by a plain count (there are at
    most ``rows / hot_rows`` of them, which bounds the broadcast). Their rows in
    ``big`` are salted and their rows in ``other`` repeated once per salt. Both sides
    are shuffled whatever Spark takes their size for: it guesses from the files and
    leaves out how often a row was exploded, and would send such a table to every task.
    The number of tasks is the session's: few bytes may make many pairs, so they are not merged by size.
    """
    keys = list(keys)
    tasks = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
                      .where(F.col("_n") > hot_rows).select(*keys, F.lit(True).alias("_hot")))
    left = big.join(hot, keys, "left").withColumn("_salt", F.when(
        F.col("_hot"), F.pmod(F.xxhash64(*big.columns), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = other.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    left, right = (side.repartition(tasks, *keys, "_salt") for side in (left, right))
    return left.join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def first_rows(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: ``keys``, the smallest ``order`` value and the number of rows.

    A plain aggregate, so copies are combined before the shuffle; a window over
    the key would put every copy of a hot key in one task.
    """
    return df.groupBy(*keys).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_copies"))


def key_hash(columns: Sequence[str]) -> Column:
    """A 256-bit key for whole-row comparison in which NULL equals NULL."""
    texts = F.array(*[F.col(f"`{name}`").cast("string") for name in columns])
    # length prefix: ('ab','c') and ('a','bc') must differ; '-' marks NULL.
    # A lambda instead of an expression per column: with many columns their generated code grows past what a JVM compiles.
    parts = F.transform(texts, lambda text: F.coalesce(
        F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat_ws("|", parts), 256)


def one_row(df: DataFrame) -> Column:
    """A one-row table as a struct Column (a scalar subquery), usable beside any other table."""
    return df.select(F.struct("*").alias("row")).scalar()

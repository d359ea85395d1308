"""Connected components of a link table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.session import shared_table


def _ordered(links: DataFrame) -> DataFrame:
    return (links.where(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def component_roots(links: DataFrame) -> DataFrame:
    """``(a, b)``: every linked node that is not the smallest of its component, with that smallest node.

    Alternates two steps on links written as (larger, smaller): the smaller
    neighbours of a node are linked to the least of them, then every node is
    linked to the least neighbour of its neighbour. The rounds grow with the
    logarithm of the longest path. The second join has a hot key where a component
    is large; both its sides are plain tables, so adaptive execution splits it.
    Every step is a table in the shared folder, so a lost executor costs one step.
    """
    links = shared_table(_ordered(links), "links")
    state = _state(links)
    while True:
        least = shared_table(links.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = links.join(least, "a")
        starred = shared_table(_ordered(joined.select("a", F.col("m").alias("b")).union(
            joined.select(F.col("b").alias("a"), F.col("m").alias("b")))), "links")
        least = shared_table(starred.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m"), "least")
        links = shared_table(_ordered(starred.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))), "links")
        before, state = state, _state(links)
        if state == before:
            return links

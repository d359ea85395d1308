"""Spatial autocorrelation of a value per cell, with permutation tests as rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentgrid.operators.ranks import global_index
from rentgrid.operators.skew import one_row
from rentgrid.operators.spatial import weights
from rentgrid.operators.stats import bh_reject
from rentgrid.session import cut_lineage

SEED = 42
#: Rounds of a keyed permutation, and how often a place beyond the last goes through them again.
ROUNDS, WALKS = 6, 30
# --- fixed values: cluster labels ----------------------------------------------
QUADRANTS = {1: "Alto-Alto", 2: "Baixo-Alto", 3: "Baixo-Baixo", 4: "Alto-Baixo"}
NOT_SIGNIFICANT = "não significativo"


def standardised(cells: DataFrame, cell: str, value: str, edges: DataFrame) -> DataFrame:
    """``(cell, z)`` of the cells that have a neighbour: deviations from their mean."""
    linked = edges.select(F.col("src").alias(cell)).distinct()
    rows = cells.where(F.col(value).isNotNull()).join(linked, cell).select(cell, F.col(value).cast("double").alias("y"))
    mean = one_row(rows.agg(F.avg("y").alias("m")))["m"]
    return rows.select(cell, (F.col("y") - mean).alias("z"))


def spatial_lag(z: DataFrame, cell: str, edges: DataFrame) -> DataFrame:
    """``(cell, z, lag)``: the weighted mean of the neighbours beside the cell's own value."""
    near = edges.join(z.select(F.col(cell).alias("dst"), F.col("z").alias("zn")), "dst")
    lag = near.groupBy(F.col("src").alias(cell)).agg(F.sum(F.col("w") * F.col("zn")).alias("lag"))
    return z.join(lag, cell)


def prepared(cells: DataFrame, cell: str, value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The filled cells, their edges and their deviations, each written once.

    The tests read them many times; a cell table is the small end of the pipeline.
    """
    filled = cut_lineage(cells.where(F.col(value).isNotNull()).select(cell, value))
    edges = cut_lineage(weights(filled, cell))
    return filled, edges, cut_lineage(standardised(filled, cell, value, edges))


def moran(cells: DataFrame, cell: str, value: str) -> DataFrame:
    """One row: number of cells, islands left out, Moran's I and its expectation."""
    return _moran(*prepared(cells, cell, value), cell)


def _moran(filled: DataFrame, edges: DataFrame, z: DataFrame, cell: str) -> DataFrame:
    everything = one_row(filled.agg(F.count(F.lit(1)).alias("n")))["n"]
    stat = spatial_lag(z, cell, edges).agg(
        F.count(F.lit(1)).alias("n_cells"),
        (F.sum(F.col("z") * F.col("lag")) / F.sum(F.col("z") * F.col("z"))).alias("I"))
    return stat.select("n_cells", (everything - F.col("n_cells")).alias("islands"), "I",
                       (-1.0 / (F.col("n_cells") - 1)).alias("expected"))


def permuted_places(df: DataFrame, idx: str, perm: str, n: int, seed: int = SEED, name: str = "at") -> DataFrame:
    """Add the place of ``idx`` (0 to n - 1) in permutation ``perm``: every place is taken once.

    The index is a pair of digits, and each round shifts one digit by a hash of the
    other, which can be undone, so the whole is a bijection of ``high * low >= n``
    pairs. A place beyond n goes through the rounds again until it falls below n.
    At most ``high * low - n`` places lie beyond, so small tables are sure to end within
    ``WALKS``; in larger ones a walk goes on with a chance of under 1/30 each time,
    and one that did not end would raise an error, not give a wrong place.
    """
    high = max(1, math.isqrt(max(n - 1, 0)) + 1)
    low = max(1, -(-n // high))

    def shift(digit: Column, other: Column, step: int, base: int) -> Column:
        return F.pmod(digit + F.pmod(F.xxhash64(other, F.col(perm), F.lit(step), F.lit(seed)), F.lit(base)), F.lit(base))

    def digits(x: Column) -> tuple[Column, Column]:
        return F.floor(x / F.lit(low)).cast("long"), x % low

    def shuffled(x: Column) -> Column:
        first, second = digits(x)
        for step in range(ROUNDS):
            if step % 2:
                second = shift(second, first, step, low)
            else:
                first = shift(first, second, step, high)
        return first * low + second

    first, second = digits(F.col(idx))
    out = df.withColumns({"_first": first, "_second": second})
    for step in range(ROUNDS):                                    # a column per round, so that none is computed twice
        out = (out.withColumn("_second", shift(F.col("_second"), F.col("_first"), step, low)) if step % 2
               else out.withColumn("_first", shift(F.col("_first"), F.col("_second"), step, high)))
    out = out.withColumn("_once", F.col("_first") * low + F.col("_second"))
    again = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.col("_once"),
                        lambda at, _: F.when(at < n, at).otherwise(shuffled(at)))
    out = out.withColumn("_walked", F.when(F.col("_once") < n, F.col("_once")).otherwise(again))
    lost = F.raise_error(F.lit("a permuted place was not found")).cast("long")
    return out.withColumn(name, F.when(F.col("_walked") < n, F.col("_walked")).otherwise(lost)).drop(
        "_first", "_second", "_once", "_walked")


def moran_permutations(edges: DataFrame, z: DataFrame, cell: str, permutations: int = 999, seed: int = SEED) -> DataFrame:
    """``(perm, I)`` under random relabelling.

    Cells are numbered once; a keyed permutation of these numbers says which cell gets
    the value of which, so nothing is ordered per permutation and the draw is the
    same on any cluster. Tasks share the permutations among them.
    """
    placed = cut_lineage(global_index(z, F.xxhash64(F.col(cell), F.lit(seed))).select(cell, "z", "idx"))
    n = placed.count()
    copies = placed.select("z", "idx", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("perm"))
    drawn = permuted_places(copies, "idx", "perm", n, seed).select("perm", "z", "at")
    # neighbours by place: the edges carry the index of both ends
    place = placed.select(F.col(cell).alias("c"), "idx")
    numbered = (edges.join(place.select(F.col("c").alias("src"), F.col("idx").alias("i")), "src")
                .join(place.select(F.col("c").alias("dst"), F.col("idx").alias("j")), "dst").select("i", "j", "w"))
    lag = drawn.join(numbered, drawn["at"] == numbered["j"]).groupBy("perm", F.col("i").alias("at")).agg(
        F.sum(F.col("w") * F.col("z")).alias("lag"))
    total = one_row(z.agg(F.sum(F.col("z") * F.col("z")).alias("t")))["t"]
    sums = drawn.join(lag, ["perm", "at"]).groupBy("perm").agg(F.sum(F.col("z") * F.col("lag")).alias("c"))
    return sums.select("perm", (F.col("c") / total).alias("I"))


def moran_test(cells: DataFrame, cell: str, value: str, permutations: int = 999, seed: int = SEED) -> DataFrame:
    """Moran's I with its permutation z, the folded pseudo p and the two-sided p."""
    filled, edges, z = prepared(cells, cell, value)
    stat = _moran(filled, edges, z, cell)
    drawn = cut_lineage(moran_permutations(edges, z, cell, permutations, seed))
    joined = stat.withColumn("_k", F.lit(1)).join(
        drawn.select(F.col("I").alias("sim"), F.lit(1).alias("_k")), "_k")
    keys = stat.columns
    tails = joined.groupBy(*keys).agg(
        F.count_if(F.col("sim") >= F.col("I")).alias("larger"), F.count(F.lit(1)).alias("permutations"),
        F.avg("sim").alias("mean"), F.stddev_pop("sim").alias("sd"))
    n = F.col("permutations")
    p = (F.least(F.col("larger"), n - F.col("larger")) + 1) / (n + 1)
    return tails.select(*keys, ((F.col("I") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd"))).alias("z"),
                        p.alias("p_pseudo"), F.least(F.lit(1.0), 2 * p).alias("p_two_sided"), "permutations")


def local_moran(cells: DataFrame, cell: str, value: str) -> DataFrame:
    """``(cell, z, lag, I_local, quadrant)``."""
    _, edges, z = prepared(cells, cell, value)
    return _local(edges, z, cell)


def _local(edges: DataFrame, z: DataFrame, cell: str) -> DataFrame:
    s = one_row(z.agg(F.sum(F.col("z") * F.col("z")).alias("ss"), F.count(F.lit(1)).alias("n")))
    high, near_high = F.col("z") > 0, F.col("lag") > 0
    quadrant = (F.when(high & near_high, 1).when(~high & near_high, 2).when(~high & ~near_high, 3).otherwise(4))
    return spatial_lag(z, cell, edges).select(
        cell, "z", "lag", ((s["n"] - 1) * F.col("z") * F.col("lag") / s["ss"]).alias("I_local"),
        quadrant.alias("quadrant"))


def lisa(cells: DataFrame, cell: str, value: str, alpha: float = 0.05, permutations: int = 999,
         seed: int = SEED) -> DataFrame:
    """Local Moran with conditional permutation, two-sided p, FDR and cluster label.

    A permutation draws six other cells, without repetition; a cell with k
    neighbours uses the first k. The drawn values are the only thing given to every
    task: ``permutations x 7`` numbers, whatever the number of cells.
    """
    _, edges, z = prepared(cells, cell, value)
    degree = edges.groupBy(F.col("src").alias(cell)).agg(F.count(F.lit(1)).alias("k"))
    local = cut_lineage(_local(edges, z, cell).join(degree, cell))
    placed = cut_lineage(global_index(local, F.xxhash64(F.col(cell), F.lit(seed))))
    n = local.count()
    if n < 2:
        raise ValueError("a local test needs cells with neighbours")
    rng = np.random.default_rng(seed)
    # seven distinct places each, one more than a cell can need: its own place is skipped
    width = min(7, n)
    draws = np.stack([rng.choice(n, size=width, replace=False) for _ in range(permutations)])
    wanted = sorted({int(i) for i in draws.ravel()})
    spark = cells.sparkSession
    places = spark.createDataFrame([(i,) for i in wanted], "at long")
    # at most 7 x permutations values come back
    found = {r["at"]: r["z"] for r in placed.select("idx", "z").join(
        F.broadcast(places), F.col("idx") == F.col("at")).select("at", "z").collect()}
    values = np.vectorize(found.__getitem__)(draws)
    prefix = np.cumsum(values, axis=1)
    sums = [np.sort(prefix[:, k] / (k + 1)) for k in range(width)]
    hits: dict[int, list[tuple[int, int]]] = {}               # place -> the draws that hold it
    for (draw, position), place in np.ndenumerate(draws):
        hits.setdefault(int(place), []).append((draw, position))
    shared = spark.sparkContext.broadcast((values, sums, hits))

    @F.pandas_udf("double")
    def p_value(idx: pd.Series, z: pd.Series, lag: pd.Series, k: pd.Series) -> pd.Series:
        drawn, ordered, held = shared.value
        at, own, near, degree = (c.to_numpy() for c in (idx, z, lag, k))
        n_draws = len(drawn)
        larger = np.full(len(at), n_draws)                     # a zero is never smaller than a zero
        for d in np.unique(degree):
            line = ordered[d - 1]
            up, down = (degree == d) & (own > 0), (degree == d) & (own < 0)
            larger[up] = n_draws - line.searchsorted(near[up], side="left")
            larger[down] = line.searchsorted(near[down], side="right")
        for j in [j for j, i in enumerate(at) if int(i) in held]:
            d = degree[j]
            for draw, position in held[int(at[j])]:
                if position < d:                               # the cell itself gives way to the spare draw
                    took = drawn[draw, :d].mean()
                    instead = np.delete(drawn[draw], position)[:d].sum() / d
                    larger[j] += int(own[j] * instead >= own[j] * near[j]) - int(own[j] * took >= own[j] * near[j])
        larger = np.minimum(larger, n_draws - larger)
        return pd.Series((larger + 1) / (n_draws + 1))

    tested = cut_lineage(placed.withColumn("p", F.least(F.lit(1.0), 2 * p_value("idx", "z", "lag", "k"))))
    judged = bh_reject(tested, "p", alpha, "significant")
    names = F.create_map(*[F.lit(x) for kv in QUADRANTS.items() for x in kv])
    return judged.select(cell, "I_local", "p", "significant", F.when(
        F.col("significant"), names[F.col("quadrant")]).otherwise(NOT_SIGNIFICANT).alias("cluster"))

"""Rank tests, effect sizes, multiple testing and distribution shift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.functions import tails
from rentgrid.operators.panel import weighted_ranks
from rentgrid.operators.ranks import medians, quantiles, running_totals, splitters, with_bucket
from rentgrid.operators.skew import attach_per_key, one_row
from rentgrid.session import cut_lineage

#: Groups that one task of a pairwise test compares with all others.
SLICE = 256
#: Numbers in one table of values by groups inside such a task.
CHUNK_CELLS = 2_000_000


def chi2_tail(x: Column, dof: Column) -> Column:
    """Upper chi-squared tail; applied to result tables with one row per test."""
    @F.pandas_udf("double")
    def tail(h: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([tails.chi2_sf(a, int(b)) for a, b in zip(h, k)])
    return tail(x, dof)


def normal_tail(z: Column) -> Column:
    @F.pandas_udf("double")
    def tail(s: pd.Series) -> pd.Series:
        return s.map(tails.normal_sf)
    return tail(z)


def kruskal(df: DataFrame, value: str, group: str, p_value: bool = True) -> DataFrame:
    """Kruskal-Wallis H with tie correction, its p and the effect size epsilon squared."""
    pairs = (df.select(F.col(value).cast("double").alias("v"), F.col(group).alias("g")).dropna()
             .groupBy("v", "g").agg(F.count(F.lit(1)).alias("w")))
    ranks = weighted_ranks(pairs, "v", "w").select("v", "c", "rank", "pairs")
    per_group = attach_per_key(pairs, ranks.drop("c"), ["v"], "pairs").groupBy("g").agg(
        F.sum("w").cast("double").alias("n"), F.sum(F.col("w") * F.col("rank")).alias("rank_sum"))
    c = F.col("c").cast("double")
    ties = one_row(ranks.agg(F.sum(c * c * c - c).alias("t")))["t"]
    sums = per_group.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
                         F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - ties / (n * n * n - n))
    out = sums.select(h.alias("H"), n.cast("long").alias("n"), "k",
                      (h * (n + 1) / (n * n - 1)).alias("epsilon2"))
    return out.withColumn("p", chi2_tail(F.col("H"), F.col("k") - 1)) if p_value else out


def _pair_sums(key: tuple, entries: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    """U and tie products of one bucket of values, for the groups ``mine`` against all later ones.

    ``starts`` holds, for every group, its rows below the bucket. Values are taken in
    chunks, so that the tables of values by groups stay within ``CHUNK_CELLS`` numbers.
    """
    del key
    if not len(entries) or not entries["mine"].any():
        return pd.DataFrame()
    starts, entries = starts.sort_values("name"), entries.sort_values("v", kind="stable")
    groups = pd.Index(starts["name"], dtype=object)
    place = groups.get_indexer(entries["g"])
    at = np.unique(entries["v"].to_numpy(), return_inverse=True)[1]
    weight = entries["w"].to_numpy(dtype=float)
    mine = np.unique(place[entries["mine"].to_numpy(dtype=bool)])
    below = starts["before"].to_numpy(dtype=float)
    u, t = np.zeros((len(mine), len(groups))), np.zeros((len(mine), len(groups)))
    step = max(1, CHUNK_CELLS // len(groups))
    for low in range(0, int(at[-1]) + 1, step):
        first, last = np.searchsorted(at, [low, low + step])
        counts = np.zeros((int(at[last - 1]) - low + 1, len(groups)))
        counts[at[first:last] - low, place[first:last]] = weight[first:last]
        own = counts[:, mine].T
        # rows of equal value count by half; the running total has them whole
        u += own @ (below + np.cumsum(counts, axis=0) - counts / 2)
        t += (own * own) @ counts + own @ (counts * counts)
        below = below + counts.sum(axis=0)
    row, col = np.nonzero(np.arange(len(groups)) > mine[:, None])
    if not len(row):
        return pd.DataFrame()
    return pd.DataFrame({"a": groups.take(mine[row]), "b": groups.take(col), "U": u[row, col], "t": t[row, col]})


def mann_whitney_pairs(df: DataFrame, value: str, group: str, p_value: bool = True) -> DataFrame:
    """U, rank-biserial correlation, medians and Holm-adjusted p for every pair of groups.

    Any number of groups: rows are counted per value and group, values are dealt into
    buckets, and a task takes one bucket and ``SLICE`` groups against all others,
    starting from the running totals of every group below the bucket. No row is
    copied per pair and no group becomes a column; the result has a row per pair.
    NULL and NaN values and NULL groups take no part. Fewer than two groups: no rows.
    Two groups that together hold one value only have no z, and a p of 1.
    """
    rows = df.select(F.col(value).cast("double").alias("v"), F.col(group).alias("g")).dropna()
    splits = splitters(rows, "v")
    counts = cut_lineage(with_bucket(rows.groupBy("v", "g").agg(F.count(F.lit(1)).alias("w")), "v", splits, "bucket"))
    w = F.col("w").cast("double")
    per_group = counts.groupBy("g").agg(F.sum(w).alias("n"), F.sum(w * w * w - w).alias("own"))
    per_group = cut_lineage(per_group)
    slices = max(1, -(-per_group.count() // SLICE))
    each = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    entries = counts.select("bucket", "v", "g", "w", each.alias("slice")).withColumn(
        "mine", F.pmod(F.xxhash64("g"), F.lit(slices)) == F.col("slice"))
    # every group has a total below every bucket, also where it has no value in it
    places = per_group.select("g", F.explode(F.sequence(F.lit(0), F.lit(max(1, len(splits))))).alias("bucket"))
    totals = counts.groupBy("g", "bucket").agg(F.sum("w").alias("w"))
    below = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = places.join(totals, ["g", "bucket"], "left").select(
        F.col("g").alias("name"), F.col("bucket").alias("at"), F.coalesce(F.sum("w").over(below), F.lit(0)).alias("before")).select(
            "name", "at", "before", each.alias("part"))
    kind = rows.schema["g"].dataType.simpleString()
    parts = entries.groupBy("bucket", "slice").cogroup(starts.groupBy("at", "part")).applyInPandas(
        _pair_sums, f"a {kind}, b {kind}, U double, t double")
    pairs = parts.groupBy("a", "b").agg(F.sum("U").alias("U"), F.sum("t").alias("t"))
    middle = medians(rows, ["g"], {"m": F.col("v")})
    known = per_group.join(middle, "g")

    def side(name: str) -> DataFrame:
        return known.select(F.col("g").alias(name), F.col("n").alias(f"n_{name}"), F.col("own").alias(f"own_{name}"),
                            F.col("m").alias(f"median_{name}"))

    tests = pairs.join(side("a"), "a").join(side("b"), "b")
    na, nb = F.col("n_a"), F.col("n_b")
    n = na + nb
    # (a+b)^3 - (a+b) summed over values
    ties = F.col("own_a") + F.col("own_b") + 3 * F.col("t")
    spread = F.sqrt(na * nb / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = F.when(spread > 0, (F.greatest(F.col("U"), na * nb - F.col("U")) - na * nb / 2 - 0.5) / F.nullif(spread, F.lit(0.0)))
    tests = tests.select("a", "b", "U", (2 * F.col("U") / (na * nb) - 1).alias("rank_biserial"),
                         "median_a", "median_b", z.alias("z"))
    if not p_value:
        return tests
    return holm(tests.withColumn("p", F.least(F.lit(1.0), 2 * normal_tail(F.col("z")))), "p")


def holm(tests: DataFrame, p: str, by: Sequence[str] = (), name: str = "p_holm") -> DataFrame:
    """Step-down adjustment of a table with one row per test (a window over tests, not data)."""
    family = Window.partitionBy(*by)
    order = family.orderBy(p)
    left = F.count(p).over(family) - F.row_number().over(order) + 1
    stepped = tests.withColumn("_adj", F.least(F.lit(1.0), left * F.col(p)))
    return stepped.withColumn(name, F.max("_adj").over(
        order.rowsBetween(Window.unboundedPreceding, 0))).drop("_adj")


def bh_reject(df: DataFrame, p: str, alpha: float, name: str = "reject") -> DataFrame:
    """Benjamini-Hochberg: reject every p up to the largest one below its own line.

    Equal p-values share the largest rank among them, so value counts decide the
    cut; no row needs its own place in a global order.
    """
    rows = df.select(F.col(p).alias("_p")).dropna()
    counts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("c"))
    ranked = running_totals(counts, [], "_p", ["c"], splitters(rows, "_p"))
    below = F.col("_p") <= F.lit(float(alpha)) * (F.col("c_before") + F.col("c")) / F.col("c_total")
    cut = one_row(ranked.agg(F.max(F.when(below, F.col("_p"))).alias("cut")))["cut"]
    return df.withColumn(name, F.coalesce(F.col(p) <= cut, F.lit(False)))


def _variance_parts(df: DataFrame, values: Sequence[str], group: str) -> DataFrame:
    rows = df.where(F.col(group).isNotNull())
    return rows.groupBy(group).agg(*[e for i, v in enumerate(values) for e in (
        F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"v{i}"))])


def redundancy(df: DataFrame, values: Sequence[str], group: str, min_n: int = 0) -> DataFrame:
    """Eta squared of several columns by one grouping, from a single pass over the rows."""
    parts = _variance_parts(df, values, group)
    means = parts.agg(*[(F.sum(F.col(f"n{i}") * F.col(f"m{i}")) / F.sum(f"n{i}")).alias(f"g{i}")
                        for i in range(len(values))])
    joined = parts.withColumn("_g", one_row(means))
    sums = joined.agg(*[e for i in range(len(values)) for e in (
        F.sum(f"n{i}").alias(f"n{i}"),
        F.sum(F.col(f"n{i}") * F.pow(F.col(f"m{i}") - F.col(f"_g.g{i}"), 2)).alias(f"b{i}"),
        F.sum(F.col(f"n{i}") * F.col(f"v{i}")).alias(f"w{i}"))])
    rows = F.array(*[F.struct(
        F.lit(v).alias("value"), F.col(f"n{i}").alias("n"),
        F.when(F.col(f"b{i}") + F.col(f"w{i}") > 0,
               F.col(f"b{i}") / (F.col(f"b{i}") + F.col(f"w{i}"))).alias("eta2"))
        for i, v in enumerate(values)])
    return sums.select(F.explode(rows).alias("r")).select("r.*").where(F.col("n") > min_n)


def eta2(df: DataFrame, value: str, group: str) -> DataFrame:
    """Share of the variance explained by the group means."""
    return redundancy(df, [value], group)


def variance_table(df: DataFrame, value: str, groups: Mapping[str, str],
                   predictions: Mapping[str, str] = {}) -> DataFrame:
    """Variance explained by each grouping beside the R squared of each prediction."""
    out = None
    for label, g in groups.items():
        row = eta2(df, value, g).select(F.lit(label).alias("source"), F.lit("eta2").alias("kind"),
                                        F.col("eta2").alias("explained"))
        out = row if out is None else out.unionByName(row)
    for label, p in predictions.items():
        rows = df.where(F.col(p).isNotNull() & F.col(value).isNotNull())
        total = F.var_pop(value)
        row = rows.agg(F.when(total > 0, 1 - F.avg(F.pow(F.col(value) - F.col(p), 2)) / total).alias("explained"))
        row = row.select(F.lit(label).alias("source"), F.lit("r2").alias("kind"), "explained")
        out = row if out is None else out.unionByName(row)
    return out


# --- distribution shift --------------------------------------------------------------

def inner_edges(df: DataFrame, columns: Sequence[str], bins: int, suffix: str = "") -> DataFrame:
    """One row with, per column, its sorted distinct quantile edges (outer ones included)."""
    names = {f"q{i:03d}": i / bins for i in range(bins + 1)}
    q = quantiles(df, [], {f"m{j}": F.col(c) for j, c in enumerate(columns)}, names)
    return q.select(*[F.array_sort(F.array_distinct(F.filter(
        F.array(*[F.col(f"m{j}_{n}") for n in names]), lambda x: x.isNotNull()))).alias(f"e{j}{suffix}")
        for j in range(len(columns))])


def psi_table(a: DataFrame, b: DataFrame, columns: Sequence[str], bins: int = 10,
              floor: float = 1e-4) -> DataFrame:
    """Population stability index of every column, with bins from the quantiles of ``a``.

    The outer bins are open, empty bins count as ``floor``; a column with fewer than
    three distinct edges, or without values on a side, gets NULL.
    """
    def clean(df: DataFrame) -> DataFrame:
        cols = [F.col(c).cast("double") for c in columns]
        return df.select(*[F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x).alias(c)
                           for c, x in zip(columns, cols)])
    left, right = clean(a), clean(b)
    edges = one_row(inner_edges(left, columns, bins))
    both = (left.withColumn("_a", F.lit(True)).unionByName(right.withColumn("_a", F.lit(False)))
            .withColumn("_e", edges))

    def place(j: int, c: str) -> Column:
        e = F.col(f"_e.e{j}")
        inside = F.slice(e, F.lit(2), F.greatest(F.size(e) - 2, F.lit(0)))
        return F.when(F.col(c).isNotNull(), F.size(F.filter(inside, lambda x: x <= F.col(c))))

    placed = both.select("_a", *[place(j, c).alias(f"b{j}") for j, c in enumerate(columns)])
    counts = placed.agg(*[F.count_if(side & (F.col(f"b{j}") == i)).alias(f"{s}{j}_{i}")
                          for j in range(len(columns)) for i in range(bins)
                          for s, side in (("a", F.col("_a")), ("b", ~F.col("_a")))])
    wide = counts.withColumn("_e", edges)

    def index(j: int) -> Column:
        na = F.array(*[F.col(f"a{j}_{i}") for i in range(bins)])
        nb = F.array(*[F.col(f"b{j}_{i}") for i in range(bins)])
        ta, tb = F.aggregate(na, F.lit(0).cast("long"), lambda x, y: x + y), F.aggregate(
            nb, F.lit(0).cast("long"), lambda x, y: x + y)
        used = F.size(F.col(f"_e.e{j}")) - 1
        shares = F.slice(F.arrays_zip(na.alias("x"), nb.alias("y")), F.lit(1), F.greatest(used, F.lit(1)))

        def term(z: Column) -> Column:
            pa = F.greatest(z["x"] / ta, F.lit(floor))
            pb = F.greatest(z["y"] / tb, F.lit(floor))
            return (pb - pa) * F.log(pb / pa)

        total = F.aggregate(shares, F.lit(0.0), lambda acc, z: acc + term(z))
        return F.when((used >= 2) & (ta > 0) & (tb > 0), total)

    rows = F.array(*[F.struct(F.lit(c).alias("column"), index(j).alias("psi"))
                     for j, c in enumerate(columns)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def quantile_bins(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """0-based equal-frequency bin, right-closed, with repeated edges merged."""
    e = F.col("_e.e0")
    inside = F.slice(e, F.lit(2), F.greatest(F.size(e) - 2, F.lit(0)))
    place = F.when(F.col(value).isNotNull(), F.size(F.filter(inside, lambda x: x < F.col(value))))
    return df.withColumn("_e", one_row(inner_edges(df, [value], bins))).withColumn(name, place).drop("_e")


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Mean prediction, observed rate and size per bin of the prediction."""
    return quantile_bins(df, p, bins).where("bin IS NOT NULL").groupBy("bin").agg(
        F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"),
        F.count(F.lit(1)).alias("n"))

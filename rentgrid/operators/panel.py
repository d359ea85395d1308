"""Comparison of two snapshots: levels, composition, renewal and concentration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.functions import constants as K
from rentgrid.functions.scalars import bucket, nullsafe_close
from rentgrid.operators.ranks import median_interval, medians, running_totals, splitters, top_share
from rentgrid.operators.skew import attach_per_key, one_row

MIN_PER_CELL = 5


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def pct_change(new: Column, old: Column) -> Column:
    return F.when(old != 0, 100 * (new / old - 1))


# --- levels ----------------------------------------------------------------------

def kpis(df: DataFrame, snapshot: str, host: str, shares: Mapping[str, Column], valid: Column,
         price_medians: Mapping[str, Column], top_fraction: float = 0.01) -> DataFrame:
    """One row per snapshot: counts, shares, owner concentration and median prices.

    ``price_medians`` are taken over the rows with a ``valid`` price only.
    """
    plain = df.groupBy(snapshot).agg(
        F.count(F.lit(1)).alias("listings"), F.count_if(valid).alias("priced"),
        *[share(c).alias(name) for name, c in shares.items()])
    owners = top_share(df, [snapshot], host, top_fraction).withColumnsRenamed(
        {"owners": "hosts", "top_share": "top_host_share"})
    levels = medians(df.where(valid), [snapshot], price_medians)
    return plain.join(owners, snapshot, "left").join(levels, snapshot, "left")


def concentration(df: DataFrame, snapshot: str, host: str,
                  bands: tuple[Sequence, Sequence[str]] = K.HOST_BANDS) -> DataFrame:
    """Hosts and share of listings per size band; empty bands stay with zero."""
    edges, labels = bands
    sizes = (df.where(F.col(host).isNotNull()).groupBy(snapshot, host)
             .agg(F.count(F.lit(1)).alias("size")))
    banded = sizes.groupBy(snapshot).agg(
        F.sum("size").alias("_all"),
        *[F.count_if(bucket("size", edges, labels) == b).alias(f"h{i}") for i, b in enumerate(labels)],
        *[F.sum(F.when(bucket("size", edges, labels) == b, F.col("size")).otherwise(0)).alias(f"l{i}")
          for i, b in enumerate(labels)])
    rows = F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"h{i}").alias("hosts"),
                              (F.col(f"l{i}") / F.col("_all")).alias("listing_share"))
                     for i, b in enumerate(labels)])
    return banded.select(snapshot, F.explode(rows).alias("r")).select(snapshot, "r.*")


def multi_host(df: DataFrame, snapshot: str, host: str) -> DataFrame:
    """Share of listings with a multi-listing host beside the share of such hosts."""
    sizes = df.groupBy(snapshot, host).agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy(snapshot).agg(
        (F.sum(F.when(F.col("size") > 1, F.col("size")).otherwise(0)) / F.sum("size")).alias("listing_share"),
        share(F.col("size") > 1).alias("host_share"))


def effective_supply(df: DataFrame, snapshot: str, occupancy: str, periods: tuple[str, str]) -> DataFrame:
    """Occupied listing-years per snapshot and their change."""
    a, b = periods
    out = df.agg(*[F.sum(F.when(F.col(snapshot) == s, F.col(occupancy))).alias(f"supply_{n}")
                   for n, s in (("a", a), ("b", b))])
    return out.withColumn("change_pct", pct_change(F.col("supply_b"), F.col("supply_a")))


def stratum_prices(df: DataFrame, strata: Sequence[str], snapshot: str, periods: tuple[str, str],
                   price: str, level: float = 0.95) -> DataFrame:
    """Median, interval and size per stratum in both snapshots, and the change."""
    long = median_interval(df, [*strata, snapshot], price, level)
    picks = [F.max(F.when(F.col(snapshot) == s, F.col(c))).alias(f"{c}_{n}")
             for n, s in zip("ab", periods) for c in ("n", "median", "ci_low", "ci_high")]
    wide = long.groupBy(*strata).agg(*picks).fillna(0, ["n_a", "n_b"])
    return wide.withColumn("change_pct", pct_change(F.col("median_b"), F.col("median_a")))


def compare_by(df: DataFrame, keys: Sequence[str], snapshot: str, periods: tuple[str, str], price: str,
               valid: Column, flags: Mapping[str, Column], min_n: int = 0) -> DataFrame:
    """Counts, change, median price and shares per group; small groups in both are left out."""
    named = {n: F.col(snapshot) == s for n, s in zip("ab", periods)}
    groups = df.dropna(subset=list(keys))
    counts = groups.groupBy(*keys).agg(
        *[F.count_if(c).alias(f"n_{n}") for n, c in named.items()],
        *[F.avg(F.when(c, f.cast("double"))).alias(f"{name}_{n}")
          for name, f in flags.items() for n, c in named.items()])
    levels = medians(groups.where(valid), keys,
                     {f"price_{n}": F.when(c, F.col(price)) for n, c in named.items()})
    out = counts.where(F.greatest("n_a", "n_b") >= min_n).join(levels, list(keys), "left")
    return out.withColumn("change_pct", pct_change(F.col("n_b"), F.col("n_a")))


def compare_cells(df: DataFrame, cell: str, snapshot: str, periods: tuple[str, str], price: str,
                  valid: Column, flags: Mapping[str, Column], min_n: int = MIN_PER_CELL) -> DataFrame:
    """Per-cell comparison; every metric is suppressed by its own number of rows."""
    named = {n: F.col(snapshot) == s for n, s in zip("ab", periods)}
    counts = df.groupBy(cell).agg(
        *[F.count_if(c).alias(f"n_{n}") for n, c in named.items()],
        *[F.count_if(c & valid & F.col(price).isNotNull()).alias(f"_p_{n}") for n, c in named.items()],
        *[F.avg(F.when(c, f.cast("double"))).alias(f"{name}_{n}")
          for name, f in flags.items() for n, c in named.items()])
    levels = medians(df.where(valid), [cell], {f"price_{n}": F.when(c, F.col(price))
                                               for n, c in named.items()})
    joined = counts.join(levels, cell, "left")

    def enough(n: str, c: str) -> Column:
        return F.when(F.col(n) >= min_n, F.col(c))

    out = joined.select(
        cell, "n_a", "n_b",
        F.when(F.col("n_a") >= min_n, pct_change(F.col("n_b"), F.col("n_a"))).alias("change_pct"),
        *[enough(f"_p_{n}", f"price_{n}").alias(f"price_{n}") for n in "ab"],
        *[enough(f"n_{n}", f"{name}_{n}").alias(f"{name}_{n}") for name in flags for n in "ab"])
    return out.withColumn("price_change_pct", pct_change(F.col("price_b"), F.col("price_a")))


def cell_stat(df: DataFrame, cell: str, value: str, stat: str = "median", min_n: int = MIN_PER_CELL) -> DataFrame:
    """``(cell, n, value)`` for cells with at least ``min_n`` rows."""
    rows = df.where(F.col(cell).isNotNull())
    size = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("_mean"))
    size = size.where(F.col("n") >= min_n)
    if stat == "mean":
        return size.withColumnRenamed("_mean", value)
    return size.drop("_mean").join(medians(rows, [cell], {value: F.col(value)}), cell, "left")


# --- composition --------------------------------------------------------------------

def shift_share(df: DataFrame, strata: Sequence[str], snapshot: str, periods: tuple[str, str],
                value: Column) -> DataFrame:
    """One row per stratum with its weights, means and part of the change.

    A stratum seen in one snapshot only is listed with ``complete = false`` and has
    no weight. Summing ``composition`` and ``within`` gives the total change.
    """
    a, b = (F.col(snapshot) == p for p in periods)
    v = value
    cells = df.where(v.isNotNull()).groupBy(*strata).agg(
        F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"),
        F.avg(F.when(a, v)).alias("mean_a"), F.avg(F.when(b, v)).alias("mean_b"))
    cells = cells.withColumn("complete", (F.col("n_a") > 0) & (F.col("n_b") > 0))
    totals = cells.where("complete").agg(F.sum("n_a").alias("_ta"), F.sum("n_b").alias("_tb"))
    out = cells.withColumn("_t", one_row(totals)).select(
        *strata, "n_a", "n_b", "mean_a", "mean_b", "complete",
        F.when(F.col("complete"), F.col("n_a") / F.col("_t._ta")).alias("weight_a"),
        F.when(F.col("complete"), F.col("n_b") / F.col("_t._tb")).alias("weight_b"))
    return out.select(
        "*", ((F.col("weight_b") - F.col("weight_a")) * F.col("mean_a")).alias("composition"),
        (F.col("weight_b") * (F.col("mean_b") - F.col("mean_a"))).alias("within"),
        F.when(F.col("complete"), 100 * (F.exp(F.col("mean_b") - F.col("mean_a")) - 1)).alias("change_pct"))


def shift_share_total(parts: DataFrame) -> DataFrame:
    """Composition, within-stratum and total change of the mean, from ``shift_share``."""
    sums = parts.agg(F.sum("composition").alias("composition"), F.sum("within").alias("within"),
                     F.count_if(~F.col("complete")).alias("strata_left_out"))
    total = F.col("composition") + F.col("within")
    return sums.select("composition", "within", total.alias("total"),
                       (100 * (F.exp(total) - 1)).alias("change_pct"),
                       F.when(total != 0, F.col("composition") / total).alias("composition_share"),
                       "strata_left_out")


def share_within(df: DataFrame, by: Sequence[str], count: str, name: str = "share") -> DataFrame:
    """Share of ``count`` within a group, by joining the group totals back."""
    totals = df.groupBy(*by).agg(F.sum(count).alias("_total"))
    return (df.join(totals, list(by), "left")
            .withColumn(name, F.col(count) / F.col("_total")).drop("_total"))


def group_mean(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Mean of the group beside every row; hot groups are split over tasks."""
    means = df.groupBy(*by).agg(F.avg(value).alias(name), F.count(F.lit(1)).alias("_rows"))
    return attach_per_key(df, means, list(by), "_rows").drop("_rows")


# --- membership ---------------------------------------------------------------------

def flag_member(df: DataFrame, keys: DataFrame, column: str, name: str) -> DataFrame:
    """True where ``column`` occurs in ``keys`` (first column); NULL is no member."""
    first = keys.columns[0]
    known = keys.select(F.col(first).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    joined = df.join(known, F.col(column) == F.col("_k"), "left")
    return joined.withColumn(name, F.col("_k").isNotNull()).drop("_k")


def renewal(b: DataFrame, known_keys: DataFrame, known_hosts: DataFrame, key: str, host: str) -> DataFrame:
    """Listings of the second snapshot by origin: survived, new from a known host, new host."""
    tagged = flag_member(flag_member(b, known_keys, key, "_old"), known_hosts, host, "_known")
    origin = (F.when(F.col("_old"), "survived").when(F.col("_known"), "new_known_host")
              .otherwise("new_host"))
    counts = tagged.groupBy(origin.alias("origin")).agg(F.count(F.lit(1)).alias("n"))
    return with_share_pct(counts, "n", "pct")


def with_share_pct(counts: DataFrame, count: str, name: str) -> DataFrame:
    """Each row's percentage of the whole column."""
    total = one_row(counts.agg(F.sum(count).alias("t")))["t"]
    return counts.select("*", (100 * F.col(count) / total).alias(name))


def staying_hosts(a: DataFrame, b: DataFrame, host: str) -> DataFrame:
    hosts = a.select(host).where(F.col(host).isNotNull()).distinct()
    tagged = flag_member(hosts, b.select(host), host, "_stays")
    return tagged.agg(F.count_if("_stays").alias("n"), F.count(F.lit(1)).alias("of"),
                      (100 * F.avg(F.col("_stays").cast("double"))).alias("pct"))


def key_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def key_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b.distinct(), a.columns, "left_anti")


def ids_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def stack_snapshots(a: DataFrame, b: DataFrame, columns: Sequence[str],
                    rename_b: Mapping[str, str] | None = None) -> DataFrame:
    return a.select(*columns).unionByName(b.withColumnsRenamed(dict(rename_b or {})).select(*columns))


def column_agreement(a: DataFrame, b: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """Share of equal values per column over the ids both tables have.

    ``columns`` maps a column of ``a`` to the column of ``b``. Doubles agree within
    tolerance, everything else must be equal; two NULLs agree.
    """
    left = a.select(key, *[F.col(x).alias(f"l{i}") for i, x in enumerate(columns)])
    right = b.select(key, *[F.col(y).alias(f"r{i}") for i, y in enumerate(columns.values())])
    types = dict(a.dtypes)

    def same(i: int, name: str) -> Column:
        if types[name] in ("double", "float") or types[name].startswith("decimal"):
            return nullsafe_close(f"l{i}", f"r{i}")
        return F.col(f"l{i}").eqNullSafe(F.col(f"r{i}"))

    stats = left.join(right, key).agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(same(i, x)).alias(f"e{i}") for i, x in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(x).alias("column"), F.col("n"), F.col(f"e{i}").alias("equal"),
                              F.try_divide(F.col(f"e{i}"), F.col("n")).alias("share"))
                     for i, x in enumerate(columns)])
    return stats.select(F.explode(rows).alias("r")).select("r.*")


def merge_cells(tables: Sequence[DataFrame], cell: str) -> DataFrame:
    """Outer join of per-cell tables; a repeated column keeps its first definition."""
    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        new = [c for c in right.columns if c not in left.columns]
        return left.join(right.select(cell, *new), cell, "full_outer")
    return reduce(add, tables)


# --- fractions and rates ---------------------------------------------------------------

def rates(df: DataFrame, dims: Sequence[Mapping[str, Column] | str], flag: str,
          null_label: str = "sem informação") -> DataFrame:
    """Share and size of ``flag`` along several dimensions, in one pass."""
    named: dict[str, Column] = {}
    for d in dims:
        named.update({d: F.col(d)} if isinstance(d, str) else d)
    wide = df.select(F.col(flag).cast("double").alias("_f"),
                     *[F.coalesce(c.cast("string"), F.lit(null_label)).alias(n) for n, c in named.items()])
    # combine equal rows first, so the unpivot multiplies counts and not rows
    packed = wide.groupBy(*named).agg(F.sum("_f").alias("_s"), F.count("_f").alias("_n"))
    tall = packed.unpivot(["_s", "_n"], list(named), "dimension", "label")
    return tall.groupBy("dimension", "label").agg(
        F.try_divide(F.sum("_s"), F.sum("_n")).alias("rate"), F.sum("_n").alias("n"))


def attributable_fraction(df: DataFrame, exposed: Column, survived: Column) -> DataFrame:
    """Naive difference-in-differences: excess losses of the exposed over all losses."""
    s = survived.cast("double")
    m = df.agg(F.count_if(exposed).alias("n_exposed"), F.count_if(~exposed).alias("n_control"),
               F.avg(F.when(exposed, s)).alias("survival_exposed"),
               F.avg(F.when(~exposed, s)).alias("survival_control"))
    gap = F.col("survival_control") - F.col("survival_exposed")
    lost = (F.col("n_exposed") * (1 - F.col("survival_exposed"))
            + F.col("n_control") * (1 - F.col("survival_control")))
    saved = F.col("n_exposed") * F.greatest(F.lit(0.0), gap)
    return m.select("*", (100 * gap).alias("difference_pp"), lost.alias("losses"), saved.alias("saved"),
                    (100 * F.try_divide(saved, lost)).alias("fraction_pct"))


def spearman(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row with Pearson, Spearman and n over the rows where both values exist.

    Equal pairs are combined first; ranks come from value counts, so neither a
    global window nor a repeated value meets a single task.
    """
    pairs = (df.select(a.cast("double").alias("_a"), b.cast("double").alias("_b"))
             .where("_a IS NOT NULL AND _b IS NOT NULL")
             .groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("w")))
    ranked = pairs
    for c in ("_a", "_b"):
        r = weighted_ranks(pairs, c, "w").select(c, F.col("rank").alias(f"r{c}"), "pairs")
        ranked = attach_per_key(ranked, r, [c], "pairs", keep_size=False)
    return ranked.agg(
        F.sum("w").alias("n"),
        weighted_corr("_a", "_b", "w").alias("pearson"),
        weighted_corr("r_a", "r_b", "w").alias("spearman"))


def weighted_ranks(pairs: DataFrame, value: str, weight: str) -> DataFrame:
    counts = pairs.groupBy(value).agg(F.sum(weight).alias("c"), F.count(F.lit(1)).alias("pairs"))
    ranked = running_totals(counts, [], value, ["c"], splitters(pairs, value))
    return ranked.withColumn("rank", F.col("c_before") + (F.col("c") + 1) / F.lit(2.0))


def weighted_corr(x: str, y: str, w: str) -> Column:
    """Pearson correlation of counted pairs; NULL when a side is constant."""
    a, b, c = F.col(x), F.col(y), F.col(w).cast("double")
    n = F.sum(c)
    sx, sy = F.sum(c * a), F.sum(c * b)
    cov = F.sum(c * a * b) - sx * sy / n
    vx, vy = F.sum(c * a * a) - sx * sx / n, F.sum(c * b * b) - sy * sy / n
    return F.when((vx > 0) & (vy > 0), cov / F.sqrt(F.when(vx > 0, vx)) / F.sqrt(F.when(vy > 0, vy)))




# --- order and samples -------------------------------------------------------------------

def top_n(df: DataFrame, by: str, n: int, tie: str, largest: bool = True) -> DataFrame:
    """The ``n`` rows with the largest (or smallest) value, ties by ``tie``; each task keeps n rows."""
    return df.orderBy(F.desc(by) if largest else F.asc(by), tie).limit(n)


def hash_sample(df: DataFrame, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in a seeded hash order: the same rows whatever the partitioning."""
    order = F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return df.orderBy(order, id_column).limit(n)


def feature_group(df: DataFrame, feature: str, groups: Mapping[str, str], default: str = "listing",
                  name: str = "source") -> DataFrame:
    """Source group of each feature name in a result table."""
    pairs = F.create_map(*[F.lit(x) for kv in (groups or {"": default}).items() for x in kv])
    return df.withColumn(name, F.coalesce(F.try_element_at(pairs, F.col(feature)), F.lit(default)))

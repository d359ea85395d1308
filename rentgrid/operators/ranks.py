"""Ranks and exact order statistics without a window over the whole table.

Everything here starts from a value-count table, ``(by..., value, weight...)``
with one row per distinct value. Values are cut into buckets that hold about the
same number of rows, bucket totals give the offset of each bucket, and only
inside a bucket are values ordered. A group that holds most of the table is
therefore spread over all its buckets, and no task ever sees it whole.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.operators.skew import attach_per_key
from rentgrid.session import shared_table

#: Counted values that one task puts in order; the number of buckets follows from it.
BUCKET_VALUES = 250_000
#: Buckets of a table that would need fewer.
LEAST_BUCKETS = 8
#: Cuts that the first sketch gives; a table that needs more is sketched once again.
FIRST_CUTS = 64

Position = Callable[[Column], Column]


def _sketch(df: DataFrame, columns: Sequence[Column], n: int) -> list[tuple[int, list[float]]]:
    probabilities = F.array(*[F.lit(i / n) for i in range(1, n)])
    row = df.agg(*[e for i, c in enumerate(columns) for e in (
        F.count(c).alias(f"n{i}"), F.percentile_approx(c, probabilities, 20 * n).alias(f"s{i}"))]).first()
    return [(row[f"n{i}"], list(row[f"s{i}"] or [])) for i in range(len(columns))]


def profiles(df: DataFrame, values: Sequence[str | Column], least: int = LEAST_BUCKETS) -> list[tuple[int, list[float]]]:
    """Per column: the number of non-null values, and approximate quantiles that cut them evenly into ``least`` or more buckets.

    One pass with fixed-size sketches gives counts and cuts of all columns. The cuts
    only balance the work: results are exact for any strictly increasing list.
    """
    columns = [(F.col(v) if isinstance(v, str) else v).cast("double") for v in values]
    found = _sketch(df, columns, FIRST_CUTS)
    buckets = max([least, *[-(-n // BUCKET_VALUES) for n, _ in found]])
    if buckets > FIRST_CUTS:
        found = _sketch(df, columns, buckets)
    step = max(1, FIRST_CUTS // buckets)
    return [(n, sorted({float(x) for x in cuts[step - 1::step] if x == x and abs(x) != float("inf")})) for n, cuts in found]


def splitters(df: DataFrame, value: str | Column) -> list[float]:
    """Bucket edges that cut the values evenly; none if there is at most one value."""
    return profiles(df, [value])[0][1]


def with_bucket(df: DataFrame, value: str, splits: Sequence[float], name: str = "__bucket") -> DataFrame:
    edges = [-float("inf"), *(splits or [0.0]), float("inf")]
    cut = Bucketizer(splits=edges, inputCol="__bucket_value", outputCol="__bucket_raw", handleInvalid="keep")
    out = cut.transform(df.withColumn("__bucket_value", F.col(value).cast("double")))
    return out.withColumn(name, F.col("__bucket_raw").cast("int")).drop("__bucket_value", "__bucket_raw")


def value_counts(df: DataFrame, by: Sequence[str], value: str | Column,
                 weights: Mapping[str, Column] | None = None, name: str = "_v") -> DataFrame:
    """``(by..., _v, weight...)``: one row per distinct non-null value of a group."""
    column = (F.col(value) if isinstance(value, str) else value).alias(name)
    sums = [c.alias(f"_in_{w}") for w, c in (weights or {"c": F.lit(1)}).items()]
    names = list(weights or {"c": None})
    return (df.select(*by, column, *sums).where(F.col(name).isNotNull())
            .groupBy(*by, name)
            .agg(*[F.sum(F.col(f"_in_{w}").cast("long")).alias(w) for w in names]))


def running_totals(counts: DataFrame, by: Sequence[str], value: str, weights: Sequence[str],
                   splits: Sequence[float]) -> DataFrame:
    """Add ``<w>_before`` (weight of smaller values in the group) and ``<w>_total``.

    ``counts`` has one row per ``(by..., value)``. The window over ``by`` alone
    runs on bucket totals, so it sees at most ``len(splits) + 1`` rows a group.
    """
    by = list(by)
    whole = Window.partitionBy(*by)
    cut = with_bucket(counts, value, splits)
    totals = cut.groupBy(*by, "__bucket").agg(*[F.sum(w).alias(f"_s_{w}") for w in weights])
    earlier = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "__bucket",
        *[F.coalesce(F.sum(f"_s_{w}").over(earlier), F.lit(0)).alias(f"_o_{w}") for w in weights],
        *[F.sum(f"_s_{w}").over(whole).alias(f"{w}_total") for w in weights])
    inside = Window.partitionBy(*by, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(offsets, [*by, "__bucket"])
    return joined.select(
        *counts.columns,
        *[(F.col(f"_o_{w}") + F.coalesce(F.sum(w).over(inside), F.lit(0))).alias(f"{w}_before")
          for w in weights],
        *[f"{w}_total" for w in weights])


def average_ranks(df: DataFrame, by: Sequence[str], value: str | Column,
                  splits: Sequence[float] | None = None, name: str = "_v") -> DataFrame:
    """``(by..., _v, c, c_before, c_total, rank)``; equal values share their mean rank."""
    if splits is None:
        splits = splitters(df, value)
    counts = value_counts(df, by, value, name=name)
    ranked = running_totals(counts, by, name, ["c"], splits)
    return ranked.withColumn("rank", F.col("c_before") + (F.col("c") + 1) / F.lit(2.0))


def global_index(df: DataFrame, order: Column, name: str = "idx") -> DataFrame:
    """A dense 0-based position by ``order`` (unique numbers), plus ``n``, the row count."""
    keyed = df.withColumn("_ord", order).withColumn("_one", F.lit(1).cast("long"))
    out = running_totals(keyed, [], "_ord", ["_one"], splitters(keyed, "_ord"))
    return (out.withColumnRenamed("_one_before", name).withColumnRenamed("_one_total", "n")
            .drop("_ord", "_one"))


def order_statistics(counts: DataFrame, by: Sequence[str], value: str, weights: Sequence[str],
                     positions: Mapping[str, Position], splits: Sequence[float]) -> DataFrame:
    """The values at given 0-based positions of every group, for every weight column.

    ``positions`` maps a name to a function of the group size. Returns
    ``by...``, ``<w>__n`` and ``<w>__<name>``. Only the buckets that hold a wanted
    position are ordered; all others stop at their totals.
    """
    by, names = list(by), list(positions)
    cut = with_bucket(counts, value, splits)
    whole = Window.partitionBy(*by)
    totals = cut.groupBy(*by, "__bucket").agg(F.array(*[F.sum(w) for w in weights]).alias("_s"))
    earlier = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = totals.select(
        *by, "__bucket", "_s",
        F.array(*[F.coalesce(F.sum(F.col("_s")[i]).over(earlier), F.lit(0)) for i in range(len(weights))]).alias("_o"),
        F.array(*[F.sum(F.col("_s")[i]).over(whole) for i in range(len(weights))]).alias("_n"))

    def inside_of(t: Column, starts: Column, sizes: Column) -> Column:
        return (t["_at"] >= F.get(starts, t["_w"])) & (t["_at"] < F.get(starts, t["_w"]) + F.get(sizes, t["_w"]))

    wanted = F.array(*[F.struct(F.lit(i).alias("_w"), F.lit(j).alias("_q"), positions[p](F.col("_n")[i]).cast("long").alias("_at"))
                       for i in range(len(weights)) for j, p in enumerate(names)])
    chosen = (spans.withColumn("_t", F.filter(wanted, lambda t: inside_of(t, F.col("_o"), F.col("_s"))))
              .where(F.size("_t") > 0).select(*by, "__bucket", "_o", "_n", "_t"))
    inside = Window.partitionBy(*by, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.join(chosen, [*by, "__bucket"]).select(
        *by, F.col(value).alias("_value"), "_n", "_t",
        F.array(*[F.col("_o")[i] + F.coalesce(F.sum(w).over(inside), F.lit(0)) for i, w in enumerate(weights)]).alias("_before"),
        F.array(*weights).alias("_here"))
    hits = local.select(*by, "_value", "_n", F.inline(F.filter("_t", lambda t: inside_of(t, F.col("_before"), F.col("_here")))))
    picks = [F.max(F.when((F.col("_w") == i) & (F.col("_q") == j), F.col("_value"))).alias(f"{w}__{p}")
             for i, w in enumerate(weights) for j, p in enumerate(names)]
    sizes = [F.max(F.col("_n")[i]).alias(f"{w}__n") for i, w in enumerate(weights)]
    return hits.groupBy(*by).agg(*sizes, *picks)


def _low(p: float) -> Position:
    return lambda n: F.floor((n - 1) * F.lit(float(p)))


def _high(p: float) -> Position:
    return lambda n: F.ceil((n - 1) * F.lit(float(p)))


def interpolated(n: Column, low: Column, high: Column, p: float) -> Column:
    """Linear interpolation between the two order statistics around ``(n-1)p``."""
    at = (n - 1) * F.lit(float(p))
    return low + (at - F.floor(at)) * (high - low)


def quantile_name(p: float) -> str:
    return "p" + f"{100 * p:.4f}".rstrip("0").rstrip(".").replace(".", "_").rjust(2, "0")


def quantiles(df: DataFrame, by: Sequence[str], metrics: Mapping[str, Column],
              probabilities: Mapping[str, float] | Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles of several columns per group.

    Returns ``by...``, ``<metric>_n`` and ``<metric>_<name>``. NULLs are left out;
    a group whose metrics are all NULL has no row.
    """
    by = list(by)
    if not isinstance(probabilities, Mapping):
        probabilities = {quantile_name(p): p for p in probabilities}
    pairs = F.array(*[F.struct(F.lit(m).alias("_m"), c.cast("double").alias("_v"))
                      for m, c in metrics.items()])
    long = (df.select(*by, F.explode(pairs).alias("_x"))
            .select(*by, F.col("_x._m").alias("_m"), F.col("_x._v").alias("_v"))
            .where(F.col("_v").isNotNull()))
    splits = splitters(long, "_v")
    counts = value_counts(long, [*by, "_m"], "_v")
    positions: dict[str, Position] = {}
    for name, p in probabilities.items():
        positions[f"{name}__lo"], positions[f"{name}__hi"] = _low(p), _high(p)
    stats = order_statistics(counts, [*by, "_m"], "_v", ["c"], positions, splits)
    values = [interpolated(F.col("c__n"), F.col(f"c__{q}__lo"), F.col(f"c__{q}__hi"), p).alias(f"_q_{q}")
              for q, p in probabilities.items()]
    tall = stats.select(*by, "_m", "c__n", *values)
    wide = []
    for m in metrics:
        hit = F.col("_m") == m
        wide.append(F.coalesce(F.max(F.when(hit, F.col("c__n"))), F.lit(0)).alias(f"{m}_n"))
        wide += [F.max(F.when(hit, F.col(f"_q_{q}"))).alias(f"{m}_{q}") for q in probabilities]
    return tall.groupBy(*by).agg(*wide)


def medians(df: DataFrame, by: Sequence[str], metrics: Mapping[str, Column]) -> DataFrame:
    """Exact medians: ``by...`` and one column per metric."""
    out = quantiles(df, by, metrics, {"med": 0.5})
    return out.select(*by, *[F.col(f"{m}_med").alias(m) for m in metrics])


def medians_by_dimension(df: DataFrame, dims: Mapping[str, Column], metrics: Mapping[str, Column]) -> DataFrame:
    """Exact medians of the same rows under several groupings: ``dimension, label`` and one column per metric.

    Rows are not repeated per grouping. Tasks count them per bucket of values and per
    combination of labels, the groupings are summed from these counts, and only values of
    the buckets that hold a median are shuffled. ``df`` is read three times (four above 16 million values). Rows without a label are not in that grouping.
    """
    keys, group = [f"_d{i}" for i in range(len(dims))], ["dimension", "label", "_m"]
    rows = df.select(*[c.cast("string").alias(k) for k, c in zip(keys, dims.values())],
                     *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(metrics.values())])
    cuts = profiles(rows, [f"_x{i}" for i in range(len(metrics))], FIRST_CUTS)
    for i, (_, splits) in enumerate(cuts):
        rows = with_bucket(rows, f"_x{i}", splits, f"_b{i}")
    long = rows.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_m"), F.col(f"_b{i}").alias("_b"), F.col(f"_x{i}").alias("_v")) for i in range(len(metrics))]))
        ).where("_v IS NOT NULL")
    totals = shared_table(long.groupBy(*keys, "_m", "_b").agg(F.count(F.lit(1)).alias("_c")), "bucket-totals")
    labelled = totals.select("*", F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(k).alias("label")) for d, k in zip(dims, keys)]))).where("label IS NOT NULL")
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    spans = labelled.groupBy(*group, "_b").agg(F.sum("_c").alias("_s")).select(
        *group, "_b", "_s", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_o"), F.sum("_s").over(whole).alias("_n"))
    low, high = _low(0.5)(F.col("_n")), _high(0.5)(F.col("_n"))

    def at(position: Column, start: Column, size: Column) -> Column:
        return (position >= start) & (position < start + size)

    chosen = shared_table(spans.where(at(low, F.col("_o"), F.col("_s")) | at(high, F.col("_o"), F.col("_s"))).drop("_s"), "median-buckets")
    # tables of counts, so that their size is known and the rows need not move to meet them
    asked = shared_table(labelled.join(chosen, [*group, "_b"], "left_semi").groupBy(*keys, "_m", "_b").agg(
        F.collect_list(F.struct("dimension", "label")).alias("_g")).withColumnsRenamed({c: f"{c}_" for c in [*keys, "_m", "_b"]}), "asked-buckets")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys] + [F.col(c) == F.col(f"{c}_") for c in ("_m", "_b")]
    counts = long.join(asked, reduce(lambda a, b: a & b, same)).select(F.inline("_g"), "_m", "_b", "_v").groupBy(
        *group, "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
    inside = Window.partitionBy(*group, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(chosen, [*group, "_b"]).withColumn("_before", F.col("_o") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    picks = [F.max(F.when(at(p, F.col("_before"), F.col("_c")), F.col("_v"))).alias(n) for n, p in (("_lo", low), ("_hi", high))]
    found = placed.groupBy(*group).agg(F.max("_n").alias("_n"), *picks).withColumn(
        "_med", interpolated(F.col("_n"), F.col("_lo"), F.col("_hi"), 0.5))
    return found.groupBy("dimension", "label").agg(*[
        F.max(F.when(F.col("_m") == i, F.col("_med"))).alias(m) for i, m in enumerate(metrics)])


def median_interval(df: DataFrame, by: Sequence[str], value: str | Column, level: float = 0.95,
                    min_n: int = 10) -> DataFrame:
    """Median with the percentile-bootstrap interval, without drawing resamples.

    The median of a resample is an order statistic of the sample whose rank is
    binomial with mean n/2 and variance n/4, so the percentile limits that many
    resamples settle on are the order statistics at those two ranks. Groups
    smaller than ``min_n`` get no interval.
    """
    by = list(by)
    z = normal_quantile(0.5 + level / 2)
    positions = {
        "lo": _low(0.5), "hi": _high(0.5),
        "ci_low": lambda n: F.greatest(F.lit(0.0), F.floor(n / 2 - z * F.sqrt(n) / 2)),
        "ci_high": lambda n: F.least(n - F.lit(1.0), F.ceil(n / 2 + z * F.sqrt(n) / 2) - 1),
    }
    counts = value_counts(df, by, value)
    stats = order_statistics(counts, by, "_v", ["c"], positions, splitters(df, value))
    n = F.col("c__n")
    limits = [F.when(n >= min_n, F.col(f"c__{c}")).alias(c) for c in ("ci_low", "ci_high")]
    return stats.select(*by, n.alias("n"),
                        interpolated(n, F.col("c__lo"), F.col("c__hi"), 0.5).alias("median"), *limits)


def normal_quantile(p: float) -> float:
    from statistics import NormalDist
    return NormalDist().inv_cdf(p)


def top_share(df: DataFrame, by: Sequence[str], owner: str, fraction: float) -> DataFrame:
    """Share of rows held by the largest ``max(1, floor(fraction * owners))`` owners.

    Owners are not ranked one by one: owners with equally many rows are
    interchangeable, and there are at most ``sqrt(2 * rows)`` different sizes.
    """
    by = list(by)
    sizes = df.where(F.col(owner).isNotNull()).groupBy(*by, owner).agg(F.count(F.lit(1)).alias("size"))
    census = sizes.groupBy(*by, "size").agg(F.count(F.lit(1)).alias("owners"))
    larger = Window.partitionBy(*by).orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    ranked = census.select(
        *by, "size", "owners",
        F.coalesce(F.sum("owners").over(larger), F.lit(0)).alias("before"),
        F.sum("owners").over(whole).alias("all_owners"),
        F.sum(F.col("size") * F.col("owners")).over(whole).alias("rows"))
    quota = F.greatest(F.lit(1), F.floor(F.col("all_owners") * F.lit(float(fraction))))
    taken = F.greatest(F.lit(0), F.least(F.col("owners"), quota - F.col("before")))
    return ranked.groupBy(*by).agg(
        (F.sum(taken * F.col("size")) / F.max("rows")).alias("top_share"),
        F.max("all_owners").alias("owners"))


def attach_ranks(df: DataFrame, columns: Sequence[str], suffix: str = "__rank") -> DataFrame:
    """Average rank of each column beside the rows; repeated values are split over tasks."""
    out = df
    for c, (_, splits) in zip(columns, profiles(df, columns)):
        ranked = average_ranks(df, [], F.col(c).cast("double"), splits, "_rv").select(
            F.col("_rv").alias(f"_k_{c}"), F.col("rank").alias(c + suffix), F.col("c").alias("_size"))
        keyed = out.withColumn(f"_k_{c}", F.col(c).cast("double"))
        out = attach_per_key(keyed, ranked, [f"_k_{c}"], "_size").drop(f"_k_{c}", "_size")
    return out

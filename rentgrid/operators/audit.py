"""Data-quality reports: duplicates, missing values, identities, prices, reviews, occupancy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentgrid.functions import constants as K
from rentgrid.functions import scalars as S
from rentgrid.operators.panel import share
from rentgrid.operators.ranks import attach_ranks, medians, quantiles
from rentgrid.operators.skew import attach_per_key


def count_checks(df: DataFrame, checks: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., check, n, of, share)`` for any number of conditions, in one aggregate.

    A condition that is NULL is out of both counts.
    """
    counts = df.groupBy(*by).agg(*[
        e for i, c in enumerate(checks.values())
        for e in (F.count_if(c).alias(f"y{i}"), F.count(c).alias(f"t{i}"))])
    rows = F.array(*[F.struct(
        F.lit(name).alias("check"), F.col(f"y{i}").alias("n"), F.col(f"t{i}").alias("of"),
        F.try_divide(F.col(f"y{i}"), F.col(f"t{i}")).alias("share")) for i, name in enumerate(checks)])
    return counts.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def audit_duplicates(df: DataFrame, checks: Mapping[str, Sequence[str]],
                     required: Mapping[str, str] | None = None) -> DataFrame:
    """Per check: distinct keys, repeated keys, rows in them, the largest and the extra rows.

    ``required`` names a column that must be filled for a check. NULLs are equal.
    """
    out = []
    for name, keys in checks.items():
        rows = df.where(F.col(required[name]).isNotNull()) if required and name in required else df
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("s"))
        many = F.col("s") > 1
        out.append(sizes.agg(
            F.lit(name).alias("check"), F.count(F.lit(1)).alias("distinct_keys"),
            F.count_if(many).alias("repeated_keys"),
            F.coalesce(F.sum(F.when(many, F.col("s"))), F.lit(0)).alias("rows_in_groups"),
            F.coalesce(F.max(F.when(many, F.col("s"))), F.lit(0)).alias("largest"),
            F.coalesce(F.sum(F.col("s") - 1), F.lit(0)).alias("extra_rows")))
    return reduce(DataFrame.unionByName, out)


def structural_nulls(df: DataFrame, columns: Sequence[str], empty: Column) -> DataFrame:
    """Is a NULL the same fact as ``empty``? Four-way counts per column."""
    counts = df.agg(*[e for i, c in enumerate(columns) for e in (
        F.count_if(F.col(c).isNull() & empty).alias(f"a{i}"),
        F.count_if(F.col(c).isNull() & ~empty).alias(f"b{i}"),
        F.count_if(F.col(c).isNotNull() & empty).alias(f"c{i}"))])
    rows = F.array(*[F.struct(
        F.lit(c).alias("column"), (F.col(f"a{i}") + F.col(f"b{i}")).alias("nulls"),
        F.col(f"a{i}").alias("null_and_empty"), F.col(f"b{i}").alias("null_not_empty"),
        F.col(f"c{i}").alias("filled_and_empty"),
        ((F.col(f"b{i}") == 0) & (F.col(f"c{i}") == 0)).alias("structural"))
        for i, c in enumerate(columns)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def audit_nulls(df: DataFrame) -> DataFrame:
    """Columns with NULLs, most first, and whether they are NULL throughout."""
    total = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}")
                                                        for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("nulls"),
                              (F.col(f"c{i}") == F.col("n_rows")).alias("all_null"))
                     for i, c in enumerate(df.columns)])
    return (total.select(F.explode(rows).alias("r")).select("r.*").where("nulls > 0")
            .orderBy(F.desc("nulls"), "column"))


def audit_identity(df: DataFrame, id_column: str, name: str) -> DataFrame:
    """Does a name identify a host? Names per id, ids per name, rows behind shared names."""
    pairs = df.groupBy(id_column, name).agg(F.count(F.lit(1)).alias("n_rows"))
    both = pairs.where(F.col(id_column).isNotNull() & F.col(name).isNotNull())
    ids = both.groupBy(id_column).agg(F.count(F.lit(1)).alias("names"))
    names = both.groupBy(name).agg(F.count(F.lit(1)).alias("ids"))
    # rows with a shared name, also those without an id: they join on the name
    rows_by_name = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n_rows"))
    by_id = ids.agg(F.count_if(F.col("names") > 1).alias("ids_with_many_names"),
                    F.count(F.lit(1)).alias("ids"))
    by_name = names.join(rows_by_name, name).agg(
        F.count(F.lit(1)).alias("names"), F.count_if(F.col("ids") > 1).alias("shared_names"),
        share(F.col("ids") > 1).alias("shared_name_share"),
        F.coalesce(F.sum(F.when(F.col("ids") > 1, F.col("n_rows"))), F.lit(0)).alias("rows_with_shared_name"),
        F.max("ids").alias("most_ids_of_a_name"))
    middle = medians(names, [], {"median_ids_of_a_name": F.col("ids")})
    out = by_id.select(F.struct("*").alias("a"), F.lit(1).alias("k"))
    for table, alias in ((by_name, "b"), (middle, "c")):
        out = out.join(table.select(F.struct("*").alias(alias), F.lit(1).alias("k")), "k")
    return out.select("a.*", "b.*", "c.*")


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Profile per column: n, mean, extremes, five percentiles, population skewness."""
    by = list(by)
    probabilities = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    moments = df.groupBy(*by).agg(*[e for i, c in enumerate(columns) for e in (
        F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.min(c).alias(f"lo{i}"),
        F.max(c).alias(f"hi{i}"), F.skewness(c).alias(f"s{i}"))])
    levels = quantiles(df, by, {f"q{i}": F.col(c) for i, c in enumerate(columns)}, probabilities)
    if by:
        joined = moments.join(levels, by, "left")
    else:
        joined = moments.withColumn("_k", F.lit(1)).join(levels.withColumn("_k", F.lit(1)), "_k", "left")
    rows = F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"),
        F.col(f"lo{i}").cast("double").alias("min"),
        *[F.col(f"q{i}_{p}").alias(p) for p in probabilities],
        F.col(f"hi{i}").cast("double").alias("max"), F.col(f"s{i}").alias("skewness"))
        for i, c in enumerate(columns)])
    return joined.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


# --- price -------------------------------------------------------------------------

def price_checks(price: Column, quoted: Column, per_night: Column, total: Column, nights: Column,
                 min_nights: Column, availability: Column) -> dict[str, Column]:
    """The conditions of the price audit, for ``count_checks``."""
    null, idle = price.isNull(), availability == 0
    return {
        "zero": price == 0, "between_1_and_9": price.between(1, 9), "equal_9999": price == 9999,
        "equal_10000": price == 10_000, "above_1000": price > 1000, "above_10000": price > 10_000,
        "below_10": price < 10,
        "null": null, "null_without_quote": null & ~quoted, "null_with_quote": null & quoted,
        "null_if_unavailable": F.when(idle, null), "null_if_available": F.when(~idle, null),
        "equals_per_night": F.when(price.isNotNull() & per_night.isNotNull(),
                                   S.nullsafe_close(price, per_night)),
        "total_is_price_times_nights": F.when(
            price.isNotNull() & (nights > 0) & total.isNotNull(),
            F.abs(total - price * nights) <= F.lit(1e-8) + F.lit(0.01) * F.abs(price * nights)),
        "nights_equal_minimum": F.when(nights.isNotNull(), F.coalesce(nights == min_nights, F.lit(False))),
    }


def medians_by_band(df: DataFrame, value: str, bands: tuple[Sequence, Sequence[str]],
                    metrics: Mapping[str, Column]) -> DataFrame:
    """Row count and medians per right-closed band of ``value``."""
    edges, labels = bands
    rows = df.withColumn("band", S.bucket(value, edges, labels)).where("band IS NOT NULL")
    for c in metrics.values():
        rows = rows.where(c.isNotNull())
    size = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    return size.join(medians(rows, ["band"], metrics), "band", "left")


def discount_report(df: DataFrame, discount: str, long_stay: Column) -> DataFrame:
    """How many quotes carry a discount, and how large it is for short and long stays."""
    d = F.col(discount)
    rows = df.where(d.isNotNull())
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(d > 0).alias("with_discount"),
                      share(d > 0).alias("with_discount_share"), F.max(d).alias("largest"))
    levels = quantiles(rows, [], {"short": F.when(~long_stay, d), "long": F.when(long_stay, d)},
                       {"median": 0.5, "p90": 0.9})
    return (counts.withColumn("_k", F.lit(1)).join(levels.withColumn("_k", F.lit(1)), "_k", "left")
            .select("n", "with_discount", "with_discount_share", "largest", "short_median",
                    "long_median", "long_p90"))


# --- reviews ------------------------------------------------------------------------

def rate_variation(df: DataFrame, host: str, rate: str, by: Sequence[str] = ()) -> DataFrame:
    """Is the rate a property of the host? Constant or varying among hosts with two or more rows."""
    by = list(by)
    rows = df.where(F.col(rate).isNotNull())
    per_host = rows.groupBy(*by, host).agg(F.count(F.lit(1)).alias("n"), F.min(rate).alias("lo"),
                                           F.max(rate).alias("hi")).where("n >= 2")
    varies = F.col("lo") != F.col("hi")
    counts = per_host.groupBy(*by).agg(
        F.count(F.lit(1)).alias("hosts"), F.count_if(~varies).alias("constant"),
        F.count_if(varies).alias("varying"), share(varies).alias("varying_share"))
    spread = medians(per_host, by, {"median_range": F.col("hi") - F.col("lo")})
    if by:
        return counts.join(spread, by, "left")
    return (counts.withColumn("_k", F.lit(1)).join(spread.withColumn("_k", F.lit(1)), "_k", "left").drop("_k"))


def rate_checks(rate: Column, total: Column) -> dict[str, Column]:
    return {"above_total": F.coalesce(rate > total, F.lit(False)),
            "equal_total": F.coalesce(rate == total, F.lit(False)),
            "above_30": F.coalesce(rate > 30, F.lit(False))}


def rate_formula_fit(df: DataFrame, published: str, rebuilt: Mapping[str, Column]) -> DataFrame:
    """Per rebuilt rate: Pearson, mean absolute error, equal to two decimals, within 0.01."""
    p = F.col(published)
    out = []
    for name, c in rebuilt.items():
        rows = df.select(p.alias("p"), c.alias("c")).where("p IS NOT NULL AND c IS NOT NULL")
        gap = F.abs(F.col("c") - F.col("p"))
        out.append(rows.agg(
            F.lit(name).alias("formula"), F.count(F.lit(1)).alias("n"), F.corr("c", "p").alias("pearson"),
            F.avg(gap).alias("mae"), F.count_if(F.bround("c", 2) == F.col("p")).alias("equal_2_digits"),
            F.count_if(gap <= 0.0101).alias("within_0_01")))
    return reduce(DataFrame.unionByName, out)


# --- correlation ---------------------------------------------------------------------

def corr_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson and Spearman for every pair, largest disagreement first, over complete rows.

    Ranks are attached once per column; all pairs then come from one aggregate.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    ranked = attach_ranks(rows, columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = ranked.agg(*[e for i, (a, b) in enumerate(pairs) for e in (
        F.corr(a, b).alias(f"p{i}"), F.corr(a + "__rank", b + "__rank").alias(f"s{i}"))])
    out = F.array(*[F.struct(
        F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("pearson"),
        F.col(f"s{i}").alias("spearman"), (F.col(f"s{i}") - F.col(f"p{i}")).alias("difference"))
        for i, (a, b) in enumerate(pairs)])
    return (wide.select(F.explode(out).alias("r")).select("r.*")
            .orderBy(F.desc(F.abs("difference")), "a", "b"))


def replay_cleaning(df: DataFrame, drop: Sequence[str], fill: Mapping[str, float], price: str) -> DataFrame:
    """Step counts of an earlier cleaning: drop columns, drop equal rows, fill, price > 0, drop NULLs."""
    rest = [c for c in df.columns if c not in drop]
    distinct = df.groupBy(*rest).agg(F.count(F.lit(1)).alias("_copies"))
    filled = distinct.fillna(dict(fill))
    positive = F.col(price) > 0
    some_null = reduce(lambda a, c: a | F.col(c).isNull(), rest, F.lit(False))
    return filled.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("n_in"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates_removed"),
        F.count_if(F.col(price) <= 0).alias("price_removed"),
        F.count_if(positive & some_null).alias("null_removed"),
        F.count_if(positive & ~some_null).alias("n_out"))


# --- occupancy -------------------------------------------------------------------------

def reviews_in_window(reviews: DataFrame, key: str, date: str, reference: str, days: int = 365) -> DataFrame:
    """Reviews per key in ``(reference - days, reference]``; the date filter reaches the scan."""
    ref = F.lit(reference).cast("date")
    day = F.col(date).cast("date")
    return (reviews.where((day > F.date_sub(ref, days)) & (day <= ref))
            .groupBy(key).agg(F.count(F.lit(1)).alias("ltm")))


def ltm_validation(listings: DataFrame, reviews: DataFrame, key: str, review_key: str, date: str,
                   reference: str, model: str, min_nights: str, days: int = 365) -> DataFrame:
    """Occupancy rebuilt from dated reviews against the modelled one."""
    counts = reviews_in_window(reviews, review_key, date, reference, days).withColumnRenamed(review_key, key)
    rebuilt = F.least(F.coalesce("ltm", F.lit(0)) / F.lit(K.REVIEW_RATE) * S.stay_nights(min_nights) / 365,
                      F.lit(K.OCCUPANCY_CAP))
    rows = listings.join(counts, key, "left").select(F.col(model).alias("model"), rebuilt.alias("rebuilt"))
    return agreement(rows, "model", "rebuilt")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, both means, Pearson, Spearman and mean absolute difference of two columns."""
    rows = df.select(F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b)).dropna()
    ranked = attach_ranks(rows, [a, b])
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
                      F.corr(a, b).alias("pearson"), F.corr(a + "__rank", b + "__rank").alias("spearman"),
                      F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"))


def occupancy_sensitivity(df: DataFrame, rate: str, min_nights: str, idle_days: str, observed: str,
                          stays: Sequence[float] = (K.MEAN_STAY_DEFAULT, K.MEAN_STAY),
                          windows: Sequence[int | None] = (None, K.ACTIVE_DAYS)) -> DataFrame:
    """Model against observation for every assumption; assumptions are columns of one pass."""
    grid = {f"v{i}": (s, w) for i, (s, w) in enumerate((s, w) for s in stays for w in windows)}
    rows = df.select(F.col(observed).cast("double").alias("obs"), *[
        S.occupancy_model(rate, min_nights, idle_days, s, w).alias(v) for v, (s, w) in grid.items()]).dropna()
    ranked = attach_ranks(rows, ["obs", *grid])
    wide = ranked.agg(*[e for v in grid for e in (
        F.avg(v).alias(f"{v}m"), F.corr(v, "obs").alias(f"{v}p"),
        F.corr(v + "__rank", "obs__rank").alias(f"{v}s"), F.avg(F.abs(F.col(v) - F.col("obs"))).alias(f"{v}e"))])
    out = F.array(*[F.struct(
        F.lit(float(s)).alias("stay"), F.lit(w is not None).alias("windowed"), F.col(f"{v}m").alias("mean"),
        F.col(f"{v}p").alias("pearson"), F.col(f"{v}s").alias("spearman"), F.col(f"{v}e").alias("mae"))
        for v, (s, w) in grid.items()])
    return wide.select(F.explode(out).alias("r")).select("r.*")


def occupancy_reproduction(df: DataFrame, reviews: str, min_nights: str, published: str) -> DataFrame:
    rebuilt = S.occupancy_nights(reviews, min_nights)
    return df.agg(F.count(rebuilt).alias("n"), F.count_if(rebuilt == F.col(published)).alias("equal"))


def occupancy_by(df: DataFrame, keys: Sequence[str], occupancy: str, price: str, availability: str) -> DataFrame:
    """Modelled occupancy, closed calendar share, idle share and yield per group."""
    return df.groupBy(*keys).agg(
        F.avg(occupancy).alias("occupancy"), F.avg(1 - F.col(availability) / 365).alias("calendar_closed"),
        share(F.col(availability) == 0).alias("unavailable_share"),
        F.avg(F.col(price) * F.col(occupancy)).alias("yield"))


# --- flags and counts ---------------------------------------------------------------------

def flag_ratios(df: DataFrame, flags: Sequence[str], stratum: str, price: str) -> DataFrame:
    """Prevalence of each flag and the ratio of median prices with and without it, per stratum."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), *[
        F.avg(F.col(f).cast("double")).alias(f"s_{f}") for f in flags])
    metrics = {}
    for f in flags:
        metrics[f"w_{f}"] = F.when(F.col(f), F.col(price))
        metrics[f"o_{f}"] = F.when(~F.col(f), F.col(price))
    wide = sizes.join(medians(df, [stratum], metrics), stratum, "left")
    rows = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f"s_{f}").alias("prevalence"),
                              F.try_divide(F.col(f"w_{f}"), F.col(f"o_{f}")).alias("price_ratio"))
                     for f in flags])
    return wide.select(stratum, "n", F.explode(rows).alias("r")).select(stratum, "n", "r.*")


def completion_report(df: DataFrame, given: str, completed: str) -> DataFrame:
    g, c = F.col(given), F.col(completed)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(g.isNull()).alias("missing_before"),
                  F.count_if(g.isNull() & c.isNotNull()).alias("completed"),
                  F.count_if(c.isNull()).alias("missing_after"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def regex_share(df: DataFrame, column: str, pattern: str) -> DataFrame:
    hit = F.col(column).rlike(pattern)
    return df.agg(F.count_if(hit).alias("n"), F.count(column).alias("of"),
                  F.avg(hit.cast("double")).alias("share"))


def compliance(df: DataFrame, stratum: str, status: str, long_stay: Column) -> DataFrame:
    """Licence shares per stratum, and registered among short stays that are not exempt."""
    s = F.col(status)
    liable = ~long_stay & (s != "isenta")
    return df.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("n"),
        *[share(s == v).alias(v) for v in K.LICENCE_STATUS],
        F.try_divide(F.count_if(liable & (s == "registrada")), F.count_if(liable)).alias("compliant_share"))


def survey_quality(df: DataFrame, estimate: str, margin: str, cap: float) -> DataFrame:
    """Median coefficient of variation of survey values and how many sit at the published cap."""
    cv = F.try_divide(F.col(margin) / F.lit(1.645), F.col(estimate))
    counts = df.agg(F.count(estimate).alias("n"), F.count_if(F.col(estimate) >= cap).alias("at_cap"))
    middle = medians(df, [], {"median_cv": cv})
    return (counts.withColumn("_k", F.lit(1)).join(middle.withColumn("_k", F.lit(1)), "_k", "left").drop("_k"))


def amenity_dictionary_flags(df: DataFrame, id_column: str, raw: str,
                             patterns: Mapping[str, str] = K.AMENITY_PATTERNS) -> DataFrame:
    """Item flags by the dictionary route: match each distinct item once, then join back.

    For long lists drawn from few names this runs the patterns on the names only.
    Items are spread by (item, row), so a name on every list does not meet one task.
    """
    items = df.select(id_column, F.explode(S.parse_items(raw)).alias("item")).where("item IS NOT NULL")
    sizes = items.groupBy("item").agg(F.count(F.lit(1)).alias("_uses"))
    tested = sizes.select("item", "_uses", *[F.col("item").rlike("(?i)" + p).alias(n)
                                             for n, p in patterns.items()])
    flags = attach_per_key(items, tested, ["item"], "_uses").groupBy(id_column).agg(
        F.count(F.lit(1)).alias("n_items"), *[F.bool_or(n).alias(n) for n in patterns])
    out = df.select(id_column).join(flags, id_column, "left")
    return out.fillna(0, ["n_items"]).fillna(False, list(patterns))

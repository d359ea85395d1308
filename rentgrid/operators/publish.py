"""Published tables: anonymous points, the map table, class breaks, the summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentgrid.functions.scalars import publish_coordinate
from rentgrid.operators.contract import assert_no_personal
from rentgrid.operators.panel import merge_cells
from rentgrid.operators.ranks import quantiles
from rentgrid.operators.skew import one_row
from rentgrid.operators.validation import combine_metrics

SEQUENTIAL = {f"s{i}": i / 7 for i in range(1, 7)}
ARMS = {"t1": 1 / 3, "t2": 2 / 3, "half": 0.5}
PERSONAL = ("id", "name", "host_id", "host_name", "listing_url")


def public_points(df: DataFrame, lat: str, lon: str, price: str, valid: str, log_prediction: str,
                  keep: Sequence[str] = ()) -> DataFrame:
    """No ids, names or hosts; four decimals; a price only where it is valid; the predicted price."""
    out = df.select(publish_coordinate(lat).alias("lat"), publish_coordinate(lon).alias("lon"), *keep,
                    F.when(F.col(valid), F.round(price, 2)).alias("price"),
                    F.round(F.exp(log_prediction), 2).alias("predicted"))
    leaked = set(out.columns) & set(PERSONAL)
    if leaked:
        raise ValueError(f"personal columns in a published table: {sorted(leaked)}")
    return assert_no_personal(out)


def map_table(tables: Sequence[DataFrame], cell: str, metrics: Sequence[str], land: DataFrame,
              count: str, digits: int = 2) -> DataFrame:
    """All metrics of a cell in one row, rounded; cells on land or with listings."""
    merged = merge_cells(tables, cell).join(land.select(cell).distinct().withColumn("_land", F.lit(True)), cell, "left")
    shown = merged.where(F.col("_land") | (F.coalesce(F.col(count), F.lit(0)) > 0))
    types = dict(shown.dtypes)
    return shown.select(cell, *[F.round(m, digits).alias(m) if types.get(m) == "double" else
                                F.col(m) if m in types else F.lit(None).cast("double").alias(m) for m in metrics])


def two_digits(x: Column) -> Column:
    """Rounded to two significant digits."""
    exponent = (F.floor(F.log10(F.abs(x))) - 1).cast("int")
    digits = F.floor(x / F.pow(F.lit(10.0), exponent) + 0.5).cast("long")
    # written as a number, so the product leaves no noise and any magnitude fits
    return F.when(x == 0, F.lit(0.0)).otherwise(F.concat(digits.cast("string"), F.lit("E"), exponent.cast("string")).cast("double"))


def _increasing(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))))


def class_breaks(df: DataFrame, metrics: Mapping[str, str], neutral: Mapping[str, float] | None = None) -> DataFrame:
    """``(metric, kind, breaks)``: seven quantile classes, or arms around a neutral middle.

    ``metrics`` maps a column to ``sequential`` or ``diverging``.
    """
    neutral = neutral or {}
    seq = [m for m, k in metrics.items() if k == "sequential"]
    div = [m for m, k in metrics.items() if k == "diverging"]
    out = None
    if seq:
        low = one_row(df.agg(*[F.min(m).cast("double").alias(m) for m in seq]))
        q = quantiles(df, [], {m: F.col(m) for m in seq}, SEQUENTIAL).withColumn("_low", low)
        parts = []
        for m in seq:
            cuts = _increasing(F.array(*[two_digits(F.col(f"{m}_{s}")) for s in SEQUENTIAL]))
            parts.append(F.struct(F.lit(m).alias("metric"), F.lit("sequential").alias("kind"),
                                  _above(cuts, F.col("_low")[m]).alias("breaks")))
        out = q.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
    if div:
        spread = quantiles(df, [], {m: F.abs(F.col(m)) for m in div}, {"p95": 0.95})
        half = one_row(spread)

        def middle(m: str) -> Column:
            if m in neutral:
                return F.lit(float(neutral[m]))
            return F.coalesce(F.nullif(two_digits(0.05 * F.col("_half")[f"{m}_p95"]), F.lit(0.0)), F.lit(1e-9))

        arms = {}
        for m in div:
            arms[f"{m}__neg"] = F.when(F.col(m) < -middle(m), -F.col(m))
            arms[f"{m}__pos"] = F.when(F.col(m) > middle(m), F.col(m))
        q = quantiles(df.withColumn("_half", half), [], arms, ARMS).withColumn("_half", half)
        parts = []
        for m in div:
            def arm(side: str, m: str = m) -> Column:
                a, n = f"{m}__{side}", F.col(f"{m}__{side}_n")
                cuts = (F.when(n >= 30, F.array(two_digits(F.col(f"{a}_t1")), two_digits(F.col(f"{a}_t2"))))
                        .when(n >= 10, F.array(two_digits(F.col(f"{a}_half")))).otherwise(F.array().cast("array<double>")))
                return _above(_increasing(cuts), middle(m))
            negative = F.array_sort(F.transform(arm("neg"), lambda v: -v))
            parts.append(F.struct(F.lit(m).alias("metric"), F.lit("diverging").alias("kind"), F.concat(
                negative, F.array(-middle(m), middle(m)), arm("pos")).alias("breaks")))
        rows = q.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _above(values: Column, limit: Column) -> Column:
    return F.filter(values, lambda v: v > limit)


def display_factor(df: DataFrame, units: Mapping[str, str]) -> DataFrame:
    """100 for fractions, also for percentages stored as fractions; else 1."""
    flags = df.agg(*[F.bool_and(F.abs(m) <= 1).alias(m) for m in units])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), (
        F.lit(100) if u == "fração" else F.when(F.coalesce(F.col(m), F.lit(False)), 100).otherwise(1) if u == "%" else F.lit(1)
    ).alias("factor")) for m, u in units.items()])
    return flags.select(F.explode(rows).alias("r")).select("r.*")


def summary(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """All headline metrics in long form ``(section, key, metric, value)``."""
    return combine_metrics(tables)


def report_table(metrics: DataFrame, columns: Sequence[str], order: str, descending: bool = True) -> DataFrame:
    return metrics.select(*columns).orderBy(F.desc(order) if descending else F.asc(order))

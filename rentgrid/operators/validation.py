"""Blocked folds, out-of-fold baselines, error metrics and conformal intervals.

Statistics of "all rows outside fold k" never copy the rows per fold: a value-count
table carries one weight per fold, and each weight has its own running total.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentgrid.operators.ranks import (interpolated, medians, order_statistics, running_totals,
                                      splitters, global_index, value_counts)
from rentgrid.operators.skew import one_row
from rentgrid.functions.scalars import missing_if_nan
from rentgrid.session import shared_table

FOLDS = 5
SEED = 42
MIN_CLASS = 100


# --- folds -----------------------------------------------------------------------

def block_folds(df: DataFrame, block: str, k: int = FOLDS, seed: int = SEED,
                order_by: Column | None = None, name: str = "fold") -> DataFrame:
    """Whole blocks in one fold, dealt out in a seeded order; the first folds take the remainder."""
    blocks = df.select(block).where(F.col(block).isNotNull()).distinct()
    order = order_by if order_by is not None else F.xxhash64(F.col(block), F.lit(seed))
    placed = global_index(blocks, order)
    size, rest = F.floor(F.col("n") / k), F.col("n") % k
    head = rest * (size + 1)
    fold = F.when(F.col("idx") < head, F.floor(F.col("idx") / (size + 1))).otherwise(
        rest + F.floor((F.col("idx") - head) / F.greatest(size, F.lit(1))))
    # a table of blocks, so that its size is known and the rows need not move to meet it
    return df.join(shared_table(placed.select(block, fold.cast("int").alias(name)), "block-folds"), block, "left")


def random_folds(df: DataFrame, id_column: str, k: int = FOLDS, seed: int = SEED, name: str = "fold") -> DataFrame:
    digest = F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return df.withColumn(name, (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % k).cast("int"))


def shared_blocks(df: DataFrame, block: str, fold: str = "fold") -> DataFrame:
    """How many blocks are in more than one fold (zero for block folds)."""
    per = df.groupBy(block).agg((F.min(fold) != F.max(fold)).alias("_s"))
    return per.agg(F.count_if("_s").alias("shared"), F.count(F.lit(1)).alias("blocks"))


def outside(fold: str, k: int) -> dict[str, Column]:
    """One weight per fold: 1 for the rows outside it."""
    return {f"w{j}": (F.col(fold) != j).cast("long") for j in range(k)}


# --- metrics ------------------------------------------------------------------------

def price_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Errors in currency and in log, from a log target and a log prediction."""
    by = list(by)
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    truth = F.exp(F.col(y))
    error = F.abs(F.exp(F.col(p)) - truth)
    rest = F.sum(F.pow(F.col(y) - F.col(p), 2))
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(error).alias("mae"), F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2))).alias("rmse_log"),
        F.when(F.max(y) > F.min(y), 1 - rest / (F.var_pop(y) * F.count(F.lit(1)))).alias("r2_log"),
        F.avg(F.col(y) - F.col(p)).alias("bias_log"))
    middle = medians(rows, by, {"mdae": error, "mdape": error / truth})
    if by:
        return base.join(middle, by, "left")
    return base.withColumn("_k", F.lit(1)).join(middle.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")


def metrics_by_slices(df: DataFrame, y: str, p: str, dims: Sequence[str], min_n: int = 100) -> DataFrame:
    """Price metrics of every slice with enough rows, one dimension after the other."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("slice")) for d in dims])
    tall = df.select(y, p, F.explode(pairs).alias("s")).select(y, p, "s.*").where("slice IS NOT NULL")
    return price_metrics(tall, y, p, ["dimension", "slice"]).where(F.col("n") >= min_n)


def class_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """AUC, average precision, Brier score and the Brier score of the prevalence.

    Both areas come from counts of positives and negatives per distinct score.
    """
    by = list(by)
    rows = df.select(*by, F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p")).dropna()
    counts = value_counts(rows, by, "p", {"pos": F.col("y"), "neg": 1 - F.col("y")})
    run = running_totals(counts, by, "_v", ["pos", "neg"], splitters(rows, "p"))
    above = F.col("pos_total") - F.col("pos_before")
    wrong = F.col("neg_total") - F.col("neg_before")
    area = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    scores = run.groupBy(*by).agg(
        F.try_divide(area, F.max(F.col("pos_total").cast("double") * F.col("neg_total"))).alias("auc"),
        F.try_divide(F.sum(F.col("pos") * above / (above + wrong)), F.max("pos_total")).alias("pr_auc"))
    plain = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("prevalence"),
        F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"),
        (F.avg("y") * (1 - F.avg("y"))).alias("brier_baseline"))
    if by:
        return plain.join(scores, by, "left")
    return plain.withColumn("_k", F.lit(1)).join(scores.withColumn("_k", F.lit(1)), "_k").drop("_k")


# --- baselines -------------------------------------------------------------------------

def fold_medians(df: DataFrame, keys: Sequence[str], y: str, fold: str, k: int, name: str,
                 splits: Sequence[float] | None = None) -> DataFrame:
    """``keys`` and an array with, for every fold, the median of the rows outside it."""
    if splits is None:
        splits = splitters(df, y)
    counts = value_counts(df, keys, y, outside(fold, k))
    positions = {"lo": lambda n: F.floor((n - 1) / 2), "hi": lambda n: F.ceil((n - 1) / 2)}
    stats = order_statistics(counts, keys, "_v", [f"w{j}" for j in range(k)], positions, splits)
    values = [F.when(F.col(f"w{j}__n") > 0, interpolated(
        F.col(f"w{j}__n"), F.col(f"w{j}__lo"), F.col(f"w{j}__hi"), 0.5)) for j in range(k)]
    return stats.select(*keys, F.array(*values).alias(name))


def median_baseline(df: DataFrame, y: str, fold: str, ladder: Sequence[Sequence[str]], k: int = FOLDS,
                    name: str = "prediction") -> DataFrame:
    """Out-of-fold median by the finest key set known outside the fold, down to the global one."""
    out, tried, splits = df, [], splitters(df, y)
    for i, keys in enumerate(ladder):
        table = fold_medians(df.dropna(subset=list(keys)), list(keys), y, fold, k, f"_m{i}", splits)
        out = out.join(table, list(keys), "left")
        tried.append(F.col(f"_m{i}")[F.col(fold)])
    overall = one_row(fold_medians(df, [], y, fold, k, "m", splits))["m"]
    out = out.withColumn(name, F.coalesce(*tried, overall[F.col(fold)]))
    return out.select(*df.columns, name)


# --- conformal ---------------------------------------------------------------------------

def _tail_positions(level: float) -> dict:
    a = (1 - level) / 2
    return {"lo": lambda n: F.greatest(F.lit(0), F.floor((n + 1) * F.lit(a)) - 1),
            "hi": lambda n: F.least(n - 1, F.ceil((n + 1) * F.lit(1 - a)) - 1)}


def conformal_quantiles(df: DataFrame, residual: str, level: float, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., n, q_low, q_high)``: split-conformal residual quantiles with the finite-sample index."""
    by = list(by)
    r = missing_if_nan(residual)
    rows = df.withColumn("_r", r)
    stats = order_statistics(value_counts(rows, by, "_r"), by, "_v", ["c"], _tail_positions(level),
                             splitters(rows, "_r"))
    return stats.select(*by, F.col("c__n").alias("n"), F.col("c__lo").alias("q_low"), F.col("c__hi").alias("q_high"))


def _outside_quantiles(df: DataFrame, residual: str, fold: str, level: float, k: int, by: Sequence[str]) -> DataFrame:
    """Per class: arrays over folds of size and quantiles of the residuals outside each fold."""
    by = list(by)
    rows = df.withColumn("_r", missing_if_nan(residual))
    counts = value_counts(rows, by, "_r", outside(fold, k))
    stats = order_statistics(counts, by, "_v", [f"w{j}" for j in range(k)], _tail_positions(level),
                             splitters(rows, "_r"))
    return stats.select(*by, *[F.array(*[F.col(f"w{j}__{c}") for j in range(k)]).alias(c)
                               for c in ("n", "lo", "hi")])


def _coverage(rows: DataFrame, low: Column, high: Column, residual: str, by: Sequence[str]) -> DataFrame:
    r = F.col(residual)
    inside = rows.select(*by, F.coalesce((r >= low) & (r <= high), F.lit(False)).cast("double").alias("i"),
                         (high - low).alias("w"))
    return inside.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("i").alias("coverage"), F.avg("w").alias("mean_width_log"),
        F.avg(F.exp("w")).alias("mean_ratio"))


def honest_coverage(df: DataFrame, residual: str, fold: str, level: float, k: int = FOLDS,
                    by: Sequence[str] = ()) -> DataFrame:
    """Coverage of each fold by the interval calibrated on the other folds."""
    q = one_row(_outside_quantiles(df, residual, fold, level, k, []))
    rows = df.withColumn("_q", q)
    return _coverage(rows, F.col("_q.lo")[F.col(fold)], F.col("_q.hi")[F.col(fold)], residual, list(by))


def mondrian_quantiles(df: DataFrame, residual: str, cls: str, level: float, min_n: int = MIN_CLASS) -> DataFrame:
    """Quantiles per class; a class below ``min_n`` residuals takes the global pair."""
    rows = df.where(F.col(cls).isNotNull())
    per = conformal_quantiles(rows, residual, level, [cls])
    whole = one_row(conformal_quantiles(df, residual, level))
    own = F.col("n") >= min_n
    return per.withColumn("_g", whole).select(
        cls, "n", F.when(own, F.col("q_low")).otherwise(F.col("_g.q_low")).alias("q_low"),
        F.when(own, F.col("q_high")).otherwise(F.col("_g.q_high")).alias("q_high"))


def mondrian_coverage(df: DataFrame, residual: str, fold: str, cls: str, level: float, k: int = FOLDS,
                      min_n: int = MIN_CLASS, by: Sequence[str] = ()) -> DataFrame:
    """Honest coverage of the per-class intervals."""
    whole = one_row(_outside_quantiles(df, residual, fold, level, k, []))
    per = _outside_quantiles(df.where(F.col(cls).isNotNull()), residual, fold, level, k, [cls])
    rows = df.join(per.withColumnsRenamed({"n": "_n", "lo": "_lo", "hi": "_hi"}), cls, "left").withColumn("_g", whole)
    own = F.coalesce(F.col("_n")[F.col(fold)] >= min_n, F.lit(False))
    low = F.when(own, F.col("_lo")[F.col(fold)]).otherwise(F.col("_g.lo")[F.col(fold)])
    high = F.when(own, F.col("_hi")[F.col(fold)]).otherwise(F.col("_g.hi")[F.col(fold)])
    return _coverage(rows, low, high, residual, list(by))


# --- nights and revenue -----------------------------------------------------------------

def nights_metrics(df: DataFrame, y: str, p: str, cap: float = 255.0) -> DataFrame:
    """Errors of predicted nights (capped), rank correlation, means and the share at the cap."""
    from rentgrid.operators.audit import agreement
    rows = df.select(F.col(y).cast("double").alias("y"), F.least(F.col(p), F.lit(float(cap))).alias("p")).dropna()
    base = agreement(rows, "y", "p").select(
        "n", "mae", "spearman", F.col("mean_a").alias("mean_observed"), F.col("mean_b").alias("mean_predicted"))
    extra = rows.agg(F.avg((F.col("y") >= cap).cast("double")).alias("share_at_cap"))
    middle = medians(rows, [], {"mdae": F.abs(F.col("p") - F.col("y"))})
    out = base.withColumn("_k", F.lit(1))
    for t in (extra, middle):
        out = out.join(t.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def revenue_metrics(df: DataFrame, observed: Column, predicted: Column) -> DataFrame:
    """Median observed and predicted revenue, and their rank correlation."""
    from rentgrid.operators.panel import spearman
    rows = df.select(observed.alias("o"), predicted.alias("p")).dropna()
    middle = medians(rows, [], {"median_observed": F.col("o"), "median_predicted": F.col("p")})
    rho = spearman(rows, F.col("o"), F.col("p")).select("n", "spearman")
    return middle.withColumn("_k", F.lit(1)).join(rho.withColumn("_k", F.lit(1)), "_k").drop("_k")


def long_metrics(table: DataFrame, keys: Sequence[str], section: str) -> DataFrame:
    """A metrics table in long form: ``section, key, metric, value``."""
    values = [c for c, t in table.dtypes if c not in keys and t in ("double", "bigint", "int")]
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values])
    key = F.concat_ws(" | ", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
    return table.select(F.lit(section).alias("section"), key.alias("key"), F.explode(rows).alias("r")).select(
        "section", "key", "r.*")


def combine_metrics(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [long_metrics(t, keys, s) for s, (t, keys) in tables.items()])

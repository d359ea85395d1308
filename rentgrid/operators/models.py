"""Out-of-fold models on Spark ML: boosted trees, ridge, cluster-robust logit, transfer.

Fits are distributed by Spark ML. What the driver holds is a model: trees of bounded
depth, or matrices with one row per feature.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce
from statistics import NormalDist, median

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rentgrid.operators import boosting as B, validation as V
from rentgrid.operators.cells import require_unique
from rentgrid.operators.panel import share, spearman
from rentgrid.session import cut_lineage, shared_table

SENTINEL = -1e9
#: Fits that grow side by side, and the rows they may have together: each keeps ten bytes a row on the executors' disks.
PARALLEL_FITS, FITTED_ROWS = 40, 400_000_000
MAX_FEATURES = 2_000
#: Growth of the budget of trees while every one of them helps: a larger budget is fitted anew from the first tree on.
FALLING_GROWTH = 5


@dataclass(frozen=True)
class TreeParams:
    """Boosting settings; the number of trees is chosen by early stopping up to ``max_trees``."""

    max_trees: int = 3_000
    depth: int = 5
    step: float = 0.1
    min_rows: int = 30
    row_share: float = 0.8
    feature_share: float = 0.8
    #: Boosting ends when so many trees in a row did not lower the held-out error.
    patience: int = 100
    seed: int = V.SEED


#: Smaller and shallower, for the published product.
PRODUCT = TreeParams(max_trees=600, depth=4, step=0.15, min_rows=40)


@dataclass
class OutOfFold:
    """Predictions of rows no model has seen, and what each fold chose."""

    predictions: DataFrame
    trees: list[int]
    importance: dict[str, float]
    models: list = field(default_factory=list, repr=False)

    @property
    def n_trees(self) -> int:
        return max(1, int(median(self.trees)))


# --- features ------------------------------------------------------------------------

def fill_missing(df: DataFrame, columns: Sequence[str], sentinel: float = SENTINEL) -> tuple[DataFrame, list[str]]:
    """A sentinel below every value plus a ``_missing`` flag, so trees can split on absence."""
    out = []
    for c in columns:
        x = F.col(c).cast("double")
        gone = x.isNull() | F.isnan(x)
        out += [F.when(gone, F.lit(sentinel)).otherwise(x).alias(c), gone.cast("double").alias(c + "_missing")]
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, *out), [n for c in columns for n in (c, c + "_missing")]


def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    filled, names = fill_missing(df.select(*dict.fromkeys([*keep, *features])),
                                 [f for f in features if f not in keep])
    fixed = [f for f in features if f in keep]
    vector = VectorAssembler(inputCols=[*names, *fixed], outputCol="features")
    return vector.transform(filled).select(*keep, "features"), [*names, *fixed]


def validation_blocks(df: DataFrame, block: str, fold: str, k: int, part: float = 0.15, seed: int = V.SEED) -> DataFrame:
    """``(block, held)``: the folds whose *training* keeps this block aside for early stopping.

    Only rows outside the test fold are ever held: with block folds a block is never
    held for its own fold, with random folds its training rows are.
    """
    blocks = df.groupBy(block).agg(F.min(fold).alias("f"), F.max(fold).alias("g"))
    folds = blocks.select(block, "f", "g", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j")).where(
        "f <> j OR g <> j")
    # one row per block and fold: blocks, not data rows, share this window
    order = Window.partitionBy("j").orderBy(F.xxhash64(F.col(block), F.col("j"), F.lit(seed)), F.col(block))
    size = F.count(F.lit(1)).over(Window.partitionBy("j"))
    chosen = folds.withColumn("i", F.row_number().over(order)).withColumn(
        "m", F.greatest(F.lit(1), F.round(part * size).cast("int"))).where("i <= m")
    return chosen.groupBy(block).agg(F.array_sort(F.collect_list("j")).alias("held"))


def _estimator(p: TreeParams, classifier: bool, trees: int):
    cls = GBTClassifier if classifier else GBTRegressor
    return cls(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=p.depth, stepSize=p.step,
               minInstancesPerNode=p.min_rows, subsamplingRate=p.row_share,
               featureSubsetStrategy=str(p.feature_share), seed=p.seed)


def best_tree(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """``(trees, ended)``: the trees with the least error before ``patience`` trees in a row brought none lower.

    Not ended means that the errors stop before the patience does. At least one tree is kept.
    """
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(spark: SparkSession, model, trees: int):
    """The boosted model cut after its first ``trees`` trees."""
    if trees >= model.getNumTrees:
        return model
    context = spark.sparkContext
    jvm, new_array = context._jvm, context._gateway.new_array
    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    parts = new_array(kind, trees), new_array(jvm.double, trees)
    for i, (tree, weight) in enumerate(zip(model._java_obj.trees(), model.treeWeights[:trees])):
        if i == trees:
            break
        parts[0][i], parts[1][i] = tree, float(weight)
    if isinstance(model, GBTClassificationModel):
        cut = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(
            model.uid, *parts, model.numFeatures, model.numClasses))
    else:
        cut = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(model.uid, *parts, model.numFeatures))
    return model._copyValues(cut)


def boosted(grow: DataFrame, held: DataFrame, params: TreeParams, classifier: bool):
    """A boosted model of ``features`` and ``label``, cut at the tree with the least error on the ``held`` rows.

    The error after every tree comes from one pass over the held rows. The budget
    starts just above the patience and doubles while the error is still falling near its end, or grows
    ``FALLING_GROWTH`` times where its last tree was the best; the trees of a smaller budget are the first ones
    of a larger, so this only costs a second fit of them. Without held rows the first budget is kept.
    """
    budget = min(params.max_trees, params.patience + 1)
    seen = held.first() is not None
    while True:
        model = _estimator(params, classifier, budget).fit(grow)
        if not seen:
            return model
        errors = model.evaluateEachIteration(held) if classifier else model.evaluateEachIteration(held, "squared")
        trees, ended = best_tree(errors, params.patience)
        if ended or budget >= params.max_trees:
            return first_trees(grow.sparkSession, model, trees)
        budget = min(params.max_trees, max((FALLING_GROWTH if trees == budget else 2) * budget, trees + params.patience))


def predicted(model, rows: DataFrame, classifier: bool, name: str) -> DataFrame:
    out = model.transform(rows)
    if classifier:
        return out.withColumn(name, vector_to_array("probability")[1])
    return out.withColumn(name, F.col("prediction"))


@dataclass(frozen=True)
class FoldTable:
    """Assembled rows with folds and the blocks held in each, written once for all fits over them."""

    rows: DataFrame
    names: list[str]
    id_column: str
    fold: str
    k: int

    def at_once(self) -> int:
        """How many fits of these rows grow side by side; more rows mean fewer, so that their states do not fill the disk."""
        return max(1, min(PARALLEL_FITS, FITTED_ROWS // max(1, self.rows.count())))

    def columns(self, features: Sequence[str]) -> list[str]:
        wanted = set(features) | {f + "_missing" for f in features}
        return [n for n in self.names if n in wanted]


def fold_table(df: DataFrame, id_column: str, features: Sequence[str], y: str, fold: str, block: str,
               k: int = V.FOLDS, seed: int = V.SEED) -> FoldTable:
    keep = list(dict.fromkeys([id_column, y, fold, block]))
    filled, filled_names = fill_missing(df.where(F.col(y).isNotNull()).select(*dict.fromkeys([*keep, *features])),
                                        [f for f in features if f not in keep])
    names = [*filled_names, *[f for f in features if f in keep]]
    # a table, so that its size is known and the rows need not move to meet it
    held = shared_table(validation_blocks(filled, block, fold, k, seed=seed), "held-blocks")
    # read to bin the rows and to predict them; vectors are put together when a model asks for them
    rows = shared_table(filled.join(held, block, "left").withColumn("label", F.col(y).cast("double")), "fold-rows")
    return FoldTable(VectorAssembler(inputCols=names, outputCol="features").transform(rows), names, id_column, fold, k)


def fit_steps(table: FoldTable, steps: Sequence[tuple[Sequence[str], TreeParams]], classifier: bool = False,
              name: str = "oof") -> list[OutOfFold]:
    """``fit_folds`` of several feature lists and settings; all folds of all of them grow side by side over rows binned once."""
    columns = [table.columns(features) for features, _ in steps]
    fits = [B.Fit(tuple(table.names.index(n) for n in names), params, classifier, j)
            for names, (_, params) in zip(columns, steps) for j in range(table.k)]
    binned = B.Rows(table.rows, table.names, F.col("label"), F.col(table.id_column), F.col(table.fold), "held", table.k,
                    max(p.depth for _, p in steps))
    try:
        size = table.at_once()
        grown = [g for i in range(0, len(fits), size) for g in binned.grow(fits[i:i + size], best_tree)]
    finally:
        binned.close()
    out = []
    for i, (names, (_, params)) in enumerate(zip(columns, steps)):
        models = [B.model(table.rows.sparkSession.sparkContext, _estimator(params, classifier, params.max_trees), g, binned.layout.cuts, classifier)
                  for g in grown[i * table.k:(i + 1) * table.k]]
        out.append(out_of_fold(table, names, models, classifier, name))
    return out


def out_of_fold(table: FoldTable, names: Sequence[str], models: Sequence, classifier: bool, name: str) -> OutOfFold:
    """Every fold predicted by its model, which has not seen it."""
    rows = table.rows
    if names != table.names:
        places = [table.names.index(n) for n in names]
        rows = (VectorSlicer(inputCol="features", outputCol="__sliced", indices=places).transform(rows)
                .drop("features").withColumnRenamed("__sliced", "features"))
    parts = [predicted(m, rows.where(F.col(table.fold) == j), classifier, name).select(table.id_column, table.fold, name)
             for j, m in enumerate(models)]
    gains = sum(m.featureImportances.toArray() for m in models) / table.k
    return OutOfFold(reduce(DataFrame.unionByName, parts), [m.getNumTrees for m in models],
                     dict(zip(names, map(float, gains))), list(models))


def fit_folds(table: FoldTable, features: Sequence[str], params: TreeParams = TreeParams(), classifier: bool = False,
              name: str = "oof") -> OutOfFold:
    """Predict every fold with trees grown on the others, stopped early on held-out training blocks."""
    return fit_steps(table, [(features, params)], classifier, name)[0]


def gbt_oof(df: DataFrame, id_column: str, features: Sequence[str], y: str, fold: str, block: str,
            k: int = V.FOLDS, params: TreeParams = TreeParams(), classifier: bool = False,
            name: str = "oof") -> OutOfFold:
    """``fit_folds`` over the rows of ``df`` that have a ``y``."""
    return fit_folds(fold_table(df, id_column, features, y, fold, block, k, params.seed), features, params, classifier, name)


def gbt_final(df: DataFrame, features: Sequence[str], y: str, trees: int, params: TreeParams = TreeParams(),
              classifier: bool = False):
    """Model on all rows with the number of trees the folds chose; returns ``(model, feature names)``."""
    filled, names = fill_missing(df.where(F.col(y).isNotNull()).select(*dict.fromkeys([y, *features])),
                                 [f for f in features if f != y])
    names = [*names, *[f for f in features if f == y]]
    table = shared_table(filled.withColumn("label", F.col(y).cast("double")), "final-rows")
    binned = B.Rows(table, names, F.col("label"), depth=params.depth)
    try:
        grown = binned.grow([B.Fit(tuple(range(len(names))), params, classifier, trees=trees)], best_tree)[0]
    finally:
        binned.close()
    return B.model(df.sparkSession.sparkContext, _estimator(params, classifier, trees), grown, binned.layout.cuts, classifier), names


def apply_model(model, df: DataFrame, features: Sequence[str], keep: Sequence[str], name: str = "prediction",
                classifier: bool = False) -> DataFrame:
    rows, _ = assemble(df, features, list(keep))
    return predicted(model, rows, classifier, f"_{name}").select(*keep, F.col(f"_{name}").alias(name))


# --- linear models ---------------------------------------------------------------------

def gram(df: DataFrame, columns: Sequence[Column], weight: Column | None = None, by: str | None = None) -> dict:
    """Sums of products ``X'WX`` per group of ``by`` (few groups), as matrices on the driver.

    Tasks add up their rows and emit one matrix per group; Spark adds the matrices.
    """
    m = len(columns)
    if m > MAX_FEATURES:
        raise ValueError(f"a product matrix of {m} columns does not belong on the driver")
    rows = df.select((F.col(by) if by else F.lit(0)).cast("int").alias("g"),
                     (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"),
                     *[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    names = [f"x{i}" for i in range(m)]
    upper = np.triu_indices(m)

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for g, part in pdf.groupby("g"):
                x = part[names].to_numpy(dtype=float)
                sums[g] = sums.get(g, 0) + (x * part["w"].to_numpy()[:, None]).T @ x
        for g, s in sums.items():
            yield pd.DataFrame({"g": np.int32(g), "pos": np.arange(len(upper[0]), dtype=np.int32), "v": s[upper]})

    total = rows.mapInPandas(partial, "g int, pos int, v double").groupBy("g", "pos").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in total.collect():                       # groups x m^2/2 numbers
        a = out.setdefault(r["g"], np.zeros((m, m)))
        i, j = upper[0][r["pos"]], upper[1][r["pos"]]
        a[i, j] = a[j, i] = r["v"]
    return out


def levels_of(df: DataFrame, column: str, limit: int = 1_000) -> list:
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} levels")
    return sorted(found)


ALPHAS = tuple(float(a) for a in np.logspace(-2, 3, 12))


def ridge_path(g: np.ndarray, scaled: np.ndarray, alphas: Sequence[float] = ALPHAS) -> tuple[np.ndarray, float, float]:
    """Ridge from the products of ``[1, X, y]``: coefficients (intercept first), alpha, criterion.

    Columns marked in ``scaled`` are divided by their deviation, as a scaler would.
    Alpha minimises the generalised cross-validation error.
    """
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] - n * np.outer(mean, mean)
    xx, xy, yy = cov[:-1, :-1], cov[:-1, -1], cov[-1, -1]
    sd = np.sqrt(np.maximum(np.diag(xx), 0) / n)
    unit = np.where(scaled & (sd > 1e-12), sd, 1.0)
    xs, ys = xx / np.outer(unit, unit), xy / unit
    values, vectors = np.linalg.eigh(xs)
    values = np.maximum(values, 0)
    rotated = vectors.T @ ys
    best = None
    for a in alphas:
        b = rotated / (values + a)
        rss = yy - 2 * b @ rotated + (b * b) @ values
        used = 1 + np.sum(values / (values + a))
        gcv = n * max(rss, 0) / max(n - used, 1) ** 2
        if best is None or gcv < best[1]:
            best = (a, gcv, b)
    coef = (vectors @ best[2]) / unit
    return np.concatenate([[mean[-1] - mean[:-1] @ coef], coef]), best[0], best[1]


def hedonic_oof(df: DataFrame, id_column: str, numeric: Sequence[str], categorical: Sequence[str], y: str,
                fold: str, k: int = V.FOLDS, name: str = "oof", alphas: Sequence[float] = ALPHAS) -> OutOfFold:
    """Ridge on the log target: median imputation with flags, scaling, one-hot; every fold from one pass.

    The products of all columns are summed per fold once. Training without fold j is
    the total minus that fold, and imputing a median is a linear change of columns,
    so no fold reads the data again.
    """
    rows = df.where(F.col(y).isNotNull())
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numeric}
    flags = {c: F.when(x.isNull(), 1.0).otherwise(0.0) for c, x in clean.items()}
    levels = {c: levels_of(rows, c) for c in categorical}
    dummies = [F.when(F.col(c) == v, 1.0).otherwise(0.0) for c, vs in levels.items() for v in vs]
    raw = [F.coalesce(clean[c], F.lit(0.0)) for c in numeric] + [flags[c] for c in numeric] + dummies
    products = gram(rows, [F.lit(1.0), *raw, F.col(y)], by=fold)
    total = sum(products.values())
    p, q = len(numeric), len(raw)
    scaled = np.array([True] * (2 * p) + [False] * (q - 2 * p))
    middles = {}
    for c in numeric:
        table = V.fold_medians(rows.withColumn("_c", clean[c]).where("_c IS NOT NULL"), [], "_c", fold, k, "m")
        middles[c] = (table.first() or {"m": [0.0] * k})["m"] or [0.0] * k
    pieces, chosen = [], []
    for j in range(k):
        change = np.eye(q + 2)
        for i, c in enumerate(numeric):             # x + median * missing
            change[1 + p + i, 1 + i] = middles[c][j] or 0.0
        train = change.T @ (total - products.get(j, 0)) @ change
        coef, alpha, _ = ridge_path(train, scaled, alphas)
        back = coef.copy()
        for i, c in enumerate(numeric):
            back[1 + p + i] += coef[1 + i] * (middles[c][j] or 0.0)
        chosen.append(alpha)
        terms = [F.lit(float(b)) * x for b, x in zip(back[1:], raw) if b != 0]
        pieces.append(reduce(lambda a, b: a + b, terms, F.lit(float(back[0]))))
    prediction = F.coalesce(*[F.when(F.col(fold) == j, e) for j, e in enumerate(pieces)])
    out = rows.select(id_column, fold, prediction.alias(name))
    return OutOfFold(out, [1] * k, {f"alpha_{j}": a for j, a in enumerate(chosen)})


#: Times a Newton step is halved before the search ends.
HALVINGS = 30


def logit_cluster(df: DataFrame, features: Mapping[str, Column], y: Column, cluster: str, level: float = 0.95,
                  steps: int = 25, tolerance: float = 1e-10) -> DataFrame:
    """Logit with cluster-robust covariance: odds ratios, intervals, p and pseudo R squared.

    Newton steps, each one pass that sums gradient and Hessian; the meat sums the
    scores per cluster first, so a large cluster is combined before it is shuffled.
    A step that lowers the likelihood is halved. Rows with a missing feature are left out.

    ``converged`` is false where the steps ran out or none raised the likelihood;
    ``separated`` is true where every row of both outcomes is told apart, so that no
    finite estimate exists and coefficients and errors mean nothing. Rows of only one
    outcome raise an error. Repeated or constant features share their effect.
    """
    names = ["const", *features]
    table = df.select(F.col(cluster).alias("_g"), y.cast("double").alias("_y"), F.lit(1.0).alias("f0"),
                      *[c.cast("double").alias(f"f{i}") for i, c in enumerate(features.values(), 1)]).dropna()
    table = cut_lineage(table)
    columns = [F.col(f"f{i}") for i in range(len(names))]
    beta = np.zeros(len(names))
    n, groups, prevalence = table.agg(F.count(F.lit(1)), F.count_distinct("_g"), F.avg("_y")).first()
    if not n or prevalence in (0.0, 1.0):
        raise ValueError("a logit needs rows of both outcomes")

    def linear(b: np.ndarray) -> Column:
        return reduce(lambda a, c: a + c, [F.lit(float(v)) * x for v, x in zip(b, columns)])

    def likelihood(b: np.ndarray) -> float:
        t = linear(b)                                          # log(1 + exp(t)) without overflow
        return table.agg(F.sum(F.col("_y") * t - F.greatest(t, F.lit(0.0)) - F.log1p(F.exp(-F.abs(t))))).first()[0]

    loglik, converged = likelihood(beta), False
    for _ in range(steps):
        p = 1 / (1 + F.exp(-linear(beta)))
        hessian = gram(table, columns, weight=p * (1 - p))[0]
        row = table.agg(*[F.sum((F.col("_y") - p) * x).alias(f"s{i}") for i, x in enumerate(columns)]).first()
        gradient = np.array([row[f"s{i}"] for i in range(len(names))])
        move = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        if np.max(np.abs(move)) < tolerance * max(1.0, np.max(np.abs(beta))):
            beta, converged = beta + move, True
            break
        # the step is halved while it lowers the likelihood (by more than rounding)
        for half in range(HALVINGS):
            tried = likelihood(beta + move / 2 ** half)
            if tried >= loglik - 1e-12 * abs(loglik):
                break
        else:
            break
        beta, loglik = beta + move / 2 ** half, tried
    if converged:
        loglik = likelihood(beta)
    # separated outcomes: a direction in which every row of both outcomes is told right, so odds grow without end
    margin = F.when(F.col("_y") > 0, linear(beta)).otherwise(-linear(beta))
    separated = not converged and table.agg(F.min(margin)).first()[0] > 0
    p = 1 / (1 + F.exp(-linear(beta)))
    hessian = gram(table, columns, weight=p * (1 - p))[0]
    scores = table.groupBy("_g").agg(*[F.sum((F.col("_y") - p) * x).alias(f"s{i}") for i, x in enumerate(columns)])
    meat = gram(scores, [F.col(f"s{i}") for i in range(len(names))])[0]
    bread = np.linalg.pinv(hessian, hermitian=True)
    k = len(names)
    covariance = bread @ meat @ bread * (groups / max(groups - 1, 1)) * ((n - 1) / max(n - k, 1))
    null = n * (prevalence * math.log(prevalence) + (1 - prevalence) * math.log(1 - prevalence))
    z = NormalDist().inv_cdf(0.5 + level / 2)
    rows = []
    for name, b, v in zip(names, beta, np.diag(covariance)):
        se = math.sqrt(max(v, 0.0))
        low, mid, high = (math.exp(min(700.0, x)) for x in (b - z * se, b, b + z * se))
        tail = math.erfc(abs(b / se) / math.sqrt(2)) if se else None
        rows.append((name, float(b), se, mid, low, high, tail, int(n), int(groups), float(1 - loglik / null), converged, separated))
    return df.sparkSession.createDataFrame(
        rows, "term string, coef double, se double, odds_ratio double, ci_low double, ci_high double, "
              "p double, n long, clusters long, pseudo_r2 double, converged boolean, separated boolean")


# --- protocols ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Step:
    """One rung of a ladder: a model kind and the columns it may use."""

    kind: str                       # "median", "ridge" or "trees"
    features: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    keys: tuple[tuple[str, ...], ...] = ()
    params: TreeParams = TreeParams()


def ladder(df: DataFrame, steps: Mapping[str, Step], id_column: str, y: str, fold: str, block: str,
           k: int = V.FOLDS) -> tuple[DataFrame, dict[str, OutOfFold]]:
    """Out-of-fold predictions of every step beside ``id, y, fold``; ``id`` must be unique.

    All tree steps read one table, binned once, and take their features from it; their
    folds grow side by side. The predictions are stacked and meet in one aggregate by id.
    """
    base = require_unique(df.select(id_column, y, fold), id_column)
    trees = [s for s in steps.values() if s.kind not in ("median", "ridge")]
    features = list(dict.fromkeys(f for s in trees for f in s.features))
    table = fold_table(df, id_column, features, y, fold, block, k, trees[0].params.seed) if trees else None
    parts, fits = [], {}
    with ThreadPoolExecutor(1) as rungs:
        fitted = rungs.submit(fit_steps, table, [(s.features, s.params) for s in trees], False, "p") if trees else None
        for name, s in steps.items():
            if s.kind == "median":
                p = V.median_baseline(df, y, fold, [list(x) for x in s.keys], k, "p")
            elif s.kind == "ridge":
                fits[name] = hedonic_oof(df, id_column, s.features, s.categorical, y, fold, k, "p")
                p = fits[name].predictions
            else:
                fits[name] = fitted.result()[[t is s for t in trees].index(True)]
                p = fits[name].predictions
            parts.append(p.select(id_column, F.lit(name).alias("__step"), F.col("p").cast("double").alias("__p")))
    tall = reduce(DataFrame.unionByName, parts)
    wide = tall.groupBy(id_column).agg(*[F.max(F.when(F.col("__step") == n, F.col("__p"))).alias(f"oof_{n}") for n in steps])
    return shared_table(base.join(wide, id_column, "left"), "out-of-fold"), fits


def ladder_metrics(oof: DataFrame, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Price metrics of every ``oof_*`` column."""
    names = [c for c in oof.columns if c.startswith("oof_")]
    pairs = F.array(*[F.struct(F.lit(n[4:]).alias("model"), F.col(n).alias("p")) for n in names])
    tall = oof.select(*by, y, F.explode(pairs).alias("m")).select(*by, y, "m.*")
    return V.price_metrics(tall, y, "p", ["model", *by])


def paired_change(by_fold: DataFrame, overall: DataFrame, base: str) -> DataFrame:
    """Change of MdAPE and MAE against one model, and in how many folds it got worse."""
    def against(t: DataFrame, keys: Sequence[str]) -> DataFrame:
        ref = t.where(F.col("model") == base).select(*keys, F.col("mdape").alias("b_mdape"), F.col("mae").alias("b_mae"))
        rest = t.where(F.col("model") != base)
        if keys:
            return rest.join(ref, list(keys))
        return rest.withColumn("_k", F.lit(1)).join(ref.withColumn("_k", F.lit(1)), "_k").drop("_k")
    folds = against(by_fold, ["fold"]).groupBy("model").agg(
        F.count_if(F.col("mdape") > F.col("b_mdape")).alias("folds_worse"))
    total = against(overall, []).select(
        "model", (100 * (F.col("mdape") - F.col("b_mdape"))).alias("delta_mdape_pp"),
        (F.col("mae") - F.col("b_mae")).alias("delta_mae"))
    return total.join(folds, "model", "left").orderBy(F.desc("delta_mdape_pp"))


def ablation(df: DataFrame, features: Sequence[str], groups: Mapping[str, Sequence[str]], id_column: str, y: str,
             fold: str, block: str, k: int = V.FOLDS, params: TreeParams = TreeParams()) -> DataFrame:
    """Leave one source group out at a time; positive change means the group helped."""
    steps = {"base": Step("trees", tuple(features), params=params)}
    for g, columns in groups.items():
        steps[g] = Step("trees", tuple(f for f in features if f not in columns), params=params)
    oof, _ = ladder(df, steps, id_column, y, fold, block, k)
    return paired_change(ladder_metrics(oof, y, [fold]).withColumnRenamed(fold, "fold"), ladder_metrics(oof, y), "base")


def optimism(df: DataFrame, features: Sequence[str], id_column: str, y: str, fold: str, block: str,
             k: int = V.FOLDS, params: TreeParams = TreeParams()) -> DataFrame:
    """The same trees under blocked and under random folds."""
    rand = V.random_folds(df.drop(fold), id_column, k, name=fold)
    out = []
    for name, rows in (("blocked", df), ("random", rand)):
        fit = gbt_oof(rows, id_column, features, y, fold, block, k, params)
        joined = rows.select(id_column, y).join(fit.predictions, id_column)
        out.append(V.price_metrics(joined, y, "oof").withColumn("folds", F.lit(name)))
    return out[0].unionByName(out[1])


def importance_table(spark, importance: Mapping[str, float], groups: Mapping[str, str]) -> DataFrame:
    """Importance per feature with its source group; a missing flag counts for its feature."""
    rows: dict[str, float] = {}
    for f, v in importance.items():
        f = f.removesuffix("_missing")
        rows[f] = rows.get(f, 0.0) + v
    return spark.createDataFrame([(f, groups.get(f, "listing"), float(v)) for f, v in rows.items()],
                                 "feature string, source string, importance double")


def permutation_importance(model, df: DataFrame, features: Sequence[str], id_column: str, y: str,
                           seed: int = V.SEED) -> DataFrame:
    """Rise of the log RMSE when one feature is handed to other rows, for every feature.

    The shuffle pairs each row with the value of the row at the same place in another
    hash order, so it keeps the distribution and needs no global order.
    """
    from rentgrid.operators.ranks import global_index
    base = cut_lineage(global_index(df.where(F.col(y).isNotNull()).select(id_column, y, *features),
                                    F.xxhash64(F.col(id_column), F.lit(seed))).drop("n"))
    rows = base.withColumn("feature", F.lit("")).select("feature", id_column, y, *features)
    tables = [rows]
    for i, f in enumerate(features):
        other = global_index(base.select(id_column, F.col(f).alias("_v")),
                             F.xxhash64(F.col(id_column), F.lit(seed + 1 + i))).select("idx", "_v")
        moved = base.join(other, "idx").select(F.lit(f).alias("feature"), id_column, y, *[
            F.col("_v").alias(c) if c == f else F.col(c) for c in features])
        tables.append(moved)
    scored = apply_model(model, reduce(DataFrame.unionByName, tables), features, ["feature", y])
    errors = scored.groupBy("feature").agg(F.sqrt(F.avg(F.pow(F.col(y) - F.col("prediction"), 2))).alias("rmse"))
    plain = errors.where("feature = ''").select(F.col("rmse").alias("_b"), F.lit(1).alias("_k"))
    return errors.where("feature <> ''").withColumn("_k", F.lit(1)).join(plain, "_k").select(
        "feature", (F.col("rmse") - F.col("_b")).alias("rmse_rise"))


def transfer(a: DataFrame, b: DataFrame, features: Sequence[str], id_column: str, y: str, fold: str, block: str,
             k: int = V.FOLDS, params: TreeParams = TreeParams()) -> tuple[DataFrame, DataFrame]:
    """Train on one snapshot, score the other, each against its own blocked folds.

    Returns the metrics table (``setting``, with ``drift_mdape_pp`` on the transfers)
    and the second snapshot with the first one's predictions.
    """
    parts, fits, finals = {}, {}, {}
    for name, rows in (("a", a), ("b", b)):
        fits[name] = gbt_oof(rows, id_column, features, y, fold, block, k, params)
        own = rows.select(id_column, y).join(fits[name].predictions, id_column)
        parts[f"{name}_in_{name}"] = V.price_metrics(own, y, "oof")
        finals[name] = gbt_final(rows, features, y, fits[name].n_trees, params)[0]
    keep = [id_column, y]
    onto_b = cut_lineage(apply_model(finals["a"], b, features, keep))
    parts["a_in_b"] = V.price_metrics(onto_b, y, "prediction")
    parts["b_in_a"] = V.price_metrics(apply_model(finals["b"], a, features, keep), y, "prediction")
    table = reduce(DataFrame.unionByName, [t.withColumn("setting", F.lit(n)) for n, t in parts.items()])
    reference = table.where(F.col("setting").isin("a_in_a", "b_in_b")).select(
        F.substring("setting", 1, 1).alias("_on"), F.col("mdape").alias("_own"))
    on = F.substring("setting", 6, 1)
    out = table.withColumn("_on", on).join(reference, "_on").withColumn(
        "drift_mdape_pp", F.when(~F.col("setting").isin("a_in_a", "b_in_b"), 100 * (F.col("mdape") - F.col("_own"))))
    return out.drop("_on", "_own"), onto_b


def transfer_by(scored: DataFrame, y: str, prediction: str, strata: Sequence[str], min_n: int = 100) -> DataFrame:
    """Transfer errors and bias per stratum with enough rows."""
    return V.price_metrics(scored, y, prediction, strata).where(F.col("n") >= min_n)


def appreciation(df: DataFrame, cell: str, residual: str, long_stay: str, min_n: int = 5) -> DataFrame:
    """Mean residual per cell over all rows and inside the long-stay stratum, which is the published one."""
    long = F.col(long_stay)
    cells = df.where(F.col(cell).isNotNull()).groupBy(cell).agg(
        F.count(F.lit(1)).alias("n"), F.avg(residual).alias("residual_all"),
        F.count_if(long).alias("n_long"), F.avg(F.when(long, F.col(residual))).alias("residual_long"),
        share(~long).alias("short_share"))
    return cells.withColumn("appreciation_pct", F.when(
        F.col("n_long") >= min_n, 100 * (F.exp("residual_long") - 1)))


def appreciation_check(cells: DataFrame) -> DataFrame:
    """Does the metric follow the short-stay share? Rank correlation before and after stratifying."""
    before = spearman(cells, F.col("residual_all"), F.col("short_share")).select(
        F.lit("all").alias("variant"), "n", "spearman")
    after = spearman(cells, F.col("residual_long"), F.col("short_share")).select(
        F.lit("long_stay").alias("variant"), "n", "spearman")
    return before.unionByName(after)


def survival_cells(df: DataFrame, cell: str, survived: str, prediction: str, min_n: int = 5) -> DataFrame:
    """Observed and predicted survival per cell, both NULL below ``min_n`` rows."""
    cells = df.where(F.col(cell).isNotNull()).groupBy(cell).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(survived).cast("double")).alias("observed"),
        F.avg(prediction).alias("predicted"))
    return cells.select(cell, "n", *[F.when(F.col("n") >= min_n, F.col(c)).alias(c) for c in ("observed", "predicted")])


def criteria(metrics: DataFrame, coverage: DataFrame, by_fold: DataFrame, baseline: str, plain: str, full: str,
             product: str) -> DataFrame:
    """Acceptance numbers from the metrics tables: ``(criterion, value)``."""
    def pick(name: str, column: str) -> Column:
        return F.max(F.when(F.col("model") == name, F.col(column)))
    row = metrics.agg((100 * (1 - pick(product, "mae") / pick(baseline, "mae"))).alias("C1_mae_vs_baseline_pct"),
                      pick(product, "mdape").alias("C2_mdape_product"),
                      (100 * (pick(full, "mdape") - pick(plain, "mdape"))).alias("C4_delta_mdape_pp"))
    folds = by_fold.groupBy("fold").agg((pick(full, "mdape") < pick(plain, "mdape")).alias("better")).agg(
        F.count_if("better").cast("double").alias("C4_folds_improved"))
    cover = coverage.agg(F.avg("coverage").alias("C3_coverage"))
    tables = [row, folds, cover]
    long = [t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).cast("double").alias("value"))
                                         for c in t.columns])).alias("r")).select("r.*") for t in tables]
    return reduce(DataFrame.unionByName, long)



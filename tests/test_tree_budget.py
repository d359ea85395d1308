from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from rentgrid.operators import models as M
from rentgrid.plans import modelling as P


def table(spark, x, y):
    rows = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "x array<double>, label double").coalesce(4)
    return rows.select(array_to_vector("x").alias("features"), "label").cache()


@pytest.fixture(scope="module")
def hidden(spark):
    """One feature of twelve matters, and a tree sees one at a time: most trees lower no error."""
    draw = np.random.default_rng(4)
    x = draw.normal(size=(4000, 12))
    y = 3 * np.sin(2 * x[:, 0]) + draw.normal(size=4000)
    return table(spark, x[:3000], y[:3000]), table(spark, x[3000:], y[3000:])


SMALL = M.TreeParams(max_trees=200, depth=3, step=0.3, min_rows=5, feature_share=0.08, patience=25)


def test_patience_walks_over_flat_stretches():
    assert M.best_tree([5, 4, 4, 4, 3, 3, 3, 3], 3) == (5, True)
    assert M.best_tree([5, 4, 4, 4, 4, 3], 3) == (2, True)       # the lower one comes too late
    assert M.best_tree([5, 4, 3], 3) == (3, False)
    assert M.best_tree([5, 6, 7, 8], 3) == (1, True)
    assert M.best_tree([float("nan")] * 4, 3) == (1, True)


def test_more_trees_are_kept_where_single_trees_bring_nothing(spark, hidden):
    grow, held = hidden
    model = M.boosted(grow, held, SMALL, False)
    both = grow.withColumn("v", F.lit(False)).union(held.withColumn("v", F.lit(True)))
    first_flat = GBTRegressor(maxIter=200, maxDepth=3, stepSize=0.3, minInstancesPerNode=5, subsamplingRate=0.8, featureSubsetStrategy="0.08",
                              seed=SMALL.seed, validationIndicatorCol="v", validationTol=1e-4).fit(both)
    assert model.getNumTrees > 3 * first_flat.getNumTrees
    error = RegressionEvaluator(metricName="mse")
    assert error.evaluate(model.transform(held)) < 0.6 * error.evaluate(first_flat.transform(held))


def test_the_cut_model_is_the_prefix_with_the_least_error(spark, hidden):
    grow, held = hidden
    whole = M._estimator(SMALL, False, 30).fit(grow)
    errors = whole.evaluateEachIteration(held, "squared")
    for n in (1, 7, 30):
        cut = M.first_trees(spark, whole, n)
        assert cut.getNumTrees == n and cut.numFeatures == 12
        assert RegressionEvaluator(metricName="mse").evaluate(cut.transform(held)) == pytest.approx(errors[n - 1])
        again = M._estimator(SMALL, False, n).fit(grow)            # a smaller budget grows the same first trees
        assert RegressionEvaluator(metricName="mse").evaluate(again.transform(held)) == pytest.approx(errors[n - 1])
    model = M.boosted(grow, held, replace(SMALL, max_trees=40, patience=40), False)
    assert model.getNumTrees == 1 + int(np.argmin(M._estimator(SMALL, False, 40).fit(grow).evaluateEachIteration(held, "squared")))


def test_noise_keeps_the_first_tree(spark):
    draw = np.random.default_rng(5)
    noise = M.TreeParams(depth=5, step=0.5, min_rows=1, patience=8)
    grow, held = (table(spark, draw.normal(size=(n, 4)), draw.normal(size=n)) for n in (600, 400))
    assert M.boosted(grow, held, noise, False).getNumTrees == 1


def test_classes_and_missing_held_rows(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(1200, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    small = M.TreeParams(max_trees=60, depth=3, step=0.2, min_rows=5, patience=10)
    grow, held = table(spark, x[:900], y[:900]), table(spark, x[900:], y[900:])
    model = M.boosted(grow, held, small, True)
    assert model.numClasses == 2 and 5 < model.getNumTrees <= 60
    right = model.transform(held).where("prediction = label").count()
    assert right > 270
    assert M.boosted(grow, held.limit(0), small, True).getNumTrees == 11


def test_budgets_of_the_operators_and_of_the_registered_queries():
    """The operators have the whole budget; the registered queries have the same settings with a smaller one (README)."""
    assert M.TreeParams().max_trees == 3_000 and M.TreeParams().patience == 100 and M.PRODUCT.max_trees == 600
    trees = {n: s.params for n, s in P.STEPS.items() if n.startswith("M") and n != "M1"}
    assert all(p in (P.FULL, P.PRODUCT) for p in trees.values())
    assert replace(P.FULL, max_trees=3_000, patience=100) == M.TreeParams() and replace(P.PRODUCT, max_trees=600, patience=100) == M.PRODUCT


def test_steps_share_one_table_and_agree_with_single_fits(spark):
    draw = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, int(b), int(b) % 3, float(a), float(c), float(2 * a + 0.1 * e)) for i, (b, a, c, e) in enumerate(
        zip(draw.integers(0, 30, 900), draw.normal(size=900), draw.normal(size=900), draw.normal(size=900)))],
        "id long, block int, fold int, a double, c double, y double").cache()
    small = M.TreeParams(max_trees=12, depth=3, step=0.3, min_rows=5, patience=5)
    steps = {"one": M.Step("trees", ("a",), params=small), "two": M.Step("trees", ("c", "a"), params=small), "mid": M.Step("median")}
    oof, fits = M.ladder(rows, steps, "id", "y", "fold", "block", 3)
    assert oof.count() == 900 and set(oof.columns) == {"id", "y", "fold", "oof_one", "oof_two", "oof_mid"}
    alone = M.gbt_oof(rows, "id", ["a"], "y", "fold", "block", 3, small)
    assert fits["one"].trees == alone.trees and set(fits["two"].importance) == {"a", "a_missing", "c", "c_missing"}
    joined = oof.join(alone.predictions.select("id", "oof"), "id")
    assert joined.where("abs(oof_one - oof) > 1e-9 OR oof IS NULL").count() == 0
    errors = {r["model"]: r["mae"] for r in M.ladder_metrics(oof.withColumn("y", F.col("y")), "y").collect()}
    assert errors["one"] < errors["mid"]


def test_a_falling_error_takes_two_fits(spark, hidden, monkeypatch):
    """Budgets of 4, 8, 16 and 20 were 48 trees for the same model."""
    grow, held = hidden
    steady = replace(SMALL, max_trees=20, patience=3, feature_share=1.0, step=0.1)
    budgets, plain = [], M._estimator
    monkeypatch.setattr(M, "_estimator", lambda p, classifier, trees: budgets.append(trees) or plain(p, classifier, trees))
    model = M.boosted(grow, held, steady, False)
    assert budgets == [4, 20] and 16 < model.getNumTrees <= 20
    alone = plain(steady, False, model.getNumTrees).fit(grow)
    assert model.toDebugString.split("\n", 1)[1] == alone.toDebugString.split("\n", 1)[1]

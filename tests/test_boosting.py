"""Trees of many fits grown side by side, held against Spark's own boosted trees."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from rentgrid.operators import boosting as B, models as M
from rentgrid.plans import modelling as P

WHOLE = M.TreeParams(max_trees=30, depth=3, step=0.3, min_rows=5, row_share=1.0, feature_share=1.0, patience=30)


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(8)
    x = np.stack([draw.integers(0, 20, 3000), draw.integers(0, 9, 3000), draw.integers(0, 2, 3000), np.ones(3000)], axis=1).astype(float)
    y = 10 + np.sin(x[:, 0]) + (x[:, 1] > 4) * x[:, 2] + draw.normal(size=3000) / 5
    made = [(i, i // 10 % 4, [(i // 10 + 1) % 4] if i % 50 < 10 else None, *map(float, r), float(v), float(v > 10.5)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(made, "id long, fold int, held array<int>, a double, b double, c double, d double, y double, z double").repartition(5).cache()


def binned(rows, label):
    return B.Rows(rows, ["a", "b", "c", "d"], F.col(label), F.col("id"), F.col("fold"), "held", 4)


def values(model, rows, classifier):
    data = rows.select("id", array_to_vector(F.array("a", "b", "c", "d")).alias("features"))
    return dict(M.predicted(model, data, classifier, "v").select("id", "v").collect())


@pytest.mark.parametrize("label,classifier", [("y", False), ("z", True)])
def test_the_trees_are_those_of_spark(spark, rows, label, classifier):
    """Without draws both grow the same trees, end at the same one and have the same errors on the way."""
    table = binned(rows, label)
    fits = [B.Fit((0, 1, 2, 3), WHOLE, classifier, j) for j in (0, 2)] + [B.Fit((0, 1, 2, 3), WHOLE, classifier, trees=7)]
    grown = table.grow(fits, M.best_tree)
    table.close()
    data = rows.select("fold", "held", array_to_vector(F.array("a", "b", "c", "d")).alias("features"), F.col(label).alias("label")).coalesce(1)
    for fit, growth in zip(fits, grown):
        if fit.fold is None:
            own = M._estimator(WHOLE, classifier, 7).fit(data)
            assert growth.best == 7
        else:
            aside = F.coalesce(F.array_contains("held", fit.fold), F.lit(False))
            grow, held = (data.where(F.col("fold") != fit.fold).where(c) for c in (~aside, aside))
            whole = M._estimator(WHOLE, classifier, 30).fit(grow)
            errors = whole.evaluateEachIteration(held) if classifier else whole.evaluateEachIteration(held, "squared")
            assert growth.errors == pytest.approx(errors, rel=1e-6) and growth.best == M.best_tree(errors, 30)[0]
            own = M.first_trees(spark, whole, growth.best)
        model = B.model(spark.sparkContext, M._estimator(WHOLE, classifier, 30), growth, table.layout.cuts, classifier)
        assert model.getNumTrees == growth.best and model.numFeatures == 4
        assert model.featureImportances.toArray() == pytest.approx(own.featureImportances.toArray(), abs=1e-6)
        ours, theirs = values(model, rows, classifier), values(own, rows, classifier)
        assert [ours[i] for i in range(3000)] == pytest.approx([theirs[i] for i in range(3000)], abs=1e-6)


def test_lost_states_and_other_blocks_change_no_tree(rows, monkeypatch):
    """Draws follow the ids, so neither the deal of rows nor a task that has lost its predictions or its blocks changes a model."""
    drawn = replace(WHOLE, row_share=0.7, feature_share=0.5, max_trees=6)
    fits = [B.Fit((0, 1, 2), drawn, False, j) for j in (1, 3)]

    def trees(table):
        grown = table.grow(fits, M.best_tree)
        table.close()
        return [[[list(map(tuple, level)) for level in t.levels] for t in g.trees] for g in grown], [g.errors for g in grown]

    first, errors = trees(binned(rows, "y"))
    assert sum(len(t) for t in first) == 12 and first[0] != first[1]
    monkeypatch.setattr(B, "BLOCK", (100, 300))
    other, again = trees(binned(rows.repartition(3), "y"))
    assert other == first and np.allclose(again, errors)
    monkeypatch.setattr(B.Store, "state", lambda *a: None)
    monkeypatch.setattr(B.Store, "block", lambda self, name: (_ for _ in ()).throw(B.Missing(name)))
    lost, again = trees(binned(rows, "y"))
    assert lost == first and np.allclose(again, errors)


def test_bins_hold_equal_shares_of_all_rows():
    few = B.thresholds(np.array([-1e9, 1, 2, 4]), np.array([5, 1, 1, 1]))
    assert few.tolist() == [(1 - 1e9) / 2, 1.5, 3]
    draw = np.random.default_rng(9).exponential(size=200_000)
    cuts = B.thresholds(*B.compressed(*np.unique(draw, return_counts=True)))
    shares = np.bincount(np.searchsorted(cuts, draw), minlength=32) / len(draw)
    assert len(cuts) == 31 and abs(shares - 1 / 32).max() < 0.002


def test_registered_queries_have_the_whole_budget():
    assert P.FULL == M.TreeParams() and P.PRODUCT == M.PRODUCT
    assert (P.FULL.max_trees, P.FULL.patience, P.PRODUCT.max_trees) == (3_000, 100, 600)

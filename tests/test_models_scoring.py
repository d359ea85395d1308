import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rentgrid.operators import models as M, scoring as SC, validation as V


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    n = 600
    pdf = pd.DataFrame({"id": np.arange(n), "block": rng.integers(0, 12, n), "a": rng.normal(size=n), "b": rng.normal(size=n),
                        "k": rng.integers(0, 3, n)})
    pdf["y"] = 1 + 0.5 * pdf.a + 0.3 * (pdf.k == 1) + rng.normal(0, 0.1, n)
    pdf["s"] = (rng.random(n) < 1 / (1 + np.exp(-pdf.a))).astype(float)
    df = spark.createDataFrame(pdf).withColumn("b", F.when(F.col("id") % 9 == 0, None).otherwise(F.col("b")))
    return pdf, V.block_folds(df, "block", 3).cache()


def test_held_blocks_never_in_test_fold(table):
    _, df = table
    held = M.validation_blocks(df, "block", "fold", 3)
    joined = df.join(held, "block").where(F.array_contains("held", F.col("fold")))
    assert joined.count() == 0 and held.count() >= 3


def test_trees_learn_and_score_alike(table):
    _, df = table
    params = M.TreeParams(max_trees=6, depth=3, step=0.5, min_rows=5)
    fit = M.gbt_oof(df, "id", ["a", "b", "k"], "y", "fold", "block", 3, params)
    assert fit.predictions.count() == 600
    metrics = V.price_metrics(df.select("id", "y").join(fit.predictions, "id"), "y", "oof").first()
    assert metrics["r2_log"] > 0.6
    model, names = M.gbt_final(df, ["a", "b", "k"], "y", fit.n_trees, params)
    filled, _ = M.fill_missing(df, ["a", "b", "k"])
    row = SC.parity(model, filled, names).first()
    assert row["n"] == 600 and row["max_error"] == 0
    same = M.apply_model(model, df, ["a", "b", "k"], ["id"]).join(SC.score(filled, model, names).select("id", "raw"), "id")
    assert same.where(F.abs(F.col("prediction") - F.col("raw")) > 1e-12).count() == 0
    with pytest.raises(ValueError):
        SC.tree_table(model, names[:-1])

def test_ridge_equals_direct_solution(table):
    pdf, df = table
    fit = M.hedonic_oof(df, "id", ["a"], ["k"], "y", "fold", 3, alphas=(1.0,))
    got = fit.predictions.toPandas().set_index("id")
    j = 0
    test = got.index[got.fold == j]
    train = pdf[~pdf.id.isin(test)]
    def design(p, mean, sd):
        flag = np.zeros(len(p))
        return np.column_stack([(p.a - mean) / sd, flag] + [(p.k == v).astype(float) for v in (0, 1, 2)])
    mean, sd = train.a.mean(), train.a.std(ddof=0)
    x, y = design(train, mean, sd), train.y.to_numpy()
    xc = x - x.mean(0)
    beta = np.linalg.solve(xc.T @ xc + np.eye(5), xc.T @ (y - y.mean()))
    want = y.mean() + (design(pdf.set_index("id", drop=False).loc[test], mean, sd) - x.mean(0)) @ beta
    assert np.allclose(got.loc[test, "oof"], want, atol=1e-8)


def test_cluster_robust_logit(table):
    pdf, df = table
    got = M.logit_cluster(df, {"a": F.col("a")}, F.col("s"), "block").toPandas().set_index("term")
    x, y = np.column_stack([np.ones(len(pdf)), pdf.a]), pdf.s.to_numpy()
    b = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ b))
    bread = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
    s = pd.DataFrame(x * (y - p)[:, None]).groupby(pdf.block.to_numpy()).sum().to_numpy()
    g, n, k = len(s), len(x), 2
    cov = bread @ s.T @ s @ bread * g / (g - 1) * (n - 1) / (n - k)
    assert got["coef"].to_numpy() == pytest.approx(b) and got["se"].to_numpy() == pytest.approx(np.sqrt(np.diag(cov)))
    assert got["converged"].all() and not got["separated"].any()


def test_logit_says_when_outcomes_are_separated(spark):
    rows = [(i % 5, float(i), float(i >= 20)) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, a double, y double")
    got = M.logit_cluster(df, {"a": F.col("a")}, F.col("y"), "g").collect()
    assert all(r["separated"] and not r["converged"] for r in got)
    with pytest.raises(ValueError, match="both outcomes"):
        M.logit_cluster(df.where("a >= 20"), {"a": F.col("a")}, F.col("y"), "g")


def test_stiff_logit_halves_its_steps_and_converges(spark):
    """Far rows make the plain Newton step overshoot; at the estimate the scores sum to zero."""
    rng = np.random.default_rng(4)
    a = np.concatenate([rng.normal(size=200), rng.normal(size=8) * 300])
    y = (rng.random(len(a)) < 1 / (1 + np.exp(-np.clip(0.03 * a + 2, -30, 30)))).astype(float)
    df = spark.createDataFrame([(i % 7, float(x), float(v)) for i, (x, v) in enumerate(zip(a, y))], "g int, a double, y double")
    got = M.logit_cluster(df, {"a": F.col("a"), "again": F.col("a")}, F.col("y"), "g").toPandas().set_index("term")
    assert got["converged"].all() and got.loc["a", "coef"] == pytest.approx(got.loc["again", "coef"])
    p = 1 / (1 + np.exp(-(got.loc["const", "coef"] + 2 * got.loc["a", "coef"] * a)))
    assert abs((y - p).sum()) < 1e-6 and abs(((y - p) * a).sum()) < 1e-4


def test_contributions_add_up_to_the_prediction(spark):
    """Over the joined node table: the roots' values and all contributions are the model's own prediction."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"id": np.arange(300), "a": rng.normal(size=300), "b": rng.normal(size=300)})
    pdf["y"] = np.where(pdf.a > 0, 2.0, -1.0) + pdf.b.clip(-1, 1) + rng.normal(size=300) / 10
    df = spark.createDataFrame(pdf)
    model, names = M.gbt_final(df, ["a", "b"], "y", 3, M.TreeParams(depth=3, min_rows=5))
    filled, _ = M.fill_missing(df, ["a", "b"])
    trees = SC.tree_table(model, names)
    base = sum(r["weight"] * r["value"] for r in trees.where("node = 0").collect())
    parts = SC.contributions(filled, "id", trees, names, SC.model_depth(model)).groupBy("id").agg(F.sum("contribution").alias("c"))
    both = SC.score(filled, model, names).join(parts, "id").select("raw", "c").toPandas()
    assert len(both) == 300 and np.allclose(both["raw"], both["c"] + base)
    table = SC.attribution(filled, "id", trees, names, SC.model_depth(model), {"b": "other"}).toPandas().set_index("feature")
    assert table["share"].sum() == pytest.approx(1) and table.loc["a", "mean_abs"] > table.loc["b", "mean_abs"] and table.loc["b", "source"] == "other"
    assert SC.parity(model, filled, names).first()["max_error"] == 0


def test_infinite_input_fails(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3)) for i in range(60)], "id int, a double, y double")
    model, names = M.gbt_final(df, ["a"], "y", 2, M.TreeParams(depth=2, min_rows=2))
    bad = spark.createDataFrame([(1, float("inf"), 0.0)], "id int, a double, a_missing double")
    with pytest.raises(Exception, match="infinite"):
        SC.score(bad, model, names).collect()


def test_interval(spark):
    rows = spark.createDataFrame([(1, "p", 5.0), (2, "q", 5.0)], "i int, t string, raw double")
    pairs = spark.createDataFrame([("p", -0.5, 0.5)], "t string, q_low double, q_high double")
    got = {r["i"]: r for r in SC.predict_interval(rows, "raw", "t", pairs, (-1.0, 1.0), "exp", cap=255).collect()}
    assert got[1]["low"] == pytest.approx(np.exp(4.5)) and got[2]["low"] == pytest.approx(np.exp(4.0)) and got[2]["high"] == 255


def test_rows_do_not_move_to_meet_their_fold(spark):
    """Folds of blocks are a table of known, small size, so the rows are not dealt by block."""
    df = spark.range(2000).select("id", (F.col("id") % 13).alias("block"))
    folded = V.block_folds(df, "block")
    assert "Exchange" not in folded._jdf.queryExecution().sparkPlan().toString() and "BroadcastHashJoin" in folded._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in folded._jdf.queryExecution().executedPlan().toString()
    assert folded.count() == 2000 and folded.select("block", "fold").distinct().count() == 13


def test_fewer_fits_side_by_side_for_more_rows(table, monkeypatch):
    _, df = table
    fitted = M.fold_table(df, "id", ["a", "b", "k"], "y", "fold", "block", 3)
    assert fitted.at_once() == M.PARALLEL_FITS
    for rows, fits in ((1300, 2), (700, 1), (10, 1)):
        monkeypatch.setattr(M, "FITTED_ROWS", rows)
        assert fitted.at_once() == fits

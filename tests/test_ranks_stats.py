import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rentgrid.functions.tails import chi2_sf
from rentgrid.operators import panel, ranks as R, skew, stats, validation as V


@pytest.fixture(scope="module")
def frame(spark):
    """A third of the rows in one group, and a third of the values equal."""
    rng = np.random.default_rng(1)
    n = 3000
    v = np.where(rng.random(n) < 0.33, 7.0, rng.normal(10, 5, n).round(2))
    g = np.where(rng.random(n) < 0.33, "hot", rng.choice(list("abcdefgh"), n))
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": v, "w": rng.normal(size=n) + v})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_quantiles(frame):
    pdf, df = frame
    want = pdf.groupby("g")["v"].quantile([0.1, 0.5, 0.9]).unstack()
    got = R.quantiles(df, ["g"], {"v": F.col("v")}, [0.1, 0.5, 0.9]).toPandas().set_index("g")
    assert np.allclose(got.loc[want.index, ["v_p10", "v_p50", "v_p90"]].to_numpy(), want.to_numpy())


def test_a_hot_group_is_spread_over_buckets(frame):
    """A group with a third of the rows is ordered in several tasks, and no window lacks a partition key."""
    pdf, df = frame
    splits = R.splitters(df, "v")
    counts = R.value_counts(df, ["g"], "v")
    used = R.with_bucket(counts.where("g = 'hot'"), "_v", splits).groupBy("__bucket").agg(F.sum("c").alias("n")).toPandas()
    assert len(used) >= 4 and used["n"].max() < 0.6 * (pdf["g"] == "hot").sum()
    table = R.running_totals(counts, ["g"], "_v", ["c"], splits)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("], [g#" in w for w in windows) and any("__bucket#" in w for w in windows)


def test_more_values_mean_more_buckets(frame, monkeypatch):
    pdf, df = frame
    few = R.splitters(df, "w")
    monkeypatch.setattr(R, "BUCKET_VALUES", 10)
    many = R.splitters(df, "w")
    assert len(few) < 10 < 200 < len(many)
    got = R.medians(df, [], {"w": F.col("w")}).first()["w"]
    assert got == pytest.approx(pdf["w"].median())


def test_one_value_needs_no_cut(spark):
    df = spark.createDataFrame([(1, 5.0)] * 7 + [(2, None)], "g int, v double")
    assert {r["g"]: r["v"] for r in R.medians(df, ["g"], {"v": F.col("v")}).collect()} == {1: 5.0}


def test_average_rank(frame):
    pdf, df = frame
    got = R.attach_ranks(df.select("id", "v"), ["v"]).toPandas().sort_values("id")
    assert np.allclose(got["v__rank"], pdf["v"].rank())


def test_hot_key_join_is_salted(frame):
    pdf, df = frame
    sizes = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"))
    got = skew.attach_per_key(df, sizes, ["g"], "n", hot_rows=100, salts=4)
    assert got.count() == len(pdf)
    want = pdf.groupby("g")["v"].transform("mean")
    assert np.allclose(got.toPandas().sort_values("id")["m"], want)
    right = df.groupBy("g").agg(F.max("v").alias("top"))
    assert skew.skewed_join(df, right, ["g"], hot_rows=100, salts=4).count() == len(pdf)


def test_spearman(frame):
    pdf, df = frame
    row = panel.spearman(df, F.col("v"), F.col("w")).first()
    assert row["spearman"] == pytest.approx(pdf["v"].rank().corr(pdf["w"].rank()), abs=1e-9)
    assert row["pearson"] == pytest.approx(pdf["v"].corr(pdf["w"]), abs=1e-9)


def test_kruskal_and_pairs(frame):
    pdf, df = frame
    ranks = pdf["v"].rank()
    n = len(pdf)
    sums = ranks.groupby(pdf["g"]).agg(["sum", "size"])
    ties = pdf["v"].value_counts()
    h = (12 / (n * (n + 1)) * (sums["sum"] ** 2 / sums["size"]).sum() - 3 * (n + 1)) / (1 - (ties**3 - ties).sum() / (n**3 - n))
    row = stats.kruskal(df, "v", "g").first()
    assert row["H"] == pytest.approx(h) and row["p"] == pytest.approx(chi2_sf(h, len(sums) - 1))
    a, b = pdf.loc[pdf.g == "a", "v"].to_numpy(), pdf.loc[pdf.g == "hot", "v"].to_numpy()
    u = (a[:, None] > b).sum() + (a[:, None] == b).sum() / 2
    pair = stats.mann_whitney_pairs(df, "v", "g").where("a = 'a' AND b = 'hot'").first()
    assert pair["U"] == u and pair["rank_biserial"] == pytest.approx(2 * u / (len(a) * len(b)) - 1)


def test_chi2_tail():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_sf(20.0, 10) == pytest.approx(0.029252688076961, rel=1e-9)


def test_bh_known(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    assert stats.bh_reject(df, "p", 0.05).where("reject").count() == 2


def test_median_interval_matches_resampling(spark):
    rng = np.random.default_rng(3)
    x = rng.lognormal(size=400)
    row = R.median_interval(spark.createDataFrame([(float(v),) for v in x], "x double"), [], "x").first()
    boot = np.median(rng.choice(x, (4000, 400)), axis=1)
    lo, hi = np.quantile(boot, [0.025, 0.975])
    assert row["median"] == pytest.approx(np.median(x))
    assert row["ci_low"] == pytest.approx(lo, rel=0.06) and row["ci_high"] == pytest.approx(hi, rel=0.06)
    few = R.median_interval(spark.createDataFrame([(1.0,), (2.0,)], "x double"), [], "x").first()
    assert few["median"] == 1.5 and few["ci_low"] is None


def test_shift_share_identities(spark):
    rows = [("A", "x", 1.0)] * 80 + [("A", "y", 2.0)] * 20 + [("B", "x", 1.0)] * 20 + [("B", "y", 2.0)] * 80 + [("B", "z", 9.0)]
    df = spark.createDataFrame(rows, "s string, e string, v double")
    t = panel.shift_share_total(panel.shift_share(df, ["e"], "s", ("A", "B"), F.col("v"))).first()
    assert t["within"] == pytest.approx(0) and t["composition"] == pytest.approx(0.6) and t["strata_left_out"] == 1


def test_psi(spark):
    rng = np.random.default_rng(0)
    a = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=20000), "flat": 1.0}))
    b = spark.createDataFrame(pd.DataFrame({"x": rng.normal(1, 1, 20000), "flat": 1.0}))
    got = {r["column"]: r["psi"] for r in stats.psi_table(a, b, ["x", "flat"]).collect()}
    assert got["x"] > 0.25 and got["flat"] is None
    assert stats.psi_table(a, a, ["x"]).first()["psi"] == pytest.approx(0)


def test_conformal_and_folds(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(2000), "block": rng.integers(0, 40, 2000), "res": rng.normal(size=2000)})
    df = V.block_folds(spark.createDataFrame(pdf), "block", 5)
    assert V.shared_blocks(df, "block").first()["shared"] == 0
    assert df.select("fold").distinct().count() == 5
    assert {r["n"] for r in df.groupBy("fold").agg(F.count_distinct("block").alias("n")).collect()} == {8}
    q = V.conformal_quantiles(df, "res", 0.8).first()
    r = np.sort(pdf["res"])
    a = (1 - 0.8) / 2
    assert q["q_low"] == r[max(0, math.floor(2001 * a) - 1)] and q["q_high"] == r[min(1999, math.ceil(2001 * (1 - a)) - 1)]
    cover = V.honest_coverage(df, "res", "fold", 0.8).first()["coverage"]
    assert cover == pytest.approx(0.8, abs=0.03)


def test_baseline_falls_back(spark):
    rows = [("a", "t", 0, 1.0), ("a", "t", 0, 3.0), ("b", "t", 1, 10.0), ("b", "u", 1, 20.0), ("c", "t", 2, 5.0), ("c", "u", 2, 7.0)]
    df = spark.createDataFrame(rows, "b string, t string, fold int, y double")
    got = {(r["b"], r["t"], r["fold"]): r["prediction"] for r in V.median_baseline(df, "y", "fold", [["b", "t"], ["t"]], 3).collect()}
    assert got[("a", "t", 0)] == 7.5 and got[("b", "u", 1)] == 7.0 and got[("c", "u", 2)] == 20.0


def test_class_metrics(spark):
    rng = np.random.default_rng(2)
    p = rng.random(500).round(2)
    y = (rng.random(500) < p).astype(float)
    row = V.class_metrics(spark.createDataFrame(pd.DataFrame({"y": y, "p": p})), "y", "p").first()
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
    assert row["auc"] == pytest.approx(auc)


def test_pairs_of_many_groups(spark):
    rng = np.random.default_rng(11)
    rows = [(int(g), float(v)) for g in range(500) for v in rng.integers(0, 40, 4)]
    rows += [(0, float(v)) for v in rng.integers(0, 40, 700)]            # a group with a third of all rows
    df = spark.createDataFrame(rows + [(None, 1.0), (3, None), (3, float("nan"))], "g int, v double")
    got = {(r["a"], r["b"]): r for r in stats.mann_whitney_pairs(df, "v", "g", p_value=False).collect()}
    assert len(got) == 500 * 499 // 2
    by = {}
    for g, v in rows:
        by.setdefault(g, []).append(v)
    for a, b in [(0, 1), (0, 499), (255, 256), (17, 300), (498, 499)]:
        x, y = np.array(by[a]), np.array(by[b])
        u = (x[:, None] > y).sum() + (x[:, None] == y).sum() / 2
        c = np.unique(np.concatenate([x, y]), return_counts=True)[1].astype(float)
        n = len(x) + len(y)
        spread = np.sqrt(len(x) * len(y) / 12 * (n + 1 - (c**3 - c).sum() / (n * (n - 1))))
        row = got[a, b]
        assert row["U"] == u and row["median_a"] == np.median(x) and row["median_b"] == np.median(y)
        assert row["z"] == pytest.approx((max(u, len(x) * len(y) - u) - len(x) * len(y) / 2 - 0.5) / spread)


def test_pairs_without_pairs(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert stats.mann_whitney_pairs(empty, "v", "g").count() == 0
    one = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, v double")
    assert stats.mann_whitney_pairs(one, "v", "g").count() == 0
    tied = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "g string, v double")
    row = stats.mann_whitney_pairs(tied, "v", "g").first()
    assert row["U"] == 0.5 and row["z"] is None and row["p"] == row["p_holm"] == 1.0

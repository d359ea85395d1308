import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rentgrid.operators import cells as C, ranks as R


@pytest.fixture(scope="module")
def frame(spark):
    """Ties, a metric and labels with gaps, a group with one row."""
    rng = np.random.default_rng(3)
    n = 5000
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c", None], n), "h": rng.random(n) < 0.3, "price": rng.normal(100, 20, n).round(1),
                        "rent": np.where(rng.random(n) < 0.4, 900.0, rng.normal(1000, 300, n)), "nights": rng.integers(1, 31, n).astype(float)})
    pdf.loc[0, "g"] = "single"
    pdf["revenue"] = pdf.price * pdf.nights * 12
    gaps = pdf.assign(seen=np.arange(n) % 5 > 0)
    df = spark.createDataFrame(gaps).withColumn("nights", F.when(F.col("seen"), F.col("nights"))).drop("seen").repartition(4)
    return pdf.assign(nights=pdf.nights.where(gaps.seen)), df


def test_medians_of_several_groupings(frame, monkeypatch):
    pdf, df = frame
    monkeypatch.setattr(R, "BUCKET_VALUES", 60)              # more buckets than the first sketch has
    dims = {"all": F.lit("all"), "g": F.col("g"), "h": F.col("h"), "gh": F.concat("g", F.col("h").cast("string"))}
    got = R.medians_by_dimension(df, dims, {m: F.col(m) for m in ("price", "rent", "nights")}).toPandas().set_index(["dimension", "label"])
    want = {("all", "all"): pdf}
    want |= {("g", k): p for k, p in pdf.groupby("g")} | {("h", str(k).lower()): p for k, p in pdf.groupby("h")}
    want |= {("gh", k + str(h).lower()): p for (k, h), p in pdf.groupby(["g", "h"])}
    assert set(got.index) == set(want)
    for key, part in want.items():
        for m in ("price", "rent", "nights"):
            value = got.loc[key, m]
            assert value == pytest.approx(part[m].median()) or np.isnan(value) and part[m].isna().all()


def test_rent_rows_are_not_repeated_per_dimension(frame, monkeypatch):
    """Every row was shuffled once per dimension and metric; now only values of the buckets with a median are."""
    pdf, df = frame
    tables = {}
    keep = R.shared_table
    monkeypatch.setattr(R, "shared_table", lambda t, name: tables.setdefault(name, keep(t, name)))
    dims = {"all": (None, 0), "group": ("g", 30), "long": ("h", 0)}
    got = C.rent_block(df, "price", "nights", "revenue", "rent", dims).toPandas().set_index(["dimension", "label"])
    counted = tables["bucket-totals"].agg(F.sum("_c")).first()[0]
    assert counted <= 7 * len(pdf)                           # once per metric, whatever the number of dimensions
    assert tables["asked-buckets"].count() < 0.25 * tables["bucket-totals"].count()
    assert set(got.index) == {("all", "all"), ("group", "a"), ("group", "b"), ("group", "c"), ("long", "true"), ("long", "false")}
    part = pdf[pdf.g == "b"]
    ratio = part.revenue / (12 * part.rent)
    row = got.loc[("group", "b")]
    assert row["n"] == len(part) and row["share_above"] == pytest.approx((ratio > 1).mean())
    assert row["ratio"] == pytest.approx(ratio.median()) and row["rent_year"] == pytest.approx(12 * part.rent.median())
    assert row["nights"] == part.nights.median() and row["break_even_nights"] == pytest.approx((12 * part.rent / part.price).median())

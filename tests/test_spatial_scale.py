import math

from pyspark.sql import functions as F

from rentgrid.operators import spatial as SP
from rentgrid.operators.skew import skewed_join


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_tables_are_not_sent_whole(spark):
    """Spark takes an exploded table for as small as its file; joined by key both sides have to be shuffled."""
    big = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    other = spark.range(50).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("v"))
    joined = skewed_join(big, other, ["k"])
    assert "SortMergeJoin [k" in physical(joined)
    assert joined.count() == 9000


def test_counts_within_a_radius_make_no_row_per_pair(spark, monkeypatch):
    """Pieces of a cell add up, complexes at several places and repeated ids included."""
    monkeypatch.setattr(SP, "PIECE_POINTS", 7)
    monkeypatch.setattr(SP, "PIECE_TARGETS", 5)
    monkeypatch.setattr(SP, "BLOCK_PAIRS", 10)
    points = [(i % 38, float(i * 37 % 101), float(i * 53 % 97)) for i in range(40)]
    targets = [(i % 9 if i % 11 else None, float(i * 29 % 103), float(i * 61 % 89), [None, "", "a b", f"l{i % 5}"][i % 4]) for i in range(60)]
    p = spark.createDataFrame(points, "id long, x double, y double")
    t = spark.createDataFrame(targets, "c long, x double, y double, served string")
    counted = SP.within_radius(p, t, "id", 30.0, "c", "served")
    expected = set()
    for own, _, _ in points:
        near = [q for i, x, y in points if i == own for q in targets if math.hypot(x - q[1], y - q[2]) <= 30.0]
        expected.add((own, len({q[0] for q in near} - {None}), len({v for q in near for v in (q[3] or "").split(" ")} - {""})))
    assert set(map(tuple, counted.collect())) == expected
    assert "SQRT" not in physical(SP.within_radius(p.dropDuplicates(["id"]), t, "id", 30.0, "c", "served"))


def test_a_long_edge_is_kept_only_in_cells_that_it_meets(spark):
    edge = spark.createDataFrame([(1, 0.0, 0.0, 10_000.0, 10_000.0)], "ordinal int, ax double, ay double, bx double, by double")
    boxed = edge.select("*", F.lit(0.0).alias("x0"), F.lit(10_000.0).alias("x1"), F.lit(0.0).alias("y0"), F.lit(10_000.0).alias("y1"))
    met = SP.edge_cells(edge, [100.0]).count()
    # at most three cells for every step of an apothem along the line, where the box has thousands
    assert 10_000 * math.sqrt(2) / 200 <= met <= 3 * 10_000 * math.sqrt(2) / 86
    assert SP.explode_box_cells(boxed, 100.0, 1).count() > 10 * met

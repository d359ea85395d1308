import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rentgrid.functions import hexgrid as H
from rentgrid.operators import cells as C, skew, spatial as SP, spatial_stats as ST


@pytest.fixture(scope="module")
def places(spark):
    """Half of the points in one tight clump, some exactly equal, the rest spread out."""
    rng = np.random.default_rng(4)
    clump = rng.normal(0, 30, (60, 2))
    clump[:10] = clump[0]
    xy = np.vstack([clump, rng.uniform(-20000, 20000, (60, 2))])
    pdf = pd.DataFrame({"id": np.arange(120), "x": xy[:, 0], "y": xy[:, 1], "kind": np.arange(120) % 2})
    return pdf, spark.createDataFrame(pdf)


def test_projection_known_point(spark):
    df = spark.sql("select -74.0060D lon, 40.7128D lat")
    x, y = H.to_utm("lon", "lat")
    row = df.select(x.alias("x"), y.alias("y")).first()
    assert row["x"] == pytest.approx(583959.4, abs=1.0) and row["y"] == pytest.approx(4507351.0, abs=1.0)
    lon, lat = H.from_utm(*H.to_utm("lon", "lat"))
    back = df.select(lon, lat).first()
    assert back[0] == pytest.approx(-74.006, abs=1e-7) and back[1] == pytest.approx(40.7128, abs=1e-7)


def test_grid(spark):
    df = spark.range(500).select(F.expr("(id * 7919 % 5003) * 3.0 - 7000").alias("x"), F.expr("(id * 6101 % 4001) * 3.0 - 6000").alias("y"))
    c = df.select("x", "y", H.cell("x", "y", 9).alias("c"))
    cx, cy = H.cell_center("c", 9)
    near = c.select(H.distance("x", "y", cx, cy).alias("d"), (H.cell(cx, cy, 9) == F.col("c")).alias("same"),
                    F.size(H.disk("c", 1)).alias("n"), H.grid_distance("c", H.ring("c", 2)[0]).alias("two")).collect()
    assert max(r["d"] for r in near) <= H.side_of(9) and all(r["same"] for r in near)
    assert {(r["n"], r["two"]) for r in near} == {(7, 2)}
    ring = c.limit(1).select("c", F.explode(H.ring("c", 1)).alias("n")).select(
        H.distance(*H.cell_center("c", 9), *H.cell_center("n", 9)).alias("d")).collect()
    assert len(ring) == 6 and all(r["d"] == pytest.approx(H.side_of(9) * math.sqrt(3)) for r in ring)


@pytest.mark.parametrize("radius,k", [(None, 1), (None, 4), (3000.0, 5)])
def test_nearest_against_brute_force(places, radius, k):
    pdf, df = places
    targets = df.select(F.col("id").alias("t"), "x", "y", "kind")
    got = SP.nearest_k(df, targets, "id", "t", k, radius, ["kind"]).toPandas()
    want = []
    for _, p in pdf.iterrows():
        same = pdf[pdf.kind == p.kind]
        d = np.hypot(same.x - p.x, same.y - p.y)
        best = sorted((dist, int(i)) for dist, i in zip(d, same.id) if radius is None or dist <= radius)[:k]
        want += [(int(p.id), rank, i) for rank, (_, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got[["id", "rank", "t"]].astype(int).to_numpy().tolist())) == sorted(want)


def test_nearest_with_hot_cells(places, monkeypatch):
    """The same answer when every crowded cell is salted."""
    pdf, df = places
    plain = SP.nearest_k(df, df.withColumnRenamed("id", "t"), "id", "t", 2, 3000.0).toPandas()
    monkeypatch.setattr(skew.skewed_join, "__defaults__", ("inner", 5, 3))
    salted = SP.nearest_k(df, df.withColumnRenamed("id", "t"), "id", "t", 2, 3000.0).toPandas()
    key = ["id", "rank", "t"]
    assert sorted(map(tuple, plain[key].to_numpy().tolist())) == sorted(map(tuple, salted[key].to_numpy().tolist()))


def square(x, y, side):
    return [(float(a), float(b)) for a, b in ((x, y), (x + side, y), (x + side, y + side), (x, y + side))]


@pytest.fixture(scope="module")
def areas(spark):
    rows = [(1, "A", [square(0, 0, 1000)]), (2, "B", [square(1500, 0, 1000)]),
            (3, "C", [square(500, 500, 2000)]), (4, "ring", [square(9000, 9000, 1000), square(9400, 9400, 200)[::-1]])]
    return spark.createDataFrame(rows, f"ordinal int, name string, rings {SP.RINGS}")


def test_polygons(spark, areas):
    pts = spark.createDataFrame([(1, 100.0, 100.0), (2, 1600.0, 100.0), (3, 800.0, 800.0), (4, -300.0, 500.0), (5, 9500.0, 9500.0)],
                                "id int, x double, y double")
    got = {r["id"]: (r["name"], r["matches"]) for r in SP.point_in_polygon(pts, areas, "id", ["name"]).collect()}
    assert got == {1: ("A", 1), 2: ("B", 1), 3: ("A", 2), 4: (None, 0), 5: (None, 0)}
    near = {r["id"]: (r["name"], r["how"], round(r["distance"])) for r in SP.nearest_polygon(pts, areas, "id", ["name"]).collect()}
    assert near[4] == ("A", "proximo", 300) and near[5] == ("ring", "proximo", 100) and near[3] == ("A", "contem", 0)
    masked = {r["id"]: r["name"] for r in SP.nearest_polygon(pts, areas, "id", ["name"], F.col("name") != "A").collect()}
    assert masked[4] == "C"


def test_cover_and_land(spark, areas):
    one = areas.where("name = 'A' OR name = 'ring'")
    covered = SP.cover(one, "name", 9)
    assert covered.groupBy("name", "cell").count().where("count > 1").count() == 0
    # every point of the area lies in a covered cell
    probe = spark.range(400).select((F.col("id") % 20 * 52.0 + 3).alias("x"), (F.floor(F.col("id") / 20) * 52.0 + 3).alias("y"))
    inside = probe.where("x < 1000 AND y < 1000").select(H.cell("x", "y", 9).alias("cell")).distinct()
    assert inside.join(covered, "cell", "left_anti").count() == 0
    total = SP.land_fraction(covered, one, "name", 9).agg(F.sum("land")).first()[0] * H.CELL_AREAS[9]
    assert total == pytest.approx(1000**2 + 1000**2 - 200**2, rel=1e-6)


def test_land_is_the_share_of_the_union(spark):
    """Half a cell counts once, however often polygons cover it; against a fine grid of points elsewhere."""
    side = H.side_of(9)
    half = [(1, "left", [square(-2 * side, -2 * side, 2 * side)]), (2, "again", [square(-2 * side, -2 * side, 2 * side)])]
    half += [(3, "up", [square(-2 * side, 0, 2 * side)]), (4, "up again", [square(-2 * side, -0.5 * side, 2 * side)])]
    table = spark.createDataFrame(half, f"ordinal int, name string, rings {SP.RINGS}")
    centre = spark.sql("SELECT 0D AS x, 0D AS y").select(H.cell("x", "y", 9).alias("cell"))
    for names in (("left", "up"), ("left", "again", "up", "up again")):
        some = table.where(F.col("name").isin(*names))
        got = SP.land_fraction(SP.cover(some, "name", 9), some, "name", 9).join(centre, "cell").first()["land"]
        assert got == pytest.approx(0.5, abs=1e-8)
    rng = np.random.default_rng(4)
    shapes = []
    for i in range(9):
        x, y = rng.uniform(-400, 400, 2)
        turn = np.sort(rng.uniform(0, 2 * np.pi, 7))
        shapes.append((i, f"p{i}", [[(float(x + r * np.cos(t)), float(y + r * np.sin(t))) for t, r in zip(turn, rng.uniform(80, 500, 7))]]))
        shapes[-1][2][0].append(shapes[-1][2][0][0])
    table = spark.createDataFrame(shapes, f"ordinal int, name string, rings {SP.RINGS}")
    land = {r["cell"]: r["land"] for r in SP.land_fraction(SP.cover(table, "name", 9), table, "name", 9).collect()}
    probe = spark.range(160 * 160).select((F.col("id") % 160 * 14.0 - 1113.3).alias("x"), (F.floor(F.col("id") / 160) * 14.0 - 1111.7).alias("y"), "id")
    hit = SP.point_in_polygon(probe, table, "id", ["name"]).select(H.cell("x", "y", 9).alias("cell"), (F.col("matches") > 0).cast("double").alias("m"))
    shares = hit.groupBy("cell").agg(F.avg("m").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 480").collect()
    assert len(shares) > 20
    for r in shares:
        assert land.get(r["cell"], 0.0) == pytest.approx(r["m"], abs=0.04)


def test_pairs_per_query_stay_flat(spark):
    """Sixteen times the points, evenly spread, compare no more pairs per query."""
    per_query = []
    for n in (1000, 16000):
        step = 10_000 / n ** 0.5
        rng = np.random.default_rng(n)
        pts = spark.createDataFrame([(float(x * step + a), float(y * step + b), i) for i, (x, y, a, b) in enumerate(
            (i % int(n ** 0.5), i // int(n ** 0.5), *rng.uniform(0, step, 2)) for i in range(n))], "x double, y double, _t int")
        queries = pts.select("x", "y")
        pairs = SP.neighbour_pairs(queries, pts, [], 1, SP._levels(SP.finest_side(n, 14_000.0), 14_000.0))
        per_query.append(pairs.count() / n)
    assert per_query[1] < 1.3 * per_query[0] < 60


def disk(spark, k, value):
    base = spark.sql("select 0D x, 0D y").select(F.explode(H.disk(H.cell("x", "y", 8), k)).alias("cell"))
    x, y = H.cell_center("cell", 8)
    return base.select("cell", value(x, y).alias("v"))


def test_moran(spark):
    gradient = disk(spark, 5, lambda x, y: x)
    assert gradient.count() == 91
    row = ST.moran_test(gradient, "cell", "v", permutations=99).first()
    assert row["I"] > 0.5 and row["p_two_sided"] <= 0.05 and row["islands"] == 0
    noise = ST.moran_test(disk(spark, 5, lambda x, y: F.xxhash64("cell", F.lit(3)).cast("double")), "cell", "v", permutations=99).first()
    assert noise["p_two_sided"] > 0.05 and abs(noise["I"]) < 0.25


def test_lisa_finds_core(spark):
    hot = disk(spark, 8, lambda x, y: F.when(H.distance(x, y, F.lit(0.0), F.lit(0.0)) < 2900, 10.0).otherwise(0.0)
               + F.pmod(F.xxhash64("cell"), F.lit(100)) / 100.0)
    got = ST.lisa(hot, "cell", "v", permutations=999)
    labels = {r["cluster"] for r in got.collect()}
    assert "Alto-Alto" in labels
    lone = hot.unionByName(spark.sql("select 9e5D x, 9e5D y").select(H.cell("x", "y", 8).alias("cell"), F.lit(1.0).alias("v")))
    assert SP.islands(lone, "cell").count() == 1 and ST.moran(lone, "cell", "v").first()["islands"] == 1


def test_reallocate_and_ring(spark):
    base = spark.sql("select 0D x, 0D y").select(H.cell("x", "y", 8).alias("cell"))
    own = base.first()[0]
    near, far = base.select(H.ring("cell", 2)[0], H.ring("cell", 5)[0]).first()
    table = spark.createDataFrame([(own,)], "cell long")
    got = {r["cell"]: (r["target"], r["ring"]) for r in SP.reallocate(
        spark.createDataFrame([(own,), (near,), (far,)], "cell long"), table, "cell", H.side_of(8)).collect()}
    assert got == {own: (own, 0), near: (own, 2), far: (None, None)}
    counts = spark.createDataFrame([(own, 2), (near, 50)], "cell long, n int")
    assert SP.ring_sum(table, counts, "cell", "n").first()["ring_sum"] == 2


def test_cells_stay_unique(spark):
    base = spark.createDataFrame([(1,), (2,)], "cell int")
    twice = spark.createDataFrame([(1, 1.0), (1, 2.0)], "cell int, v double")
    with pytest.raises(ValueError, match="repeats"):
        C.build_cells(base, "cell", [(twice, {"v": "double"})])
    out = C.build_cells(base, "cell", [(None, {"v": "double"})])
    assert out.columns == ["cell", "v"] and out.where("v IS NULL").count() == 2


@pytest.mark.parametrize("n", [1, 2, 3, 7, 30, 1000, 1601])
def test_permuted_places_are_taken_once(spark, n):
    from rentgrid.operators.spatial_stats import permuted_places
    copies = spark.range(n).select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("perm"), "id")
    drawn = permuted_places(copies, "id", "perm", n)
    places = {}
    for perm, idx, at in drawn.collect():
        places.setdefault(perm, {})[idx] = at
    assert all(sorted(p.values()) == list(range(n)) for p in places.values())
    if n >= 30:
        assert len({tuple(p[i] for i in range(n)) for p in places.values()}) == 5


def test_permuted_places_are_even(spark):
    from rentgrid.operators.spatial_stats import permuted_places
    copies = spark.range(12).select("id", F.explode(F.sequence(F.lit(0), F.lit(2999))).alias("perm"))
    hits = permuted_places(copies, "id", "perm", 12).groupBy("id", "at").count()
    chi = hits.agg(F.sum(F.pow(F.col("count") - 250, 2) / 250).alias("x")).first()["x"]
    assert hits.count() == 144 and chi < 190                     # 121 degrees of freedom, p of 0.0001


def test_permutations_order_nothing(spark):
    from rentgrid.operators import spatial_stats as M
    z = spark.range(60).select(F.col("id").alias("cell"), (F.col("id") % 7 - 3.0).alias("z"))
    edges = spark.range(60).select(F.col("id").alias("src"), ((F.col("id") + 1) % 60).alias("dst"), F.lit(1.0).alias("w"))
    drawn = M.moran_permutations(edges, z, "cell", 99)
    assert "Window" not in drawn._jdf.queryExecution().toString()
    values = [r["I"] for r in drawn.collect()]
    assert len(values) == 99 and abs(sum(values) / 99 + 1 / 59) < 0.05

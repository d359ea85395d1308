import numpy as np
import pytest
from pyspark.sql import functions as F

from rentgrid.operators import outlines as O
from rentgrid.operators import spatial as SP


def star(draw, corners, x=0.0, y=0.0, size=1000.0):
    turn = np.sort(draw.uniform(0, 2 * np.pi, corners))
    return [(float(x + r * np.cos(t)), float(y + r * np.sin(t))) for t, r in zip(turn, draw.uniform(0.4, 1, corners) * size)]


def even_odd(rings, x, y):
    inside = np.zeros(len(x), bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if ay != by:
                inside ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))
    return inside


def nearest(rings, x, y):
    best = np.full(len(x), np.inf)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            dx, dy = bx - ax, by - ay
            t = np.clip(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy), 0, 1)
            best = np.minimum(best, np.hypot(x - ax - t * dx, y - ay - t * dy))
    return best


@pytest.fixture(scope="module")
def shapes():
    """Outlines of 3 to 900 corners, one with a hole, one crossing itself, one far smaller and one far larger than the rest."""
    draw = np.random.default_rng(8)
    out = [[star(draw, n, *draw.uniform(-900, 900, 2))] for n in (3, 5, 40, 300, 900)]
    out.append([star(draw, 200), star(draw, 60, size=300)[::-1]])
    out.append([[(0.0, 0.0), (800.0, 700.0), (800.0, 0.0), (0.0, 700.0)]])
    out.append([star(draw, 12, 50, 60, 2.5)])
    out.append([star(draw, 30, 0, 0, 90_000.0)])
    return out


@pytest.fixture(scope="module")
def polygons(spark, shapes):
    return spark.createDataFrame([(i, f"p{i}", s) for i, s in enumerate(shapes)], f"ordinal int, name string, rings {SP.RINGS}")


@pytest.fixture(scope="module")
def probe(spark):
    draw = np.random.default_rng(9)
    xy = np.concatenate([draw.uniform(-1900, 1900, (2500, 2)), draw.uniform(-3, 3, (300, 2)) + [50, 60], draw.uniform(-1e5, 1e5, (300, 2))])
    rows = [(i, float(a), float(b), f"p{i % 9}") for i, (a, b) in enumerate(xy)]
    return xy, spark.createDataFrame(rows + [(9000, None, 1.0, "p1"), (9001, 2.0, None, None)], "id int, x double, y double, said string")


@pytest.mark.parametrize("most", [4, 24, 10_000])
def test_every_pair_at_any_depth_of_the_index(probe, polygons, shapes, most):
    xy, table = probe
    got = {(r["_id"], r["ordinal"], r["name"]) for r in O.containing(table, polygons, "id", ["name"], most).collect()}
    want = {(int(i), k, f"p{k}") for k, s in enumerate(shapes) for i in np.flatnonzero(even_odd(s, xy[:, 0], xy[:, 1]))}
    assert got == want and len(want) > 2500


def test_first_polygon_nearest_and_declared(probe, polygons, shapes):
    xy, table = probe
    x, y = xy.T
    inside = np.array([even_odd(s, x, y) for s in shapes])
    border = np.array([nearest(s, x, y) for s in shapes])
    got = {r["id"]: r for r in SP.point_in_polygon(table, polygons, "id", ["name"]).collect()}
    assert len(got) == len(xy) + 2 and got[9000]["matches"] == 0 and got[9001]["name"] is None
    for i in range(len(xy)):
        assert got[i]["matches"] == inside[:, i].sum() and got[i]["name"] == (f"p{inside[:, i].argmax()}" if inside[:, i].any() else None)
    near = {r["id"]: r for r in SP.nearest_polygon(table, polygons, "id", ["name"]).collect()}
    for i in range(len(xy)):
        assert near[i]["distance"] == pytest.approx(0 if inside[:, i].any() else border[:, i].min(), abs=1e-6)
    said = {r["id"]: r for r in SP.declared_area_check(table, polygons, "id", "said", "name").collect()}
    for i in range(len(xy)):
        k, hit = i % 9, inside[:, i]
        place = "none" if not hit.any() else "declared" if hit.argmax() == k else "other"
        assert said[i]["place"] == place
        if place == "declared":
            assert said[i]["border_m"] == pytest.approx(border[k, i], abs=1e-6) and said[i]["declared_m"] is None
        else:
            assert said[i]["declared_m"] == pytest.approx(0 if hit[k] else border[k, i], abs=1e-6) and said[i]["border_m"] is None
    assert said[9000]["place"] == "none" and said[9000]["declared_m"] is None and len(said) == len(xy) + 2


def test_what_a_point_meets_does_not_grow_with_corners(spark):
    """Edges joined per point and cells per edge, for ever finer outlines of one shape."""
    met = {}
    for corners in (100, 1000, 10_000):
        turn = 2 * np.pi * np.arange(corners) / corners
        ring = [(float(1000 * np.cos(t)), float(1000 * np.sin(t) * (1 + 0.1 * np.cos(7 * t)))) for t in turn]
        table = SP.with_edges(spark.createDataFrame([(1, [ring])], f"ordinal int, rings {SP.RINGS}"))
        cells = O.outline_cells(table)
        row = cells.agg(F.max(F.size("edges")).alias("most"), F.count(F.lit(1)).alias("n")).first()
        met[corners] = row["most"]
        assert row["most"] <= O.MOST_EDGES and row["n"] <= 3 * corners
    assert met[10_000] <= O.MOST_EDGES


def test_joins_of_declared_areas_have_a_cell_in_their_key(probe, polygons):
    plan = SP.declared_area_check(probe[1], polygons, "id", "said", "name")._jdf.queryExecution().optimizedPlan().toString()
    assert "cell#" in plan and "aggregate(edges" not in plan

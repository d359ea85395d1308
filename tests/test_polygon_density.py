import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentgrid.operators import spatial as SP


def wedges(n: int, side: float, seed: int = 2):
    """Triangles over a hexagon at the origin: their edges near it, owners, and who has the probe inside."""
    rng = np.random.default_rng(seed)
    corner, size = rng.uniform(-1.2 * side, 1.2 * side, (n, 2)), rng.uniform(0.05, 0.4, n) * side
    edges, owner, holds = [], [], []
    px, py = SP.PROBE[0] * side, SP.PROBE[1] * side
    for k, ((x, y), w) in enumerate(zip(corner, size)):
        ring = np.array([[x, y], [x + w, y], [x, y + w]])
        edges.append(np.concatenate([ring, np.roll(ring, -1, axis=0)], axis=1))
        owner += [k] * 3
        holds.append(px > x and py > y and px - x + py - y < w)
    return np.array(owner), np.concatenate(edges), np.array(holds), corner, size


def test_dense_union_is_exact_and_sweeps_few_edges_at_once(monkeypatch):
    """A sweep compared every pair of edges of a cell at every height where two of them cross."""
    side, seen = 100.0, []
    plain = SP.union_area
    monkeypatch.setattr(SP, "union_area", lambda *a: seen.append(len(a[6])) or plain(*a))
    owner, edges, holds, corner, size = wedges(150, side)
    cut = SP.union_share(0.0, 0.0, side, owner, edges, holds)
    assert max(seen) <= SP.BOX_EDGES and len(seen) > 10
    monkeypatch.setattr(SP, "BOX_EDGES", 10 ** 6)                # one sweep over all of them, as before
    assert cut == pytest.approx(SP.union_share(0.0, 0.0, side, owner, edges, holds), abs=1e-12)
    # and the share of a fine grid of places
    step = np.arange(-side, side, side / 300) + side / 600
    x, y = (a.ravel() for a in np.meshgrid(step, step))
    apothem = side * math.sqrt(3) / 2
    there = (np.abs(x) < apothem) & (np.abs(x) / math.sqrt(3) + np.abs(y) < side)
    x, y = x[there], y[there]
    inside = np.zeros(len(x), dtype=bool)
    for (a, b), w in zip(corner, size):
        inside |= (x > a) & (y > b) & (x - a + y - b < w)
    assert cut == pytest.approx(inside.mean(), abs=2e-3)


def test_copies_of_one_outline_count_once(monkeypatch):
    side = 100.0
    owner, edges, holds, _, _ = wedges(6, side)
    once = SP.union_share(0.0, 0.0, side, owner, edges, holds)
    many = 400
    again = SP.union_share(0.0, 0.0, side, np.concatenate([owner + 6 * i for i in range(many)]), np.tile(edges, (many, 1)), np.tile(holds, many))
    assert again == pytest.approx(once, abs=1e-12)


def triangles(spark, n):
    df = spark.range(n).select(F.col("id").alias("ordinal"), F.col("id").alias("name"), ((F.col("id") * 37) % 101 * 90.0).alias("u"),
                               ((F.col("id") * 53) % 97 * 90.0).alias("v"))
    at = lambda dx, dy: F.struct((F.col("u") + dx).alias("x"), (F.col("v") + dy).alias("y"))
    return df.select("ordinal", "name", F.array(F.array(at(0.0, 0.0), at(700.0, 0.0), at(0.0, 600.0))).alias("rings"))


def test_outlines_of_a_small_file_are_dealt_over_all_tasks(spark):
    one = triangles(spark, 40).coalesce(1)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert SP._edge_rows(one, "name").rdd.getNumPartitions() == tasks > 1
    assert SP.edge_rows(one, ["name"]).rdd.getNumPartitions() == tasks


def test_nearest_polygon_is_the_same_with_and_without_the_filter(spark, monkeypatch):
    polygons = triangles(spark, 60)
    points = spark.range(300).select("id", ((F.col("id") * 421) % 9500 - 700.0).alias("x"), ((F.col("id") * 613) % 9000 - 700.0).alias("y"))
    got = []
    for few in (10 ** 6, 0):
        monkeypatch.setattr(SP, "FEW_CELLS", few)
        rows = SP.nearest_polygon(points, polygons, "id", ["name"]).collect()
        got.append(sorted((r["id"], r["name"], r["how"], round(r["distance"], 9)) for r in rows))
    assert got[0] == got[1] and {r[2] for r in got[0]} == {"contem", "proximo"}


def test_the_registered_cell_base_has_the_operators_own_grid(spark, monkeypatch):
    """Its cells are the finest ones with both parents; a coarser grid is a sixth of the work."""
    import inspect

    from rentgrid.operators import cells
    from rentgrid.plans import QUERIES, cell_tables

    sign, asked = inspect.signature(cells.cell_base), []
    monkeypatch.setattr(cell_tables.C, "cell_base", lambda *a, **b: asked.append(sign.bind(*a, **b)) or spark.range(1))
    QUERIES["cell_base"](spark, "/root/testdata/sf0.001")
    asked[0].apply_defaults()
    assert asked[0].arguments["res"] == 9 and tuple(asked[0].arguments["coarser"]) == (8, 6)

"""Spatial joins: cells give the equi-join key, the exact predicate runs on the pairs.

Points are tables with planar ``x, y`` in metres. Polygons have one row per key with
``rings: array<array<struct<x,y>>>`` (all parts and holes; inside is decided by the
even-odd rule) and an ``ordinal`` that breaks ties.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.functions import hexgrid as H
from rentgrid.operators.outlines import containing, spread
from rentgrid.operators.skew import skewed_join
from rentgrid.session import cut_lineage, shared_table

RINGS = "array<array<struct<x:double,y:double>>>"


def add_plane(df: DataFrame, lon: str = "lon", lat: str = "lat", projection: str = "plane") -> DataFrame:
    x, y = H.PROJECTIONS[projection][0](lon, lat)
    return df.withColumns({"x": x, "y": y})


def project_rings(df: DataFrame, rings: str = "rings", projection: str = "plane") -> DataFrame:
    """Rings of ``(lon, lat)`` structs to rings of planar ``(x, y)``."""
    def point(p: Column) -> Column:
        x, y = H.PROJECTIONS[projection][0](p["lon"], p["lat"])
        return F.struct(x.alias("x"), y.alias("y"))
    return df.withColumn(rings, F.transform(rings, lambda r: F.transform(r, point)))


# --- geometry as columns -----------------------------------------------------------

def edges_of(ring: Column) -> Column:
    """Array of edges ``(a, b)`` of a ring; the last corner joins the first."""
    following = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def all_edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, edges_of))


def contains(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against an array of edges."""
    def crosses(e: Column) -> Column:
        spans = (e["a"]["y"] > y) != (e["b"]["y"] > y)
        at = e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / F.when(
            e["b"]["y"] != e["a"]["y"], e["b"]["y"] - e["a"]["y"])
        return F.when(spans & (x < at), 1).otherwise(0)
    return F.aggregate(edges, F.lit(0), lambda acc, e: acc + crosses(e)) % 2 == 1


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, ((x - ax) * dx + (y - ay) * dy) / length).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return H.distance(x, y, ax + t * dx, ay + t * dy)


def boundary_distance(edges: Column, x: Column, y: Column) -> Column:
    """Distance from a point to the closest of an array of edges."""
    def one(e: Column) -> Column:
        return segment_distance(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])
    return F.aggregate(edges, F.lit(float("inf")), lambda acc, e: F.least(acc, one(e)))


def with_edges(polygons: DataFrame) -> DataFrame:
    """Add ``edges`` and the bounding box of every polygon."""
    out = polygons.withColumn("edges", all_edges(F.col("rings")))
    xs, ys = F.transform("edges", lambda e: e["a"]["x"]), F.transform("edges", lambda e: e["a"]["y"])
    return out.select("*", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"),
                      F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))


def explode_box_cells(df: DataFrame, side: float, tag: int, name: str = "cell") -> DataFrame:
    """One row per cell whose hexagon can meet the box ``x0..x1, y0..y1``."""
    rows = F.sequence(F.floor((F.col("y0") - side) / (1.5 * side)), F.ceil((F.col("y1") + side) / (1.5 * side)))
    step = side * H.ROOT3
    lined = df.withColumn("_r", F.explode(rows))
    first = F.floor((F.col("x0") - side) / step - F.col("_r") / 2)
    last = F.ceil((F.col("x1") + side) / step - F.col("_r") / 2)
    return (lined.withColumn("_q", F.explode(F.sequence(first, last)))
            .withColumn(name, H.pack(tag, F.col("_q"), F.col("_r"))).drop("_q", "_r"))


def box_side(polygons: DataFrame, smallest: float = 50.0) -> float:
    """A cell size near the mean box of the polygons, so each meets a handful of cells."""
    row = with_edges(polygons).agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()
    return max(smallest, float(row[0] or smallest))


# --- point in polygon -----------------------------------------------------------------

def point_in_polygon(points: DataFrame, polygons: DataFrame, point_id: str, columns: Sequence[str]) -> DataFrame:
    """Left join: ``columns`` of the first polygon (by ordinal) around each point, and ``matches``.

    A point meets a few edges of each outline near it (``outlines``), not whole outlines.
    """
    best = containing(points, polygons, point_id, columns).groupBy("_id").agg(
        F.min_by(F.struct(*columns), "ordinal").alias("_best"), F.count(F.lit(1)).alias("matches"))
    joined = points.join(best, points[point_id] == best["_id"], "left")
    return joined.select(*[points[c] for c in points.columns], *[F.col(f"_best.{c}").alias(c) for c in columns],
                         F.coalesce("matches", F.lit(0)).alias("matches"))


# --- nearest neighbours -----------------------------------------------------------------

def _levels(side: float, reach: float) -> list[float]:
    n = max(1, math.ceil(math.log2(max(reach / side, 1.0))) + 1)
    return [side * 2**i for i in range(n)]


def finest_side(anchors: int, reach: float) -> float:
    """Cells so small that evenly spread anchors are alone in them; every doubling of the level has four times as many."""
    return max(reach / (2 * math.sqrt(max(anchors, 1))), 1e-6)


def _level_cells(sides: Sequence[float]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("level"), H.cell_at("x", "y", s, i + 1).alias("cell"))
                     for i, s in enumerate(sides)])


def _reach(*tables: DataFrame) -> float:
    """Diagonal of the box around all points: no distance is longer."""
    boxes = [t.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first() for t in tables]
    boxes = [b for b in boxes if b[0] is not None]
    if not boxes:
        return 1.0
    return math.hypot(max(b[1] for b in boxes) - min(b[0] for b in boxes),
                      max(b[3] for b in boxes) - min(b[2] for b in boxes)) or 1.0


def _search_cells(queries: DataFrame, anchors: DataFrame, by: Sequence[str], k: int,
                  sides: Sequence[float]) -> DataFrame:
    """Per query location the cells that hold its k nearest anchors for certain.

    At the finest level where the cell and its six neighbours hold k anchors, the
    k-th nearest is at most (2 + sqrt(3)) edges away, which three rings cover (the
    fourth begins at four edges). Where no level has k, three rings of the coarsest
    one are searched; they cover the whole reach.
    """
    by = list(by)
    full = anchors.select(*by, F.explode(_level_cells(sides)).alias("c")).groupBy(
        *by, F.col("c.level").alias("level"), F.col("c.cell").alias("near")).agg(F.count(F.lit(1)).alias("n"))
    tall = queries.select(*by, "x", "y", F.explode(_level_cells(sides)).alias("c")).select(
        *by, "x", "y", F.col("c.level").alias("level"), F.col("c.cell").alias("cell"))
    around = tall.select(*by, "level", "cell").distinct().withColumn("near", F.explode(H.disk("cell", 1)))
    # exploded rows: larger than their files let Spark believe, so never sent whole
    enough = (around.join(full.hint("merge"), [*by, "level", "near"]).groupBy(*by, "level", "cell")
              .agg(F.sum("n").alias("n")).where(F.col("n") >= k).select(*by, "level", "cell", F.lit(True).alias("_ok")))
    last = len(sides) - 1
    # at coarse levels most queries share a cell, so this join is salted too
    chosen = skewed_join(tall, enough, [*by, "level", "cell"], "left").groupBy(*by, "x", "y").agg(
        F.min(F.when(F.col("_ok"), F.struct("level", "cell"))).alias("hit"),
        F.max(F.when(F.col("level") == last, F.struct("level", "cell"))).alias("coarse"))
    # the join that follows counts its keys first and would search twice
    pick = shared_table(chosen.select(*by, "x", "y", F.coalesce("hit", "coarse").alias("c")), "search-cells")
    return pick.select(*by, "x", "y", F.col("c.level").alias("level"), F.explode(H.disk("c.cell", 3)).alias("cell"))


def neighbour_pairs(queries: DataFrame, anchors: DataFrame, by: Sequence[str], k: int, sides: Sequence[float]) -> DataFrame:
    """Every query place beside the anchors in the cells that hold its ``k`` nearest, with the distance."""
    cells = _search_cells(queries, anchors, by, k, sides)
    there = anchors.select(*by, F.col("x").alias("tx"), F.col("y").alias("ty"), "_t",
                           F.explode(_level_cells(sides)).alias("c")).select(
        *by, "tx", "ty", "_t", F.col("c.level").alias("level"), F.col("c.cell").alias("cell"))
    return skewed_join(cells, there, [*by, "level", "cell"]).withColumn("distance", H.distance("x", "y", "tx", "ty"))


def nearest_k(points: DataFrame, targets: DataFrame, point_id: str, target_id: str, k: int = 1,
              radius: float | None = None, by: Sequence[str] = (), side: float | None = None) -> DataFrame:
    """``(point, rank, target, distance)`` of the k nearest targets, exact, ties by target id.

    The search adapts its cell size to the local density, so a dense spot compares
    few pairs and an empty one still finds its neighbours. Targets that share a
    place are cut to k there (the others cannot be among the k), and equal query
    places are searched once.
    """
    by = list(by)
    placed = targets.select(*by, "x", "y", F.col(target_id).alias("_t")).where("x IS NOT NULL AND y IS NOT NULL")
    asked = points.where("x IS NOT NULL AND y IS NOT NULL")
    reach = radius if radius is not None else _reach(asked, placed)
    sides = _levels(side or finest_side(placed.count(), reach), reach)
    # row_number <= k runs as a group limit before the shuffle
    same = Window.partitionBy(*by, "x", "y").orderBy("_t")
    anchors = placed.withColumn("_rn", F.row_number().over(same)).where(F.col("_rn") <= k).drop("_rn")
    queries = asked.select(*by, "x", "y").distinct()
    pairs = neighbour_pairs(queries, anchors, by, k, sides)
    if radius is not None:
        pairs = pairs.where(F.col("distance") <= radius)
    order = Window.partitionBy(*by, "x", "y").orderBy("distance", "_t")
    best = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        *by, "x", "y", "rank", F.col("_t").alias(target_id), "distance")
    return asked.select(F.col(point_id).alias("_p"), *by, "x", "y").join(best, [*by, "x", "y"]).select(
        F.col("_p").alias(point_id if point_id != target_id else f"query_{point_id}"), "rank", target_id, "distance")


def nearest_distance(points: DataFrame, targets: DataFrame, point_id: str, target_id: str,
                     name: str = "distance") -> DataFrame:
    """Distance from every point to its closest target."""
    found = nearest_k(points, targets, point_id, target_id)
    key = point_id if point_id != target_id else f"query_{point_id}"
    found = found.select(F.col(key).alias("_p"), F.col("distance").alias(name))
    joined = points.join(found, points[point_id] == found["_p"], "left")
    return joined.select(*[points[c] for c in points.columns], name)


#: As many cells that places look into are sent to every task.
FEW_CELLS = 200_000


def edge_rows(polygons: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per edge ``ax, ay, bx, by`` beside the ordinal and ``columns`` of its polygon."""
    return spread(polygons).select("ordinal", *columns, F.explode(all_edges(F.col("rings"))).alias("e")).select(
        "ordinal", *columns, F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"),
        F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def edge_cells(edges: DataFrame, sides: Sequence[float]) -> DataFrame:
    """Every edge beside the cells that it meets, at every level; a long one misses most cells of its box."""
    boxed = edges.select("*", F.least("ax", "bx").alias("x0"), F.greatest("ax", "bx").alias("x1"),
                         F.least("ay", "by").alias("y0"), F.greatest("ay", "by").alias("y1"))
    return reduce(DataFrame.unionByName, [
        explode_box_cells(boxed, s, i + 1).where(_meets_hexagon("cell", s, 1e-6 * s)).drop("x0", "x1", "y0", "y1").withColumn(
            "level", F.lit(i)) for i, s in enumerate(sides)])


def nearest_edge(places: DataFrame, edges: DataFrame, by: Sequence[str], columns: Sequence[str], finest: float) -> DataFrame:
    """``by, x, y, b``: for every place the least ``(distance, ordinal, columns)`` over the edges with its ``by``."""
    by = list(by)
    # the corners are points of the outline: they decide how far to look
    corners = edges.select(*by, F.col("ax").alias("x"), F.col("ay").alias("y"))
    sides = _levels(max(finest, 1e-6), _reach(places, corners))
    cells = _search_cells(places.select(*by, "x", "y").distinct(), corners, by, 1, sides)
    there = edge_cells(edges, sides)
    # few places look into few cells: the edges of all others are not shuffled
    looked = shared_table(cells.select(*by, "level", "cell").distinct(), "looked-cells")
    if looked.count() <= FEW_CELLS:
        there = there.join(F.broadcast(looked), [*by, "level", "cell"], "left_semi")
    pairs = skewed_join(cells, there, [*by, "level", "cell"]).withColumn(
        "distance", segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    return pairs.groupBy(*by, "x", "y").agg(F.min(F.struct("distance", "ordinal", *[c for c in columns if c not in by])).alias("b"))


def nearest_polygon(points: DataFrame, polygons: DataFrame, point_id: str, columns: Sequence[str],
                    mask: Column | None = None) -> DataFrame:
    """Point in polygon, else the closest polygon; ``how`` says ``contem`` or ``proximo``."""
    # read three times below, so the point-in-polygon join is written once
    named = cut_lineage(point_in_polygon(points, polygons, point_id, columns))
    rest = named.where("matches = 0 AND x IS NOT NULL AND y IS NOT NULL").select(
        F.col(point_id).alias("_p"), "x", "y")
    allowed = polygons if mask is None else polygons.where(mask)
    best = nearest_edge(rest, edge_rows(allowed, columns), [], columns, box_side(polygons) / 8)
    near = rest.join(best, ["x", "y"]).select("_p", F.col("b.distance").alias("distance"),
                                              *[F.col(f"b.{c}").alias(f"_{c}") for c in columns])
    joined = named.join(near, named[point_id] == near["_p"], "left")
    inside = F.col("matches") > 0
    return joined.select(
        *[named[c] for c in points.columns],
        *[F.when(inside, named[c]).otherwise(F.col(f"_{c}")).alias(c) for c in columns],
        F.when(inside, "contem").when(F.col("_p").isNotNull(), "proximo").alias("how"),
        F.when(inside, F.lit(0.0)).otherwise(F.col("distance")).alias("distance"), "matches")


def declared_area_check(points: DataFrame, polygons: DataFrame, point_id: str, declared: str, name: str) -> DataFrame:
    """Is a point where it says it is? ``place`` and the distance to the declared area or its own border.

    A point meets only edges near it of the area it declares, found by area and cell, not whole
    outlines by the name of the area.
    """
    around = cut_lineage(containing(points, polygons, point_id, [name]))
    known = points.select(F.col(point_id).alias("_id"), F.col(declared).alias("_declared"), "x", "y")
    found = known.join(around, "_id", "left").groupBy("_id").agg(
        F.min_by(name, "ordinal").alias("_found"), F.max(F.col(name) == F.col("_declared")).alias("_within"))
    asked = known.where("x IS NOT NULL AND y IS NOT NULL AND _declared IS NOT NULL").withColumnRenamed("_declared", name)
    named = polygons.join(asked.select(name).distinct(), name, "left_semi")
    border = nearest_edge(asked, edge_rows(named, [name]), [name], [], box_side(polygons) / 8).select(
        F.col(name).alias("_name"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("b.distance").alias("_border"))
    joined = points.join(found, points[point_id] == found["_id"], "left").join(
        border, (points[declared] == border["_name"]) & (points["x"] == border["_x"]) & (points["y"] == border["_y"]), "left")
    place = (F.when(F.col("_found").eqNullSafe(F.col(declared)) & F.col("_found").isNotNull(), "declared")
             .when(F.col("_found").isNull(), "none").otherwise("other"))
    # a point inside two areas counts under the first, yet lies inside the declared one too
    outside = F.when(F.col("_within"), F.lit(0.0)).otherwise(F.col("_border"))
    return joined.select(*[points[c] for c in points.columns], place.alias("place"),
                         F.when(place == "declared", F.col("_border")).alias("border_m"),
                         F.when(place != "declared", outside).alias("declared_m"))


def declared_area_report(checked: DataFrame, limit_m: float = 150.0) -> DataFrame:
    from rentgrid.operators.ranks import quantiles
    counts = checked.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("place") == p).alias(f"n_{p}") for p in ("declared", "other", "none")],
        F.count_if(F.col("declared_m") <= limit_m).alias("near_declared"),
        F.count_if(F.col("border_m") <= limit_m).alias("near_border"))
    levels = quantiles(checked, [], {"declared_m": F.col("declared_m"), "border_m": F.col("border_m")},
                       {"median": 0.5, "p90": 0.9})
    return (counts.withColumn("_k", F.lit(1)).join(levels.withColumn("_k", F.lit(1)), "_k", "left").drop("_k"))


# --- radius and rings -------------------------------------------------------------------

def radius_pairs(points: DataFrame, targets: DataFrame, point_id: str, radius: float,
                 columns: Sequence[str]) -> DataFrame:
    """All ``(point, target)`` pairs within a radius: cells of edge ``radius`` make one ring enough."""
    placed = points.select(F.col(point_id).alias("_p"), "x", "y", H.cell_at("x", "y", radius, 1).alias("cell"))
    spread = targets.select(F.col("x").alias("tx"), F.col("y").alias("ty"), *columns,
                            F.explode(H.disk(H.cell_at("x", "y", radius, 1), 1)).alias("cell"))
    pairs = skewed_join(placed, spread, ["cell"]).withColumn("distance", H.distance("x", "y", "tx", "ty"))
    return pairs.where(F.col("distance") <= radius).select(F.col("_p").alias(point_id), *columns, "distance")


def within_radius(points: DataFrame, targets: DataFrame, point_id: str, radius: float, complex_id: str,
                  lines: str, separator: str = " ") -> DataFrame:
    """Per point: distinct complexes and distinct lines within the radius, zero where there is none.

    A task compares the points of a cell with the targets of the cells around it and
    keeps counts, so no row per pair is made. Full cells are dealt in pieces: points at
    random, targets by complex, so that the pieces' complexes add up. Points whose id
    repeats go by pairs, as their targets have to meet in one place.
    """
    repeated = points.groupBy(point_id).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(point_id)
    # few or none as a rule, so read from a table that tells the planner so
    repeated = shared_table(repeated, "repeated-ids")
    alone = points.join(repeated, point_id, "left_anti")
    counts = _counted_within(alone, targets, point_id, radius, complex_id, lines, separator)
    if repeated.first() is not None:
        counts = counts.unionByName(_paired_within(points.join(repeated, point_id, "left_semi"), targets, point_id, radius,
                                                   complex_id, lines, separator))
    return points.select(point_id).join(counts, point_id, "left").fillna(0, ["complexes", "lines"])


def _paired_within(points: DataFrame, targets: DataFrame, point_id: str, radius: float, complex_id: str,
                   lines: str, separator: str) -> DataFrame:
    pairs = radius_pairs(points, targets, point_id, radius, [complex_id, lines])
    # one pass over the pairs: a row per line, and one without a line that carries the complex
    served = F.concat(F.array(F.lit("")), F.split(F.coalesce(F.col(lines), F.lit("")), separator))
    return pairs.select(point_id, complex_id, F.explode(F.array_distinct(served)).alias("line")).groupBy(point_id).agg(
        F.count_distinct(complex_id).alias("complexes"), F.count_distinct(F.when(F.col("line") != "", F.col("line"))).alias("lines"))


#: Points and targets of a cell that one task compares, and the distances it holds at once.
PIECE_POINTS, PIECE_TARGETS, BLOCK_PAIRS = 20_000, 100_000, 2_000_000


def _counted_within(points: DataFrame, targets: DataFrame, point_id: str, radius: float, complex_id: str,
                    lines: str, separator: str) -> DataFrame:
    """``point_id, complexes, lines`` of points with an id of their own that have a target within the radius."""
    placed = points.where(F.col(point_id).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        F.col(point_id).alias("_p"), "x", "y", H.cell_at("x", "y", radius, 1).alias("cell"))
    served = F.array_distinct(F.split(F.coalesce(F.col(lines), F.lit("")), separator))
    spread = targets.where("x IS NOT NULL AND y IS NOT NULL").select(
        F.col("x").alias("tx"), F.col("y").alias("ty"), F.col(complex_id).cast("string").alias("_c"),
        F.filter(served, lambda v: v != "").alias("_l"), F.explode(H.disk(H.cell_at("x", "y", radius, 1), 1)).alias("cell"))
    full = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PIECE_POINTS).alias("_np")).join(
        spread.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PIECE_TARGETS).alias("_nt")), "cell")
    full = shared_table(full, "radius-cells")
    every = [F.sequence(F.lit(0).cast("long"), F.col(n) - 1) for n in ("_np", "_nt")]
    asked = placed.join(full, "cell").withColumn("_a", F.pmod(F.xxhash64("_p", F.lit(1)), F.col("_np"))).withColumn(
        "_b", F.explode(every[1])).select("cell", "_a", "_b", "_p", "x", "y")
    there = spread.join(full, "cell").withColumn("_b", F.pmod(F.xxhash64("_c"), F.col("_nt"))).withColumn(
        "_a", F.explode(every[0])).select("cell", "_a", "_b", "tx", "ty", "_c", "_l")

    def compare(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if p.empty or t.empty:
            return pd.DataFrame({"_p": p["_p"][:0], "complexes": np.zeros(0, np.int64), "lines": pd.Series([], dtype=object)})
        names = np.array(sorted({v for row in t["_l"] for v in row}), dtype=object)
        place = {v: i for i, v in enumerate(names)}
        serves = np.zeros((len(t), len(names)), np.float32)
        for i, row in enumerate(t["_l"]):
            serves[i, [place[v] for v in row]] = 1
        code, known = pd.factorize(t["_c"])           # -1: no complex
        first = np.flatnonzero(~pd.Series(code).duplicated().to_numpy() & (code >= 0))
        single = len(known) == (code >= 0).sum()
        px, py, tx, ty = (c.to_numpy(dtype=float) for c in (p["x"], p["y"], t["tx"], t["ty"]))
        complexes, found = np.zeros(len(p), np.int64), []
        step = max(1, BLOCK_PAIRS // len(t))
        for at in range(0, len(p), step):
            dx, dy = px[at:at + step, None] - tx, py[at:at + step, None] - ty
            near = np.sqrt(dx * dx + dy * dy) <= radius
            if single:
                complexes[at:at + step] = near[:, first].sum(axis=1)
            else:
                row, col = np.nonzero(near & (code >= 0))
                own = np.unique(row * np.int64(max(len(known), 1)) + code[col])
                complexes[at:at + step] = np.bincount(own // max(len(known), 1), minlength=len(near))
            hit = near.astype(np.float32) @ serves > 0
            found += [list(names[h]) for h in hit]
        return pd.DataFrame({"_p": p["_p"].to_numpy(), "complexes": complexes, "lines": pd.Series(found, dtype=object)})

    kind = points.schema[point_id].dataType.simpleString()
    # few bytes make much work: as many tasks as the session has, not merged by size
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked, there = (side.repartition(tasks, "cell", "_a", "_b") for side in (asked, there))
    parts = asked.groupBy("cell", "_a", "_b").cogroup(there.groupBy("cell", "_a", "_b")).applyInPandas(
        compare, f"_p {kind}, complexes long, lines array<string>")
    return parts.groupBy(F.col("_p").alias(point_id)).agg(
        F.sum("complexes").alias("complexes"),
        F.size(F.array_distinct(F.flatten(F.collect_list("lines")))).cast("long").alias("lines"))


def ring_sum(cells: DataFrame, counts: DataFrame, cell: str, value: str, k: int = 1, name: str = "ring_sum") -> DataFrame:
    """Sum of ``value`` over each cell and its k rings, counting cells the table does not have."""
    around = cells.select(cell, F.explode(H.disk(cell, k)).alias("_near"))
    summed = counts.groupBy(F.col(cell).alias("_near")).agg(F.sum(value).alias("_v"))
    sums = around.join(summed, "_near", "left").groupBy(cell).agg(F.coalesce(F.sum("_v"), F.lit(0)).alias(name))
    return cells.join(sums, cell, "left")


def reallocate(cells: DataFrame, covered: DataFrame, cell: str, side: float, max_ring: int = 3) -> DataFrame:
    """``(cell, target, ring)``: the cell itself if covered, else the closest covered one, else NULL.

    Runs on distinct cells; at most 1 + 3k(k+1) candidates each.
    """
    have = covered.select(F.col(cell).alias("_near")).distinct()
    wanted = cells.select(cell).where(F.col(cell).isNotNull()).distinct()
    near = wanted.select(cell, F.explode(H.disk_with_ring(cell, max_ring)).alias("c")).select(
        cell, F.col("c.cell").alias("_near"), F.col("c.ring").alias("ring"))
    x, y = H.center_at(cell, side)
    nx, ny = H.center_at("_near", side)
    hits = near.join(have, "_near").withColumn("_d", F.round(H.distance(x, y, nx, ny), 3))
    best = hits.groupBy(cell).agg(F.min(F.struct("ring", "_d", "_near")).alias("b"))
    return wanted.join(best, cell, "left").select(cell, F.col("b._near").alias("target"), F.col("b.ring").alias("ring"))


# --- cover and land fraction ------------------------------------------------------------

def _edge_rows(polygons: DataFrame, key: str) -> DataFrame:
    return spread(polygons).select(key, F.explode(all_edges(F.col("rings"))).alias("e")).select(
        key, F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def _inside_cells(edges: DataFrame, key: str, res: int, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """``(key, cell)``: the cells with the point ``(dx, dy)`` from their centre inside the polygon.

    Scans the rows of the grid between the crossings of the outline.
    """
    side = H.side_of(res)
    height, step = 1.5 * side, side * H.ROOT3
    lined = _grid_rows(edges, F.least("ay", "by") - dy, F.greatest("ay", "by") - dy, height)
    y = F.col("r") * height + dy
    crossing = lined.where((F.col("ay") > y) != (F.col("by") > y)).select(
        key, "r", (F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")) - dx).alias("cx"))
    # odd-numbered crossings open an interval, even-numbered ones close it
    order = Window.partitionBy(key, "r").orderBy("cx")
    spans = crossing.select(key, "r", "cx", F.lead("cx").over(order).alias("nx"),
                            F.row_number().over(order).alias("i")).where("i % 2 = 1 AND nx IS NOT NULL")
    first = F.ceil(F.col("cx") / step - F.col("r") / 2)
    last = F.floor(F.col("nx") / step - F.col("r") / 2)
    return _fill(spans, key, res, first, last)


def _outline_cells(edges: DataFrame, key: str, res: int) -> DataFrame:
    """``(key, cell, ax, ay, bx, by)``: every edge in the cells that it meets."""
    boxed = edges.select("*", F.least("ax", "bx").alias("x0"), F.greatest("ax", "bx").alias("x1"),
                         F.least("ay", "by").alias("y0"), F.greatest("ay", "by").alias("y1"))
    side = H.side_of(res)
    return explode_box_cells(boxed, side, res).where(_meets_hexagon("cell", side)).select(key, "cell", "ax", "ay", "bx", "by")


def cover(polygons: DataFrame, key: str, res: int) -> DataFrame:
    """``(key, cell, whole)``: every cell that touches a polygon; ``whole`` if no outline crosses it.

    Cells with their centre inside come from scanning the rows of the grid; cells on
    the outline come from clipping each edge against the hexagons of its box.
    """
    edges = _edge_rows(polygons, key)
    inner, touched = _inside_cells(edges, key, res), _outline_cells(edges, key, res).select(key, "cell")
    both = inner.withColumn("edge", F.lit(0)).unionByName(touched.withColumn("edge", F.lit(1)))
    return both.groupBy(key, "cell").agg((F.max("edge") == 0).alias("whole"))


def _grid_rows(edges: DataFrame, low: Column, high: Column, height: float) -> DataFrame:
    first, last = F.ceil(low / height), F.floor(high / height)
    return edges.where(first <= last).withColumn("r", F.explode(F.sequence(first, last)))


def _fill(spans: DataFrame, key: str, res: int, first: Column, last: Column) -> DataFrame:
    return (spans.where(first <= last).withColumn("q", F.explode(F.sequence(first, last)))
            .select(key, H.pack(res, F.col("q"), F.col("r")).alias("cell")))


def _meets_hexagon(cell: str, side: float, slack: float = 0.0) -> Column:
    """Does the segment (ax,ay)-(bx,by) meet the hexagon? Clipped against its six half planes, each moved out by ``slack``."""
    cx, cy = H.center_at(cell, side)
    apothem = side * H.ROOT3 / 2 + slack
    enters, leaves, possible = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for i in range(6):
        nx, ny = math.cos(math.radians(60 * i)), math.sin(math.radians(60 * i))
        start = (F.col("ax") - cx) * nx + (F.col("ay") - cy) * ny - apothem
        slope = (F.col("bx") - F.col("ax")) * nx + (F.col("by") - F.col("ay")) * ny
        at = -start / F.when(slope != 0, slope)
        enters.append(F.when(slope < 0, at))
        leaves.append(F.when(slope > 0, at))
        possible = possible & ((slope != 0) | (start <= 0))
    return possible & (F.greatest(*enters) <= F.least(*leaves))


#: Where in a cell the polygons are asked for their inside, in cell edges from the centre; off any round number.
PROBE = (0.01234567, 0.00765432)


#: More edges than this in a box are looked at in its four parts, at most so many times over.
BOX_EDGES, BOX_DEPTH = 24, 24
#: Where a box is cut and asked for its inside; off any round number.
CUT, OFF = 0.48765432, 0.01234567


def union_share(cx: float, cy: float, side: float, owner: np.ndarray, edges: np.ndarray, holds: np.ndarray) -> float:
    """Share of a hexagon inside the union of polygons, from the edges that meet it; exact.

    ``owner`` numbers the polygon of each edge, ``holds`` says which polygons have the
    probe point inside. A box with many edges is cut into four: a part that lies whole in some polygon
    needs none of its edges, so work follows the outline of the union and not the pairs of edges below it.
    """
    apothem = side * math.sqrt(3) / 2
    todo = [((cx - apothem, cy - side, cx + apothem, cy + side), (cx + PROBE[0] * side, cy + PROBE[1] * side),
             *distinct_shapes(owner, edges, holds), 0)]
    area = 0.0
    while todo:
        box, probe, owner, edges, holds, depth = todo.pop()
        if len(edges) <= BOX_EDGES or depth == BOX_DEPTH:
            area += union_area(cx, cy, side, box, probe, owner, edges, holds)
            continue
        x0, y0, x1, y1 = box
        x, y = x0 + CUT * (x1 - x0), y0 + CUT * (y1 - y0)
        for part in ((x0, y0, x, y), (x, y0, x1, y), (x0, y, x, y1), (x, y, x1, y1)):
            place = point_in_box(cx, cy, side, part)
            if place is None:
                continue
            turned = np.bincount(owner[_crossed(*probe, *place, edges)], minlength=len(holds)) % 2 == 1
            inside = holds != turned
            near = _meets_box(part, edges)
            outlined = np.bincount(owner[near], minlength=len(holds)) > 0
            if (inside & ~outlined).any():
                none = np.empty((0, 4))
                area += union_area(cx, cy, side, part, place, np.empty(0, dtype=int), none, np.array([True]))
            elif outlined.any():
                number = np.cumsum(outlined) - 1
                todo.append((part, place, *distinct_shapes(number[owner[near]], edges[near], inside[outlined]), depth + 1))
    return area / (1.5 * math.sqrt(3) * side * side)


def distinct_shapes(owner: np.ndarray, edges: np.ndarray, holds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polygons that are the same here (the same edges and inside) count once."""
    order = np.lexsort((*edges.T, owner))
    owner, edges = owner[order], edges[order]
    starts = np.searchsorted(owner, np.arange(len(holds) + 1))
    first: dict[bytes, int] = {}
    for k in range(len(holds)):
        first.setdefault(bytes([int(holds[k])]) + edges[starts[k]:starts[k + 1]].tobytes(), k)
    if len(first) == len(holds):
        return owner, edges, holds
    kept = np.zeros(len(holds), dtype=bool)
    kept[list(first.values())] = True
    own = kept[owner]
    return (np.cumsum(kept) - 1)[owner[own]], edges[own], holds[kept]


def _half_width(cy: float, side: float, y):
    apothem = side * math.sqrt(3) / 2
    return np.minimum(apothem, apothem * (side - np.abs(y - cy)) / (side / 2))


def point_in_box(cx: float, cy: float, side: float, box: tuple[float, float, float, float]) -> tuple[float, float] | None:
    """A point that lies in the box and in the hexagon; none if they do not meet."""
    x0, y0, x1, y1 = box
    widest = min(max(cy, y0), y1)
    for y in (widest + OFF * ((y0 + y1) / 2 - widest), widest):
        half = float(_half_width(cy, side, y))
        low, high = max(x0, cx - half), min(x1, cx + half)
        if half > 0 and low < high:
            return low + CUT * (high - low), y
    return None


def _side_of(x1, y1, x2, y2, x, y):
    return (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)


def _crossed(x: float, y: float, to_x, to_y, edges: np.ndarray) -> np.ndarray:
    """Which edges the straight way from one point to another crosses."""
    ax, ay, bx, by = edges.T
    one, two = _side_of(x, y, to_x, to_y, ax, ay) > 0, _side_of(x, y, to_x, to_y, bx, by) > 0
    return (one != two) & ((_side_of(ax, ay, bx, by, x, y) > 0) != (_side_of(ax, ay, bx, by, to_x, to_y) > 0))


def _meets_box(box: tuple[float, float, float, float], edges: np.ndarray) -> np.ndarray:
    """Which edges can meet the box; a hair's breadth more does no harm."""
    ax, ay, bx, by = edges.T
    wide = 1e-9 * (box[2] - box[0] + box[3] - box[1])
    x0, y0, x1, y1 = box[0] - wide, box[1] - wide, box[2] + wide, box[3] + wide
    there = (np.maximum(ax, bx) >= x0) & (np.minimum(ax, bx) <= x1) & (np.maximum(ay, by) >= y0) & (np.minimum(ay, by) <= y1)
    turns = np.array([_side_of(ax, ay, bx, by, u, v) for u in (x0, x1) for v in (y0, y1)])
    return there & (turns.min(axis=0) <= 0) & (turns.max(axis=0) >= 0)


def union_area(cx: float, cy: float, side: float, box: tuple[float, float, float, float], probe: tuple[float, float],
               owner: np.ndarray, edges: np.ndarray, holds: np.ndarray) -> float:
    """Area of the union of polygons inside a hexagon and a box, from the edges that meet both.

    ``holds`` says which polygons have the ``probe`` inside, a point of box and hexagon. Between
    neighbouring heights at which a corner lies or two lines cross, every polygon's cut is a set of
    trapezoids, so the union's width at the middle height times the height is its area there, exactly.
    """
    px, py = probe
    x0, y0, x1, y1 = box
    turn = np.radians(60 * np.arange(6) - 30)
    corners = np.stack([cx + side * np.cos(turn), cy + side * np.sin(turn)], axis=1)
    square = np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]])
    lines = np.concatenate([edges, *[np.concatenate([c, np.roll(c, -1, axis=0)], axis=1) for c in (corners, square)]])
    start, step = lines[:, :2], lines[:, 2:] - lines[:, :2]
    cross = step[:, None, 0] * step[None, :, 1] - step[:, None, 1] * step[None, :, 0]
    gap = start[None, :, :] - start[:, None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * step[None, :, 1] - gap[..., 1] * step[None, :, 0]) / cross
        u = (gap[..., 0] * step[:, None, 1] - gap[..., 1] * step[:, None, 0]) / cross
        meet = (start[:, None, 1] + t * step[:, None, 1])[(cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)]
    heights = np.concatenate([meet, lines[:, 1], lines[:, 3]])
    heights = np.unique(heights[(heights >= max(cy - side, y0)) & (heights <= min(cy + side, y1))])
    middle, thick = (heights[1:] + heights[:-1]) / 2, np.diff(heights)
    half = _half_width(cy, side, middle)
    # a hair inside the sides, where an outline that runs along a side is not in doubt
    left, right = np.maximum(cx - half * (1 - 1e-9), x0), np.minimum(cx + half * (1 - 1e-9), x1)
    open_rows = left < right
    middle, thick, left, right = middle[open_rows], thick[open_rows], left[open_rows], right[open_rows]
    ax, ay, bx, by = edges.T
    hit = (ay[None, :] > middle[:, None]) != (by[None, :] > middle[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = np.where(hit, ax + (middle[:, None] - ay) * (bx - ax) / (by - ay), np.inf)
    # from the probe to the left side at each height: every edge in between turns inside to outside
    between = _crossed(px, py, left[:, None], middle[:, None], edges)
    begins, ends = [], []
    for k in range(len(holds)):
        own = owner == k
        inside = between[:, own].sum(axis=1) + int(holds[k])   # parity at the left side
        within = (at[:, own] > left[:, None]) & (at[:, own] < right[:, None])
        xs = np.sort(np.where(within, at[:, own], np.inf), axis=1)
        first = np.concatenate([left[:, None], xs], axis=1)
        last = np.minimum(np.concatenate([xs, right[:, None]], axis=1), right[:, None])
        open_ = np.isfinite(first) & ((inside[:, None] + np.arange(first.shape[1])[None, :]) % 2 == 1)
        begins.append(np.where(open_, first, np.inf))
        ends.append(np.where(open_, last, -np.inf))
    covered, reach = np.zeros(len(middle)), left.copy()
    b, e = np.concatenate(begins, axis=1), np.concatenate(ends, axis=1)
    order = np.argsort(b, axis=1)
    b, e = np.take_along_axis(b, order, axis=1), np.take_along_axis(e, order, axis=1)
    for j in range(b.shape[1]):                                # intervals by their beginning: add what is new
        covered += np.maximum(0.0, e[:, j] - np.maximum(reach, np.where(np.isfinite(b[:, j]), b[:, j], np.inf)))
        reach = np.maximum(reach, e[:, j])
    return float((covered * thick).sum())


def land_fraction(covered: DataFrame, polygons: DataFrame, key: str, res: int) -> DataFrame:
    """``(cell, land)``: share of each covered cell inside the union of the polygons.

    A cell that lies whole in some polygon is 1. A cell on outlines brings only the
    edges that meet it and, per polygon, whether the probe point near its centre is inside.
    """
    side = H.side_of(res)
    edges = _edge_rows(polygons, key)
    full = covered.groupBy("cell").agg(F.max("whole").alias("whole"))
    holds = _inside_cells(edges, key, res, PROBE[0] * side, PROBE[1] * side).select(key, "cell", F.lit(True).alias("holds"))
    local = (_outline_cells(edges, key, res).groupBy(key, "cell")
             .agg(F.collect_list(F.array("ax", "ay", "bx", "by")).alias("edges")))
    shapes = (local.join(holds, [key, "cell"], "left").withColumn("holds", F.coalesce("holds", F.lit(False)))
              .groupBy("cell").agg(F.collect_list(F.struct("edges", "holds")).alias("shapes")))
    x, y = H.center_at("cell", side)

    @F.pandas_udf("double")
    def share(cx: pd.Series, cy: pd.Series, shapes: pd.Series) -> pd.Series:
        out = []
        for x, y, parts in zip(cx, cy, shapes):
            lists = [np.array([list(e) for e in p["edges"]], dtype=float) for p in parts]
            owner = np.repeat(np.arange(len(lists)), [len(e) for e in lists])
            out.append(union_share(x, y, side, owner, np.concatenate(lists), np.array([p["holds"] for p in parts])))
        return pd.Series(out, dtype="float64")

    cut = full.where(~F.col("whole")).join(shapes, "cell").select("cell", share(x, y, F.col("shapes")).alias("land"))
    return full.where("whole").select("cell", F.lit(1.0).alias("land")).unionByName(
        cut.select("cell", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("land"))).alias("land")))


# --- graph of cells -----------------------------------------------------------------------

def weights(cells: DataFrame, cell: str) -> DataFrame:
    """Row-standardised neighbour edges ``(src, dst, w)``.

    A cell without neighbours has no edge. Adjacency is symmetric, so such a cell is
    nobody's neighbour and leaving it out takes no further cell with it.
    """
    present = cells.select(F.col(cell).alias("src")).where(F.col("src").isNotNull()).distinct()
    near = present.select("src", F.explode(H.ring("src", 1)).alias("dst"))
    edges = near.join(present.select(F.col("src").alias("dst")), "dst")
    degree = edges.groupBy("src").agg((1 / F.count(F.lit(1))).alias("w"))
    return edges.join(degree, "src").select("src", "dst", "w")


def islands(cells: DataFrame, cell: str) -> DataFrame:
    """Cells without any neighbour in the table."""
    linked = weights(cells, cell).select(F.col("src").alias(cell)).distinct()
    return cells.select(cell).where(F.col(cell).isNotNull()).distinct().join(linked, cell, "left_anti")

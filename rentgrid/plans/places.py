"""Grid cells and spatial joins over the places of customers and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentgrid.functions import hexgrid as H
from rentgrid.operators import spatial as SP
from rentgrid.plans.registry import query, rounded
from rentgrid.plans.tables import HOSTS, STATIONS, hosts, rd, stations

LANDMARKS = [(40.7580, -73.9855), (40.7061, -74.0088), (40.6413, -73.7781)]
RADIUS = 3000.0


def points(spark, sf):
    return SP.add_plane(hosts(spark, sf))


def places(spark, sf):
    return SP.add_plane(stations(spark, sf))


def triangles(spark, sf):
    """One right-angled area per supplier, its corner at the supplier."""
    s = stations(spark, sf)

    def corner(dx: float, dy: float):
        return F.struct((F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat"))

    rings = F.array(F.array(corner(0, 0), corner(0.04, 0), corner(0, 0.03)))
    return SP.project_rings(s.select(F.col("station_id").alias("ordinal"), F.col("station_id").alias("area_name"),
                                     "area_id", rings.alias("rings")))


XY = (f"((lon - CAST({H.ORIGIN_LON} AS DOUBLE)) * CAST({H.METRES_PER_DEGREE_LON!r} AS DOUBLE)) AS x, "
      f"((lat - CAST({H.ORIGIN_LAT} AS DOUBLE)) * CAST({H.METRES_PER_DEGREE_LAT!r} AS DOUBLE)) AS y")
PTS = f"{HOSTS}, pts AS (SELECT *, {XY} FROM hosts)"
PLS = f"{STATIONS}, pls AS (SELECT *, {XY} FROM stations)"


def cell_sql(name: str, source: str, res: int, columns: str) -> str:
    """CTEs that add ``cell`` to ``source`` (planar x, y)."""
    side = H.side_of(res)
    return f"""{name}_u AS (SELECT *, x * CAST({1 / (side * H.ROOT3)!r} AS DOUBLE) AS u, y * CAST({1 / side!r} AS DOUBLE) AS v FROM {source}),
{name}_c AS (SELECT *, floor((floor(2 * u + 1) + floor(u - v + 1)) / 3) AS q,
  -floor((floor(u - v + 1) + floor(1 - u - v)) / 3) AS r FROM {name}_u),
{name} AS (SELECT {columns}, CAST(q AS BIGINT) AS q, CAST(r AS BIGINT) AS r,
  CAST({res * H.RES_UNIT} AS BIGINT) + CAST(q + {H.OFFSET} AS BIGINT) * CAST({H.Q_UNIT} AS BIGINT) + CAST(r + {H.OFFSET} AS BIGINT) AS cell FROM {name}_c)"""


def with_cell(df, res):
    return df.withColumn("cell", H.cell("x", "y", res))


@query("cells", f"WITH {PTS}, {cell_sql('c9', 'pts', 9, 'host_id')}, {cell_sql('c8', 'pts', 8, 'host_id')}, {cell_sql('c6', 'pts', 6, 'host_id')} "
       "SELECT c9.host_id, c9.cell AS r9, c8.cell AS r8, c6.cell AS r6 FROM c9 JOIN c8 USING (host_id) JOIN c6 USING (host_id)")
def cells(spark, sf):
    return points(spark, sf).select("host_id", *[H.cell("x", "y", n).alias(f"r{n}") for n in (9, 8, 6)])


@query("cells_utm")
def cells_utm(spark, sf):
    """The metric projection of the domain; centres are taken back to degrees."""
    h = hosts(spark, sf).withColumn("r8", H.cell_of("lat", "lon", 8))
    lon, lat = H.from_utm(*H.cell_center("r8", 8))
    return rounded(h.groupBy("r8").agg(F.count(F.lit(1)).alias("n")).select("r8", "n", lon.alias("lon"), lat.alias("lat")))


def center_sql(res: int) -> str:
    side = H.side_of(res)
    return (f"(q + r / 2) * CAST({side * H.ROOT3!r} AS DOUBLE) AS x, r * CAST({1.5 * side!r} AS DOUBLE) AS y")


@query("parent_cells", f"WITH {PTS}, {cell_sql('c9', 'pts', 9, 'host_id')}, ctr AS (SELECT DISTINCT cell AS r9, {center_sql(9)} FROM c9), "
       f"{cell_sql('p8', 'ctr', 8, 'r9, x, y')} SELECT r9, {rd('x', 3)} AS x, {rd('y', 3)} AS y, cell AS r8 FROM p8")
def parent_cells(spark, sf):
    c = with_cell(points(spark, sf), 9).select(F.col("cell").alias("r9")).distinct()
    x, y = H.cell_center("r9", 9)
    return c.select("r9", (F.round(x, 3) + 0.0).alias("x"), (F.round(y, 3) + 0.0).alias("y"), H.parent("r9", 9, 8).alias("r8"))


@query("grid_distance", f"WITH {PTS}, {PLS}, {cell_sql('a', 'pts', 8, 'host_id, area_id')}, {cell_sql('b', 'pls', 8, 'station_id, area_id')}, "
       "f AS (SELECT area_id, min(station_id) AS station_id FROM b GROUP BY area_id) "
       "SELECT host_id, CAST((abs(a.q - b.q) + abs(a.r - b.r) + abs(a.q - b.q + a.r - b.r)) / 2 AS BIGINT) AS steps "
       "FROM a JOIN f USING (area_id) JOIN b ON b.station_id = f.station_id")
def grid_distance(spark, sf):
    b = with_cell(places(spark, sf), 8).groupBy("area_id").agg(F.min_by("cell", "station_id").alias("to"))
    return with_cell(points(spark, sf), 8).join(b, "area_id").select("host_id", H.grid_distance("cell", "to").alias("steps"))


NEIGHBOURS = "(SELECT unnest([0, 1, 1, 0, -1, -1, 0]) AS dq, unnest([0, 0, -1, -1, 0, 1, 1]) AS dr)"


@query("ring_sum", f"WITH {PTS}, {cell_sql('c', 'pts', 8, 'host_id')}, n AS (SELECT cell, q, r, count(*) AS n FROM c GROUP BY ALL) "
       f"SELECT a.cell, a.n, CAST(sum(coalesce(b.n, 0)) AS BIGINT) AS ring_sum FROM n a, {NEIGHBOURS} d "
       "LEFT JOIN n b ON b.q = a.q + dq AND b.r = a.r + dr GROUP BY ALL")
def ring_sum(spark, sf):
    n = with_cell(points(spark, sf), 8).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return SP.ring_sum(n, n, "cell", "n", 1)


@query("weights", f"WITH {PTS}, {cell_sql('c', 'pts', 8, 'host_id')}, n AS (SELECT DISTINCT cell, q, r FROM c), "
       f"e AS (SELECT a.cell AS src, b.cell AS dst FROM n a, {NEIGHBOURS} d JOIN n b ON b.q = a.q + dq AND b.r = a.r + dr WHERE NOT (dq = 0 AND dr = 0)) "
       f"SELECT src, dst, {rd('1.0 / count(*) OVER (PARTITION BY src)')} AS w FROM e")
def weights(spark, sf):
    return rounded(SP.weights(with_cell(points(spark, sf), 8), "cell"))


@query("islands", f"WITH {PLS}, {cell_sql('c', 'pls', 8, 'station_id')}, n AS (SELECT DISTINCT cell, q, r FROM c) "
       f"SELECT cell FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE a.cell <> b.cell AND (abs(a.q - b.q) + abs(a.r - b.r) + abs(a.q - b.q + a.r - b.r)) = 2)")
def islands(spark, sf):
    return SP.islands(with_cell(places(spark, sf), 8), "cell")


@query("reallocate", f"WITH {PTS}, {PLS}, {cell_sql('a', 'pts', 8, 'host_id')}, {cell_sql('b', 'pls', 8, 'station_id')}, "
       f"w AS (SELECT DISTINCT cell, q, r, {center_sql(8)} FROM a), v AS (SELECT DISTINCT cell, q, r, {center_sql(8)} FROM b), "
       "j AS (SELECT w.cell, v.cell AS target, CAST((abs(w.q - v.q) + abs(w.r - v.r) + abs(w.q - v.q + w.r - v.r)) / 2 AS INTEGER) AS ring, "
       "round(sqrt((w.x - v.x) * (w.x - v.x) + (w.y - v.y) * (w.y - v.y)), 3) AS d FROM w JOIN v ON abs(w.q - v.q) <= 3 AND abs(w.r - v.r) <= 3), "
       "k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY ring, d, target) AS rn FROM j WHERE ring <= 3) "
       "SELECT w.cell, k.target, k.ring FROM w LEFT JOIN k ON k.cell = w.cell AND rn = 1")
def reallocate(spark, sf):
    return SP.reallocate(with_cell(points(spark, sf), 8), with_cell(places(spark, sf), 8), "cell", H.side_of(8))


DIST = "sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y))"


@query("nearest_distance", f"WITH {PTS}, {PLS} SELECT host_id, {rd('min(' + DIST + ')', 4)} AS distance FROM pts p, pls t GROUP BY host_id")
def nearest_distance(spark, sf):
    found = SP.nearest_distance(points(spark, sf), places(spark, sf), "host_id", "station_id")
    return rounded(found.select("host_id", "distance"), 4)


@query("comparables", f"""WITH {PTS}, p AS (SELECT * FROM pts), j AS (
  SELECT p.host_id, t.host_id AS comparable, {DIST} AS distance FROM pts p JOIN pts t ON p.segment = t.segment AND {DIST} <= {RADIUS}),
k AS (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY distance, comparable) AS rank FROM j)
SELECT host_id, CAST(rank AS INTEGER) AS rank, comparable, {rd('distance', 4)} AS distance FROM k WHERE rank <= 5""")
def comparables(spark, sf):
    """The five nearest of the same segment within 3 km, for every host."""
    p = points(spark, sf)
    found = SP.nearest_k(p, p.withColumnRenamed("host_id", "comparable"), "host_id", "comparable", 5, RADIUS, ["segment"])
    return rounded(found, 4)


@query("within_radius", f"""WITH {PTS}, {PLS}, t AS (SELECT station_id, x, y, area_id || ' L' || (area_id % 7) AS lines FROM pls),
j AS (SELECT p.host_id, t.station_id, unnest(str_split(t.lines, ' ')) AS line FROM pts p JOIN t ON {DIST} <= {RADIUS})
SELECT pts.host_id, count(DISTINCT station_id) AS complexes, count(DISTINCT line) AS lines FROM pts LEFT JOIN j USING (host_id) GROUP BY pts.host_id""")
def within_radius(spark, sf):
    served = places(spark, sf).withColumn("lines", F.concat_ws(" L", "area_id", F.col("area_id") % 7))
    return SP.within_radius(points(spark, sf), served, "host_id", RADIUS, "station_id", "lines")


TRI = f"""tri AS (SELECT station_id AS area_name, area_id, x AS x1, y AS y1,
  ((lon + CAST(0.04 AS DOUBLE)) - CAST({H.ORIGIN_LON} AS DOUBLE)) * CAST({H.METRES_PER_DEGREE_LON!r} AS DOUBLE) AS x2,
  ((lat + CAST(0 AS DOUBLE)) - CAST({H.ORIGIN_LAT} AS DOUBLE)) * CAST({H.METRES_PER_DEGREE_LAT!r} AS DOUBLE) AS y2,
  x AS x3, ((lat + CAST(0.03 AS DOUBLE)) - CAST({H.ORIGIN_LAT} AS DOUBLE)) * CAST({H.METRES_PER_DEGREE_LAT!r} AS DOUBLE) AS y3 FROM pls)"""
# a horizontal base, a slanted side and a vertical one
INSIDE = "p.x >= t.x1 AND p.y >= t.y1 AND p.y < t.y3 AND p.x < t.x2 + (p.y - t.y2) * (t.x3 - t.x2) / (t.y3 - t.y2)"


@query("point_in_polygon", f"""WITH {PTS}, {PLS}, {TRI}
SELECT host_id, min(t.area_name) AS area_name, count(t.area_name) AS matches FROM pts p LEFT JOIN tri t ON {INSIDE} GROUP BY host_id""")
def point_in_polygon(spark, sf):
    return SP.point_in_polygon(points(spark, sf), triangles(spark, sf), "host_id", ["area_name"]).select(
        "host_id", "area_name", "matches")


def seg_sql(ax: str, ay: str, bx: str, by: str) -> str:
    t = (f"greatest(0, least(1, ((p.x - {ax}) * ({bx} - {ax}) + (p.y - {ay}) * ({by} - {ay})) / "
         f"(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))))")
    return f"sqrt(power(p.x - ({ax} + {t} * ({bx} - {ax})), 2) + power(p.y - ({ay} + {t} * ({by} - {ay})), 2))"


BORDER = ("least(" + ", ".join(seg_sql(f"t.x{a}", f"t.y{a}", f"t.x{b}", f"t.y{b}") for a, b in ((1, 2), (2, 3), (3, 1))) + ")")


@query("nearest_polygon", f"""WITH {PTS}, {PLS}, {TRI}, i AS (
  SELECT host_id, min(t.area_name) AS area_name, count(t.area_name) AS matches FROM pts p LEFT JOIN tri t ON {INSIDE} GROUP BY host_id),
n AS (SELECT host_id, min({BORDER}) AS distance FROM pts p, tri t GROUP BY host_id)
SELECT host_id, CASE WHEN matches > 0 THEN 'contem' ELSE 'proximo' END AS how, matches,
  {rd('CASE WHEN matches > 0 THEN 0 ELSE distance END', 3)} AS distance FROM i JOIN n USING (host_id)""")
def nearest_polygon(spark, sf):
    found = SP.nearest_polygon(points(spark, sf), triangles(spark, sf), "host_id", ["area_name"])
    return rounded(found.select("host_id", "how", "matches", "distance"), 3)


CHECKED = f"""{PTS}, {PLS}, {TRI}, dec AS (SELECT area_id, min(area_name) AS declared FROM tri GROUP BY area_id),
i AS (SELECT p.host_id, any_value(p.x) AS x, any_value(p.y) AS y, any_value(d.declared) AS declared, min(t.area_name) AS found
  FROM pts p JOIN dec d USING (area_id) LEFT JOIN tri t ON {INSIDE} GROUP BY p.host_id),
chk AS (SELECT p.host_id, CASE WHEN found = declared THEN 'declared' WHEN found IS NULL THEN 'none' ELSE 'other' END AS place,
  CASE WHEN found = declared THEN {BORDER} END AS border_m,
  CASE WHEN found IS NULL OR found <> declared THEN CASE WHEN {INSIDE} THEN 0 ELSE {BORDER} END END AS declared_m
  FROM i p JOIN tri t ON t.area_name = declared)"""


def checked(spark, sf):
    t = triangles(spark, sf)
    declared = t.groupBy("area_id").agg(F.min("area_name").alias("declared"))
    return SP.declared_area_check(points(spark, sf).join(declared, "area_id"), t, "host_id", "declared", "area_name")


@query("declared_area_check", f"WITH {CHECKED} SELECT host_id, place, {rd('border_m', 3)} AS border_m, {rd('declared_m', 3)} AS declared_m FROM chk")
def declared_area_check(spark, sf):
    return rounded(checked(spark, sf).select("host_id", "place", "border_m", "declared_m"), 3)


@query("declared_area_report", f"""WITH {CHECKED} SELECT count(*) AS n, count(*) FILTER (WHERE place = 'declared') AS n_declared,
  count(*) FILTER (WHERE place = 'other') AS n_other, count(*) FILTER (WHERE place = 'none') AS n_none,
  count(*) FILTER (WHERE declared_m <= 150) AS near_declared, count(*) FILTER (WHERE border_m <= 150) AS near_border,
  count(declared_m) AS declared_m_n, {rd('median(declared_m)', 3)} AS declared_m_median, {rd('quantile_cont(declared_m, 0.9)', 3)} AS declared_m_p90,
  count(border_m) AS border_m_n, {rd('median(border_m)', 3)} AS border_m_median, {rd('quantile_cont(border_m, 0.9)', 3)} AS border_m_p90 FROM chk""")
def declared_area_report(spark, sf):
    return rounded(SP.declared_area_report(checked(spark, sf)), 3)


def hav_sql(lat: str, lon: str, a: float, b: float) -> str:
    h = (f"power(sin((radians(CAST({a} AS DOUBLE)) - radians({lat})) / 2), 2) + cos(radians({lat})) * cos(radians(CAST({a} AS DOUBLE))) "
         f"* power(sin(radians(CAST({b} AS DOUBLE) - {lon}) / 2), 2)")
    return f"CAST({2 * H.EARTH_RADIUS_M!r} AS DOUBLE) * asin(sqrt(least({h}, 1)))"


@query("landmark_distances", f"""WITH {HOSTS} SELECT host_id, {rd(hav_sql('lat', 'lon', *LANDMARKS[0]) + ' / 1000')} AS centre_km,
  {rd('least(' + ', '.join(hav_sql('lat', 'lon', *p) for p in LANDMARKS) + ') / 1000')} AS closest_km FROM hosts""")
def landmark_distances(spark, sf):
    return rounded(hosts(spark, sf).select("host_id", H.landmark_distance_km("lat", "lon", LANDMARKS[:1]).alias("centre_km"),
                                           H.landmark_distance_km("lat", "lon", LANDMARKS).alias("closest_km")))


@query("cover")
def cover(spark, sf):
    return SP.cover(triangles(spark, sf), "area_name", 8)


@query("land_fraction")
def land_fraction(spark, sf):
    t = triangles(spark, sf)
    return rounded(SP.land_fraction(SP.cover(t, "area_name", 8), t, "area_name", 8))

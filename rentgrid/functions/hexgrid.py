"""A hexagonal grid in plain column arithmetic, on projected coordinates in metres.

A cell id packs resolution, q and r of the axial coordinates into one long, so a
neighbour is the id plus a constant and joins compare longs. Hexagons stand on a
corner; ``side`` is the edge length, which is also the circumradius.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentgrid.functions.constants import EARTH_RADIUS_M
from rentgrid.functions.scalars import ColumnLike, col

# --- fixed values: cell areas in square metres per resolution ----------------
CELL_AREAS = {9: 105_000.0, 8: 740_000.0, 6: 36_000_000.0}

ROOT3 = math.sqrt(3.0)
OFFSET = 1 << 27
Q_UNIT = 1 << 28
RES_UNIT = 1 << 56


def side_of(res: int) -> float:
    return math.sqrt(2 * CELL_AREAS[res] / (3 * ROOT3))


# --- projection -----------------------------------------------------------------

# --- fixed values: WGS84 and the transverse Mercator zone 18 north -----------
SEMI_MAJOR, FLATTENING = 6_378_137.0, 1 / 298.257223563
SCALE, FALSE_EAST, CENTRAL_LON = 0.9996, 500_000.0, -75.0
# --- fixed values: origin of the local equirectangular plane -----------------
ORIGIN_LAT, ORIGIN_LON = 40.7, -74.0

_N = FLATTENING / (2 - FLATTENING)
_A = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_utm(lon: ColumnLike, lat: ColumnLike) -> tuple[Column, Column]:
    """Easting and northing of zone 18 north (Krueger series, third order)."""
    phi, lam = F.radians(col(lat)), F.radians(col(lon) - CENTRAL_LON)
    c = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EAST + SCALE * _A * east, SCALE * _A * north


def from_utm(x: ColumnLike, y: ColumnLike) -> tuple[Column, Column]:
    """Longitude and latitude of a zone 18 north point."""
    xi, eta = col(y) / (SCALE * _A), (col(x) - FALSE_EAST) / (SCALE * _A)
    a, b = xi, eta
    for j, v in enumerate(_BETA, 1):
        a = a - v * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - v * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for j, v in enumerate(_DELTA, 1):
        lat = lat + v * F.sin(2 * j * chi)
    return CENTRAL_LON + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(lat)


METRES_PER_DEGREE_LAT = EARTH_RADIUS_M * math.pi / 180
METRES_PER_DEGREE_LON = METRES_PER_DEGREE_LAT * math.cos(math.radians(ORIGIN_LAT))


def to_plane(lon: ColumnLike, lat: ColumnLike) -> tuple[Column, Column]:
    """Local equirectangular metres; two multiplications, the same in any SQL engine."""
    return ((col(lon) - F.lit(ORIGIN_LON)) * F.lit(METRES_PER_DEGREE_LON),
            (col(lat) - F.lit(ORIGIN_LAT)) * F.lit(METRES_PER_DEGREE_LAT))


def from_plane(x: ColumnLike, y: ColumnLike) -> tuple[Column, Column]:
    return (col(x) / F.lit(METRES_PER_DEGREE_LON) + F.lit(ORIGIN_LON),
            col(y) / F.lit(METRES_PER_DEGREE_LAT) + F.lit(ORIGIN_LAT))


PROJECTIONS = {"utm": (to_utm, from_utm), "plane": (to_plane, from_plane)}


def distance(x1: ColumnLike, y1: ColumnLike, x2: ColumnLike, y2: ColumnLike) -> Column:
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return F.sqrt(dx * dx + dy * dy)


def haversine(lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike) -> Column:
    """Great-circle metres on a sphere."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    h = (F.pow(F.sin((b - a) / 2), 2)
         + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def landmark_distance_km(lat: ColumnLike, lon: ColumnLike, places: list[tuple[float, float]]) -> Column:
    """Kilometres to the closest of a fixed set of places."""
    d = [haversine(lat, lon, F.lit(float(a)), F.lit(float(b))) / 1000 for a, b in places]
    return F.least(*d) if len(d) > 1 else d[0]


# --- cells --------------------------------------------------------------------------

def pack(res: int, q: Column, r: Column) -> Column:
    return (F.lit(res * RES_UNIT).cast("long") + (q + OFFSET).cast("long") * F.lit(Q_UNIT).cast("long")
            + (r + OFFSET).cast("long"))


def cell_at(x: ColumnLike, y: ColumnLike, side: float, tag: int) -> Column:
    """Cell of a point for any edge length; ``tag`` takes the place of the resolution."""
    u, v = col(x) * F.lit(1 / (side * ROOT3)), col(y) * F.lit(1 / side)
    # three families of parallel lines cut the plane into triangles; six make a hexagon
    t = F.floor(u - v + 1)
    q = F.floor((F.floor(2 * u + 1) + t) / 3)
    r = -F.floor((t + F.floor(1 - u - v)) / 3)
    return pack(tag, q, r)


def cell(x: ColumnLike, y: ColumnLike, res: int) -> Column:
    return cell_at(x, y, side_of(res), res)


def cell_of(lat: ColumnLike, lon: ColumnLike, res: int, projection: str = "utm") -> Column:
    x, y = PROJECTIONS[projection][0](lon, lat)
    return cell(x, y, res)


def axial(c: ColumnLike) -> tuple[Column, Column]:
    rest = col(c).bitwiseAND(F.lit(RES_UNIT - 1))
    return F.shiftright(rest, 28) - OFFSET, rest.bitwiseAND(F.lit(Q_UNIT - 1)) - OFFSET


def resolution(c: ColumnLike) -> Column:
    return F.shiftright(col(c), 56)


def center_at(c: ColumnLike, side: float) -> tuple[Column, Column]:
    q, r = axial(c)
    return (q + r / 2) * (side * ROOT3), r * (1.5 * side)


def cell_center(c: ColumnLike, res: int) -> tuple[Column, Column]:
    return center_at(c, side_of(res))


def corners(x: Column, y: Column, side: float) -> Column:
    """The six corners of the hexagon around a centre, as ``array<struct<x,y>>``."""
    return F.array(*[F.struct((x + side * math.cos(math.radians(60 * i - 30))).alias("x"),
                              (y + side * math.sin(math.radians(60 * i - 30))).alias("y")) for i in range(6)])


def cell_boundary(c: ColumnLike, res: int) -> Column:
    return corners(*cell_center(c, res), side_of(res))


def cell_area(res: int) -> Column:
    return F.lit(CELL_AREAS[res])


def parent(c: ColumnLike, res: int, coarser: int) -> Column:
    """Cell of the centre at a coarser resolution."""
    return cell(*cell_center(c, res), coarser)


def offsets(k: int) -> list[tuple[int, int, int]]:
    """``(dq, dr, ring)`` of the 1 + 3k(k+1) cells within k steps."""
    out = []
    for dq in range(-k, k + 1):
        for dr in range(-k, k + 1):
            ring = (abs(dq) + abs(dr) + abs(dq + dr)) // 2
            if ring <= k:
                out.append((dq, dr, ring))
    return sorted(out, key=lambda t: (t[2], t[0], t[1]))


def disk(c: ColumnLike, k: int) -> Column:
    """Array of the cells within k steps, the cell itself included."""
    return F.array(*[col(c) + F.lit(dq * Q_UNIT + dr).cast("long") for dq, dr, _ in offsets(k)])


def ring(c: ColumnLike, k: int) -> Column:
    return F.array(*[col(c) + F.lit(dq * Q_UNIT + dr).cast("long") for dq, dr, n in offsets(k) if n == k])


def disk_with_ring(c: ColumnLike, k: int) -> Column:
    """Like ``disk``, as ``array<struct<cell, ring>>``."""
    return F.array(*[F.struct((col(c) + F.lit(dq * Q_UNIT + dr).cast("long")).alias("cell"),
                              F.lit(n).alias("ring")) for dq, dr, n in offsets(k)])


def grid_distance(a: ColumnLike, b: ColumnLike) -> Column:
    (q1, r1), (q2, r2) = axial(a), axial(b)
    dq, dr = q1 - q2, r1 - r2
    return ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2).cast("long")

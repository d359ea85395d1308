"""The cell table: sources joined by area key or distance, densities, coverage, roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentgrid.functions import hexgrid as H
from rentgrid.operators.panel import share
from rentgrid.operators.ranks import medians, medians_by_dimension
from rentgrid.operators.spatial import cover, land_fraction, nearest_polygon
from rentgrid.session import cut_lineage, shared_table


def lookup(df: DataFrame, dim: DataFrame, key: str, columns: Sequence[str], dim_key: str | None = None) -> DataFrame:
    """Left join of one dimension; a missing key gives NULLs."""
    right = dim.select(F.col(dim_key or key).alias(key), *columns)
    return df.join(right, key, "left")


def lookup_or(df: DataFrame, dim: DataFrame, key: str, column: str, fallback: str, name: str) -> DataFrame:
    """One looked-up column, with a column of ``df`` where it is missing."""
    right = dim.select(key, F.col(column).alias("_found"))
    return df.join(right, key, "left").withColumn(name, F.coalesce("_found", fallback)).drop("_found")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """``df`` itself, or an error naming the first repeated keys."""
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(3).collect()
    if repeated:
        raise ValueError(f"{key} repeats: {[r[0] for r in repeated]}")
    return df


def with_cell_features(df: DataFrame, cells: DataFrame, cell: str) -> DataFrame:
    """Left join of the cell table, which must have one row per cell."""
    new = [c for c in cells.columns if c == cell or c not in df.columns]
    return df.join(require_unique(cells, cell).select(*new), cell, "left")


def to_parent_area(df: DataFrame, areas: DataFrame, key: str, members: str, area: str) -> DataFrame:
    """Area of each member key through the areas' member lists; unmatched rows keep NULL."""
    listed = areas.select(F.col(area), F.explode(members).alias(key)).groupBy(key).agg(F.min(area).alias(area))
    return df.join(listed, key, "left")


def own_or_members(areas: DataFrame, values: DataFrame, area: str, members: str, key: str, value: str) -> DataFrame:
    """Value of the area's own key, else the mean of its members', and which it was."""
    own = values.select(F.col(key).alias(area), F.col(value).alias("_own"))
    pairs = areas.select(area, F.explode(members).alias(key)).join(values.select(key, value), key)
    means = pairs.groupBy(area).agg(F.avg(value).alias("_mean"))
    joined = areas.select(area).join(own, area, "left").join(means, area, "left")
    return joined.select(area, F.coalesce("_own", "_mean").alias(value),
                         F.when(F.col("_own").isNotNull(), "proprio")
                         .when(F.col("_mean").isNotNull(), "membros").otherwise("ausente").alias("origin"))


def densities(counts: DataFrame, areas: DataFrame, area: str, vintage: str, count: str, km2: str,
              classes: Mapping[str, Column]) -> DataFrame:
    """Events per square kilometre by area and vintage; merged codes bring their areas together."""
    size = areas.groupBy(area).agg(F.sum(km2).alias("_km2"))
    sums = counts.where(F.col(area).isNotNull()).groupBy(area, vintage).agg(
        *[F.sum(F.when(c, F.col(count)).otherwise(0)).alias(f"_{n}") for n, c in classes.items()])
    return sums.join(size, area).select(
        area, vintage, *[F.try_divide(F.col(f"_{n}"), F.col("_km2")).alias(n) for n in classes])


def count_window(events: DataFrame, date: str, start: str, end: str, keys: Sequence[str],
                 prefix: tuple[str, str] | None = None) -> DataFrame:
    """Events per key in the closed date window; optional prefix filter on a type column."""
    day = F.col(date)
    rows = events.where((day >= F.lit(start).cast("timestamp"))
                        & (day < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")))
    if prefix:
        rows = rows.where(F.col(prefix[0]).startswith(prefix[1]))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def tract_features(survey: DataFrame, tracts: DataFrame, key: str, population: str, km2: str, rented: str,
                   occupied: str, vacant: str, units: str) -> DataFrame:
    """Density, rented share and vacant share; a zero denominator gives NULL."""
    return tracts.select(key, km2).join(survey, key, "left").select(
        key, F.try_divide(F.col(population), F.col(km2)).alias("density"),
        F.try_divide(F.col(rented), F.col(occupied)).alias("rented_share"),
        F.try_divide(F.col(vacant), F.col(units)).alias("vacant_share"))


def poi_features(cells: DataFrame, pois: DataFrame, cell: str, group: str, groups: Sequence[str], k: int = 1) -> DataFrame:
    """Points of interest per group in each cell and its ring; all groups in one pass."""
    counts = pois.groupBy(cell).agg(*[F.count_if(F.col(group) == g).alias(f"_{g}") for g in groups])
    around = cells.select(cell, F.explode(H.disk(cell, k)).alias("_near"))
    sums = around.join(counts.withColumnRenamed(cell, "_near"), "_near").groupBy(cell).agg(
        *[F.sum(f"_{g}").alias(f"poi_{g}") for g in groups])
    return cells.join(sums, cell, "left").fillna(0, [f"poi_{g}" for g in groups])


def coverage(cells: DataFrame, listings: DataFrame, cell: str, features: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per source group and feature: share of cells, and of listings in them, with a value."""
    names = [f for fs in features.values() for f in fs]
    group = {f: g for g, fs in features.items() for f in fs}
    per_cell = listings.where(F.col(cell).isNotNull()).groupBy(cell).agg(F.count(F.lit(1)).alias("_n"))
    joined = cells.join(per_cell, cell, "left")
    n = F.coalesce("_n", F.lit(0))
    stats = joined.agg(F.count(F.lit(1)).alias("cells"), F.sum(n).alias("listings"), *[e for i, f in enumerate(names) for e in (
        F.count(f).alias(f"c{i}"), F.sum(F.when(F.col(f).isNotNull(), n).otherwise(0)).alias(f"l{i}"))])
    rows = F.array(*[F.struct(
        F.lit(group[f]).alias("source"), F.lit(f).alias("feature"),
        F.try_divide(F.col(f"c{i}"), F.col("cells")).alias("cell_share"),
        F.try_divide(F.col(f"l{i}"), F.col("listings")).alias("listing_share")) for i, f in enumerate(names)])
    return stats.select(F.explode(rows).alias("r")).select("r.*")


def listing_coverage(cells: DataFrame, listings: DataFrame, cell: str) -> DataFrame:
    """How many listings lie in a cell of the table, and how many cells have listings."""
    known = cells.select(cell).distinct().withColumn("_in", F.lit(True))
    counted = listings.groupBy(cell).agg(F.count(F.lit(1)).alias("_n")).join(known, cell, "left")
    return counted.agg(F.sum("_n").alias("listings"),
                       F.coalesce(F.sum(F.when(F.col("_in"), F.col("_n"))), F.lit(0)).alias("listings_in_table"),
                       F.count_if("_in").alias("cells_with_listings"))


def mode_by(df: DataFrame, key: str, column: str) -> DataFrame:
    """Most frequent value per key, the smallest among equals.

    Counted first by (key, value), so the map of one key never grows with its rows.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v"))).alias("b")).select(
        key, F.col("b.v").alias(column))


def roll_up(df: DataFrame, parent: str, features: Sequence[str]) -> DataFrame:
    """Means of the fine cells per coarser cell."""
    return df.where(F.col(parent).isNotNull()).groupBy(parent).agg(*[F.avg(f).alias(f) for f in features])


def rent_ratio(df: DataFrame, cells: DataFrame, cell: str, revenue: str, rent: str, min_n: int = 5) -> DataFrame:
    """Percent by which the median yearly revenue exceeds a year of the cell's mean rent."""
    rows = df.where(F.col(revenue).isNotNull() & F.col(cell).isNotNull())
    sizes = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n)
    middle = medians(rows, [cell], {"revenue": F.col(revenue)})
    rents = cells.groupBy(cell).agg(F.avg(rent).alias("rent"))
    return sizes.join(middle, cell).join(rents, cell).select(
        cell, "n", (100 * (F.try_divide(F.col("revenue"), 12 * F.col("rent")) - 1)).alias("over_rent_pct"))


def station_complexes(df: DataFrame, key: str, name: str, order: str, x: str, y: str, lines: str) -> DataFrame:
    """One row per complex: first name, mean place, sorted distinct lines."""
    base = df.groupBy(key).agg(F.min_by(name, order).alias(name), F.avg(x).alias(x), F.avg(y).alias(y))
    # distinct before collecting: the list is as long as the lines of a complex
    served = df.select(key, F.explode(F.split(lines, " ")).alias("l")).where("l <> ''").distinct()
    return base.join(served.groupBy(key).agg(F.concat_ws(" ", F.array_sort(F.collect_list("l"))).alias(lines)), key, "left")


def active_cells(df: DataFrame, cell: str, active: Column, metrics: Mapping[str, Column], min_n: int = 5) -> DataFrame:
    """Medians over active listings per cell, NULL below ``min_n`` of them."""
    rows = df.where(active & F.col(cell).isNotNull())
    sizes = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
    joined = sizes.join(medians(rows, [cell], metrics), cell, "left")
    return joined.select(cell, "n", *[F.when(F.col("n") >= min_n, F.col(m)).alias(m) for m in metrics])


def activity_share(df: DataFrame, active: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share(active).alias("active_share"))


def extreme_groups(df: DataFrame, key: str, value: str, n: int = 10, min_n: int = 30) -> DataFrame:
    """The ``n`` groups with the largest and the ``n`` with the smallest mean."""
    means = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    enough = means.where(F.col("n") >= min_n)
    top = enough.orderBy(F.desc("mean"), key).limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(enough.orderBy("mean", key).limit(n).withColumn("side", F.lit("bottom")))


def rent_block(df: DataFrame, price: str, nights: str, revenue: str, rent: str,
               dims: Mapping[str, tuple[str | None, int]], id_columns: Sequence[str] = ()) -> DataFrame:
    """Long-term rent against short-term revenue: overall and per dimension.

    ``dims`` maps a label to (column or None for all rows, smallest group). The rows
    are written once and read for the sizes and the medians of all dimensions, never repeated per dimension.
    """
    labels = {d: F.col(c).cast("string") if c else F.lit("all") for d, (c, _) in dims.items()}
    needed = list(dict.fromkeys([price, nights, revenue, rent, *[c for c, _ in dims.values() if c]]))
    rows = shared_table(df.where(F.col(rent).isNotNull()).select(*needed), "rent-rows")
    year = 12 * F.col(rent)
    ratio = F.try_divide(F.col(revenue), year)
    names = [f"_d{i}" for i in range(len(dims))]
    counted = rows.groupBy(*[c.alias(n) for n, c in zip(names, labels.values())]).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ratio > 1).alias("_above"), F.count(ratio).alias("_known"))
    tall = counted.select("n", "_above", "_known", F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(n).alias("label"), F.lit(m).alias("min_n"))
        for n, (d, (_, m)) in zip(names, dims.items())]))).where("label IS NOT NULL")
    size = tall.groupBy("dimension", "label").agg(
        F.sum("n").alias("n"), F.max("min_n").alias("min_n"), F.try_divide(F.sum("_above"), F.sum("_known")).alias("share_above"))
    middle = medians_by_dimension(rows, labels, {
        "rent_month": F.col(rent), "rent_year": year, "revenue": F.col(revenue), "price": F.col(price), "nights": F.col(nights),
        "break_even_nights": F.try_divide(year, F.col(price)), "ratio": ratio})
    return size.where(F.col("n") >= F.col("min_n")).drop("min_n").join(middle, ["dimension", "label"], "left")


def overprice(df: DataFrame, y: str, prediction: str, nights: str, stratum: str, bands) -> DataFrame:
    """Nights by band of price above prediction, per stratum."""
    from rentgrid.functions.scalars import bucket
    edges, labels = bands
    above = 100 * (F.exp(F.col(y) - F.col(prediction)) - 1)
    rows = df.where(F.col(prediction).isNotNull()).select(
        stratum, F.col(nights).cast("double").alias("nights"), bucket(above, edges, labels).alias("band"))
    size = rows.groupBy(stratum, "band").agg(F.count(F.lit(1)).alias("n"), F.avg("nights").alias("mean_nights"))
    return size.join(medians(rows, [stratum, "band"], {"median_nights": F.col("nights")}), [stratum, "band"], "left")


# --- assembly -------------------------------------------------------------------------

def cell_base(polygons: DataFrame, key: str, columns: Sequence[str], res: int = 9,
              coarser: Sequence[int] = (8, 6), projection: str = "plane") -> DataFrame:
    """Cells covering the polygons: parents, centre, size, land share and the area each belongs to."""
    covered = cut_lineage(cover(polygons, key, res))
    land = land_fraction(covered, polygons, key, res)
    x, y = H.cell_center("cell", res)
    lon, lat = H.PROJECTIONS[projection][1](x, y)
    base = land.select("cell", "land", x.alias("x"), y.alias("y"), lat.alias("lat"), lon.alias("lon"),
                       F.lit(H.CELL_AREAS[res] / 1e6).alias("area_km2"),
                       *[H.parent("cell", res, c).alias(f"cell_r{c}") for c in coarser])
    return nearest_polygon(base, polygons, "cell", columns)


def build_cells(base: DataFrame, cell: str, sources: Sequence[tuple[DataFrame | None, Mapping[str, str]]]) -> DataFrame:
    """Left join of every source; a source that is absent gives its declared columns as NULL.

    Each source is ``(table keyed by cell, or None; column -> type)``. The column
    order is the order of the declaration, and cells stay unique.
    """
    def add(left: DataFrame, source: tuple[DataFrame | None, Mapping[str, str]]) -> DataFrame:
        table, columns = source
        if table is None:
            return left.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()})
        picked = require_unique(table, cell).select(cell, *[F.col(c).cast(t).alias(c) for c, t in columns.items()])
        return left.join(picked, cell, "left")
    out = reduce(add, sources, require_unique(base, cell))
    return out.select(*base.columns, *[c for _, columns in sources for c in columns])



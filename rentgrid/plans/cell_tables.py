"""Spatial statistics and the cell table over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentgrid.functions import constants as K
from rentgrid.functions import scalars as S
from rentgrid.operators import cells as C, panel, spatial_stats as ST
from rentgrid.plans.places import NEIGHBOURS, PLS, PTS, cell_sql, places, points, triangles, with_cell
from rentgrid.plans.registry import query, read, rounded
from rentgrid.plans.tables import LST, ORD, listings, orders, rd


def placed_orders(spark, sf):
    """Orders with the r8 cell of their customer."""
    p = with_cell(points(spark, sf), 8).select("host_id", "cell", "area_id", "balance", "segment")
    return orders(spark, sf).join(p, "host_id")


PO = f"{ORD}, {PTS}, {cell_sql('pc', 'pts', 8, 'host_id, area_id, balance, segment')}, po AS (SELECT ord.*, pc.cell, pc.q, pc.r, pc.area_id, pc.balance, pc.segment FROM ord JOIN pc USING (host_id))"


def values(spark, sf):
    return panel.cell_stat(placed_orders(spark, sf), "cell", "lp", "median", 5)


VALUES = f"{PO}, val AS (SELECT cell, q, r, count(*) AS n, median(lp) AS lp FROM po GROUP BY ALL HAVING count(*) >= 5)"
LAGS = f"""{VALUES}, e AS (SELECT a.cell AS src, b.cell AS dst, 1.0 / count(*) OVER (PARTITION BY a.cell) AS w FROM val a, {NEIGHBOURS} d
  JOIN val b ON b.q = a.q + dq AND b.r = a.r + dr WHERE NOT (dq = 0 AND dr = 0)),
z0 AS (SELECT cell, lp FROM val WHERE cell IN (SELECT src FROM e)), z AS (SELECT cell, lp - (SELECT avg(lp) FROM z0) AS z FROM z0),
lg AS (SELECT z.cell, any_value(z.z) AS z, sum(w * zn.z) AS lag FROM z JOIN e ON src = z.cell JOIN z zn ON zn.cell = dst GROUP BY z.cell)"""


@query("cell_stat", f"WITH {VALUES} SELECT cell, n, {rd('lp')} AS lp FROM val")
def cell_stat(spark, sf):
    return rounded(values(spark, sf))


@query("moran", f"""WITH {LAGS} SELECT count(*) AS n_cells, (SELECT count(*) FROM val) - count(*) AS islands, {rd('sum(z * lag) / sum(z * z)')} AS I,
  {rd('-1.0 / (count(*) - 1)')} AS expected FROM lg""")
def moran(spark, sf):
    return rounded(ST.moran(values(spark, sf), "cell", "lp"))


@query("local_moran", f"""WITH {LAGS} SELECT cell, {rd('(SELECT count(*) - 1 FROM lg) * z * lag / (SELECT sum(z * z) FROM lg)')} AS I_local,
  CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN lag > 0 THEN 2 WHEN NOT z > 0 THEN 3 ELSE 4 END AS quadrant FROM lg""")
def local_moran(spark, sf):
    return rounded(ST.local_moran(values(spark, sf), "cell", "lp").select("cell", "I_local", "quadrant"))


@query("moran_test")
def moran_test(spark, sf):
    return rounded(ST.moran_test(values(spark, sf), "cell", "lp"))


@query("lisa")
def lisa(spark, sf):
    return rounded(ST.lisa(values(spark, sf), "cell", "lp"))


@query("compare_cells", f"""WITH {PO}, g AS (SELECT cell, count(*) FILTER (WHERE snapshot = 'A') AS n_a, count(*) FILTER (WHERE snapshot = 'B') AS n_b,
  count(*) FILTER (WHERE snapshot = 'A' AND price >= 10000) AS pa, count(*) FILTER (WHERE snapshot = 'B' AND price >= 10000) AS pb,
  avg(CASE WHEN long_stay THEN 1.0 ELSE 0.0 END) FILTER (WHERE snapshot = 'A') AS la, avg(CASE WHEN long_stay THEN 1.0 ELSE 0.0 END) FILTER (WHERE snapshot = 'B') AS lb,
  median(price) FILTER (WHERE snapshot = 'A' AND price >= 10000) AS ma, median(price) FILTER (WHERE snapshot = 'B' AND price >= 10000) AS mb FROM po GROUP BY cell),
s AS (SELECT cell, n_a, n_b, CASE WHEN n_a >= 5 THEN 100 * (n_b / n_a - 1) END AS cp, CASE WHEN pa >= 5 THEN ma END AS price_a, CASE WHEN pb >= 5 THEN mb END AS price_b,
  CASE WHEN n_a >= 5 THEN la END AS la, CASE WHEN n_b >= 5 THEN lb END AS lb FROM g)
SELECT cell, n_a, n_b, {rd('cp')} AS change_pct, {rd('price_a')} AS price_a, {rd('price_b')} AS price_b, {rd('la')} AS long_a, {rd('lb')} AS long_b,
  {rd('100 * (price_b / price_a - 1)')} AS price_change_pct FROM s""")
def compare_cells(spark, sf):
    return rounded(panel.compare_cells(placed_orders(spark, sf), "cell", "snapshot", ("A", "B"), "price",
                                       F.col("price") >= 10000, {"long": F.col("long_stay")}))


@query("active_cells", f"""WITH {PO}, g AS (SELECT cell, count(*) AS n, median(price) AS price, median(lp) AS lp FROM po WHERE room_type <> 'P' GROUP BY cell)
SELECT cell, n, {rd('CASE WHEN n >= 5 THEN price END')} AS price, {rd('CASE WHEN n >= 5 THEN lp END')} AS lp FROM g""")
def active_cells(spark, sf):
    return rounded(C.active_cells(placed_orders(spark, sf), "cell", F.col("room_type") != "P",
                                  {"price": F.col("price"), "lp": F.col("lp")}))


@query("activity_share", f"""WITH {ORD} SELECT long_stay, count(*) AS n, {rd("avg(CASE WHEN room_type <> 'P' THEN 1.0 ELSE 0.0 END)")} AS active_share FROM ord GROUP BY long_stay""")
def activity_share(spark, sf):
    return rounded(C.activity_share(orders(spark, sf), F.col("room_type") != "P", ["long_stay"]))


@query("mode_by", """WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS rn FROM n) SELECT c_nationkey, c_mktsegment FROM c WHERE rn = 1""")
def mode_by(spark, sf):
    return C.mode_by(read(spark, sf, "customer"), "c_nationkey", "c_mktsegment")


@query("roll_up", f"WITH {PTS}, {cell_sql('c', 'pts', 6, 'balance, lat')} SELECT cell, {rd('avg(balance)')} AS balance, {rd('avg(lat)')} AS lat FROM c GROUP BY cell")
def roll_up(spark, sf):
    return rounded(C.roll_up(with_cell(points(spark, sf), 6), "cell", ["balance", "lat"]))


@query("rent_ratio", f"""WITH {PO}, p AS (SELECT cell, count(*) AS n, median(price) AS revenue FROM po GROUP BY cell HAVING count(*) >= 5),
r AS (SELECT cell, avg(balance) AS rent FROM pc GROUP BY cell)
SELECT cell, n, {rd('100 * (revenue / nullif(12 * rent, 0) - 1)', 4)} AS over_rent_pct FROM p JOIN r USING (cell)""")
def rent_ratio(spark, sf):
    return rounded(C.rent_ratio(placed_orders(spark, sf), with_cell(points(spark, sf), 8), "cell", "price", "balance"), 4)


@query("station_complexes", f"""WITH s AS (SELECT s_nationkey AS complex, s_suppkey, s_name, s_acctbal, (s_suppkey % 5) || ' ' || (s_suppkey % 3) AS lines FROM supplier),
l AS (SELECT complex, string_agg(DISTINCT line, ' ' ORDER BY line) AS lines FROM (SELECT complex, unnest(str_split(lines, ' ')) AS line FROM s) GROUP BY complex)
SELECT complex, arg_min(s_name, s_suppkey) AS name, {rd('avg(s_acctbal)')} AS x, {rd('avg(s_suppkey)')} AS y, any_value(l.lines) AS lines FROM s JOIN l USING (complex) GROUP BY complex""")
def station_complexes(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("complex"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"),
                                           F.col("s_acctbal").alias("x"), F.col("s_suppkey").cast("double").alias("y"),
                                           F.concat_ws(" ", F.col("s_suppkey") % 5, F.col("s_suppkey") % 3).alias("lines"))
    return rounded(C.station_complexes(s, "complex", "name", "ord", "x", "y", "lines"))


@query("extreme_groups", f"""WITH {LST}, g AS (SELECT neighbourhood, avg(lp) AS m, count(lp) AS n FROM lst GROUP BY ALL HAVING count(lp) >= 30),
k AS (SELECT *, row_number() OVER (ORDER BY m DESC, neighbourhood) AS t, row_number() OVER (ORDER BY m, neighbourhood) AS b FROM g)
SELECT neighbourhood, {rd('m')} AS mean, n, 'top' AS side FROM k WHERE t <= 10 UNION ALL SELECT neighbourhood, {rd('m')}, n, 'bottom' FROM k WHERE b <= 10""")
def extreme_groups(spark, sf):
    return rounded(C.extreme_groups(listings(spark, sf), "neighbourhood", "lp"))


RB = {"all": (None, 0), "long_stay": ("long_stay", 0), "district": ("district", 30), "neighbourhood": ("neighbourhood", 60)}


@query("rent_block", f"""WITH {LST}, b AS (SELECT balance AS rent, 12 * balance AS year, price / 1000 AS price, price / 50 AS revenue, CAST(date_part('day', day) AS DOUBLE) AS nights,
  long_stay, district, neighbourhood FROM lst WHERE balance IS NOT NULL),
t AS (""" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {m} AS min_n, " + ("'all'" if c is None else f"CASE WHEN {c} THEN 'true' ELSE 'false' END" if c == "long_stay" else c)
                               + " AS label, * FROM b" for d, (c, m) in RB.items()) + f""")
SELECT dimension, label, count(*) AS n, {rd("avg(CASE WHEN revenue / nullif(year, 0) > 1 THEN 1.0 WHEN year = 0 THEN NULL ELSE 0.0 END)")} AS share_above,
  {rd('median(rent)', 4)} AS rent_month, {rd('median(year)', 4)} AS rent_year, {rd('median(revenue)', 4)} AS revenue, {rd('median(price)', 4)} AS price, {rd('median(nights)', 4)} AS nights,
  {rd('median(year / price)', 4)} AS break_even_nights, {rd('median(revenue / nullif(year, 0))', 4)} AS ratio FROM t GROUP BY dimension, label HAVING count(*) >= max(min_n)""")
def rent_block(spark, sf):
    b = listings(spark, sf).select((F.col("price") / 1000).alias("price"), (F.col("price") / 50).alias("revenue"), F.col("balance").alias("rent"),
                                   F.dayofmonth("day").cast("double").alias("nights"), "long_stay", "district", "neighbourhood")
    out = C.rent_block(b, "price", "nights", "revenue", "rent", RB)
    return out.select("dimension", "label", "n", (F.round("share_above", 6) + 0.0).alias("share_above"),
                      *[(F.round(c, 4) + 0.0).alias(c) for c in out.columns if c not in ("dimension", "label", "n", "share_above")])


@query("overprice", f"""WITH {ORD}, p AS (SELECT *, avg(lp) OVER (PARTITION BY stratum) AS pred FROM ord),
b AS (SELECT long_stay, CAST(date_part('day', day) AS DOUBLE) AS nights, 100 * (exp(lp - pred) - 1) AS a FROM p),
c AS (SELECT *, CASE WHEN a <= -20 THEN '≥ 20% abaixo' WHEN a <= -5 THEN '5–20% abaixo' WHEN a <= 5 THEN '±5%' WHEN a <= 20 THEN '5–20% acima' ELSE '≥ 20% acima' END AS band FROM b)
SELECT long_stay, band, count(*) AS n, {rd('avg(nights)')} AS mean_nights, {rd('median(nights)')} AS median_nights FROM c GROUP BY ALL""")
def overprice(spark, sf):
    o = panel.group_mean(orders(spark, sf), ["stratum"], "lp", "pred").withColumn("nights", F.dayofmonth("day"))
    return rounded(C.overprice(o, "lp", "pred", "nights", "long_stay", K.OVERPRICE_BANDS))


# --- sources by area -----------------------------------------------------------------

AREA_KM2 = "(s_acctbal + 1100) / 100"


@query("densities", f"""WITH c AS (SELECT CASE WHEN c_nationkey = 24 AND snap = 'A' THEN 5 ELSE c_nationkey END AS area, snap, segment, n FROM (
  SELECT c_nationkey, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'A' ELSE 'B' END AS snap, c_mktsegment AS segment, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)),
a AS (SELECT s_nationkey AS area, sum({AREA_KM2}) AS km2 FROM supplier GROUP BY s_nationkey)
SELECT area, snap, {rd("sum(CASE WHEN segment = 'MACHINERY' THEN n ELSE 0 END) / nullif(any_value(km2), 0)")} AS felony, {rd("sum(n) / nullif(any_value(km2), 0)")} AS "all" FROM c JOIN a USING (area) GROUP BY area, snap""")
def densities(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("host_id"), F.col("c_nationkey").cast("string").alias("code"), F.col("c_mktsegment").alias("segment"))
    counts = orders(spark, sf).join(c, "host_id").groupBy("code", F.col("snapshot").alias("snap"), "segment").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("area", S.code_in_vintage("code", "snap", {"A": {"24": "5"}}).cast("int"))
    size = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("area"), F.expr(AREA_KM2).alias("km2"))
    return rounded(C.densities(counts, size, "area", "snap", "n", "km2", {"felony": F.col("segment") == "MACHINERY", "all": F.lit(True)}))


@query("count_window", """SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-16 00:00:00'
  AND event_type LIKE 'c%' GROUP BY user_id""")
def count_window(spark, sf):
    return C.count_window(read(spark, sf, "events"), "ts", "2024-01-05", "2024-01-15", ["user_id"], ("event_type", "c"))


@query("tract_features", f"""WITH s AS (SELECT s_nationkey AS k, sum(s_acctbal) AS pop, sum(s_suppkey) AS rented, sum(s_suppkey % 2) AS occ, sum(s_suppkey % 3) AS vac, count(*) - 4 AS units FROM supplier GROUP BY 1)
SELECT n_nationkey AS k, {rd('pop / nullif(CAST(n_regionkey AS DOUBLE), 0)')} AS density, {rd('rented / nullif(occ, 0)')} AS rented_share, {rd('vac / nullif(units, 0)')} AS vacant_share FROM nation LEFT JOIN s ON k = n_nationkey""")
def tract_features(spark, sf):
    k = F.col("s_suppkey")
    survey = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(
        F.sum("s_acctbal").alias("pop"), F.sum(k).alias("rented"), F.sum(k % 2).alias("occ"), F.sum(k % 3).alias("vac"), (F.count(F.lit(1)) - 4).alias("units"))
    tracts = read(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("double").alias("km2"))
    return rounded(C.tract_features(survey, tracts, "k", "pop", "km2", "rented", "occ", "vac", "units"))


SEGMENTS = ["MACHINERY", "FURNITURE", "HOUSEHOLD"]


@query("poi_features", f"""WITH {PLS}, {PTS}, {cell_sql('a', 'pls', 8, 'station_id')}, {cell_sql('b', 'pts', 8, 'segment')}, n AS (SELECT DISTINCT cell, q, r FROM a),
j AS (SELECT n.cell, b.segment FROM n, {NEIGHBOURS} d JOIN b ON b.q = n.q + dq AND b.r = n.r + dr)
SELECT n.cell, {", ".join(f"count(*) FILTER (WHERE segment = '{s}') AS poi_{s}" for s in SEGMENTS)} FROM n LEFT JOIN j USING (cell) GROUP BY n.cell""")
def poi_features(spark, sf):
    base = with_cell(places(spark, sf), 8).select("cell").distinct()
    return C.poi_features(base, with_cell(points(spark, sf), 8), "cell", "segment", SEGMENTS)


@query("parent_area", """WITH m AS (SELECT n_regionkey AS area, unnest(list(n_nationkey)) AS zip FROM nation WHERE n_nationkey <> 3 GROUP BY n_regionkey)
SELECT area, count(*) AS n FROM customer LEFT JOIN m ON zip = c_nationkey GROUP BY area""")
def parent_area(spark, sf):
    a = read(spark, sf, "nation").where("n_nationkey <> 3").groupBy(F.col("n_regionkey").alias("area")).agg(F.collect_list("n_nationkey").alias("members"))
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("zip"))
    return C.to_parent_area(c, a, "zip", "members", "area").groupBy("area").agg(F.count(F.lit(1)).alias("n"))


@query("own_or_members", f"""WITH v AS (SELECT s_nationkey AS zip, avg(s_acctbal) AS rent FROM supplier GROUP BY 1 HAVING s_nationkey % 4 <> 0),
m AS (SELECT n_regionkey AS area, avg(rent) AS mean FROM nation JOIN v ON zip = n_nationkey GROUP BY 1)
SELECT r_regionkey AS area, {rd('coalesce(v.rent, m.mean)')} AS rent, CASE WHEN v.rent IS NOT NULL THEN 'proprio' WHEN m.mean IS NOT NULL THEN 'membros' ELSE 'ausente' END AS origin
FROM region LEFT JOIN v ON zip = r_regionkey LEFT JOIN m ON m.area = r_regionkey""")
def own_or_members(spark, sf):
    v = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("zip")).agg(F.avg("s_acctbal").alias("rent")).where("zip % 4 <> 0")
    a = read(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("area")).agg(F.collect_list("n_nationkey").alias("members"))
    return rounded(C.own_or_members(a, v, "area", "members", "zip", "rent"))


@query("lookup_or", f"""WITH d AS (SELECT l_orderkey AS id, sum(l_extendedprice) AS gross FROM lineitem WHERE l_linenumber >= 5 GROUP BY 1)
SELECT o_orderpriority, {rd('sum(coalesce(gross, o_totalprice))', 2)} AS total, count(*) FILTER (WHERE gross IS NULL) AS missing FROM orders LEFT JOIN d ON id = o_orderkey GROUP BY 1""")
def lookup_or(spark, sf):
    d = read(spark, sf, "lineitem").where("l_linenumber >= 5").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_extendedprice").alias("gross"))
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority", F.col("o_totalprice").alias("price"))
    both = C.lookup(C.lookup_or(o, d, "id", "gross", "price", "paid"), d, "id", ["gross"])
    return rounded(both.groupBy("o_orderpriority").agg(F.sum("paid").alias("total"), F.count_if(F.col("gross").isNull()).alias("missing")), 2)


def station_features(spark, sf):
    """Per r8 cell of the stations: how many, and their mean balance where it is positive."""
    return with_cell(places(spark, sf), 8).groupBy("cell").agg(
        F.count(F.lit(1)).alias("n_stations"), F.avg(F.when(F.col("balance") > 0, F.col("balance"))).alias("rent"))


FEATURES = f"{PLS}, {cell_sql('sc', 'pls', 8, 'balance')}, ft AS (SELECT cell, q, r, count(*) AS n_stations, avg(balance) FILTER (WHERE balance > 0) AS rent FROM sc GROUP BY ALL)"


@query("coverage", f"""WITH {FEATURES}, {PTS}, {cell_sql('pc', 'pts', 8, 'host_id')}, l AS (SELECT cell, count(*) AS n FROM pc GROUP BY cell), j AS (SELECT ft.*, coalesce(l.n, 0) AS n FROM ft LEFT JOIN l USING (cell))
SELECT 'transit' AS source, 'n_stations' AS feature, {rd('count(n_stations) / count(*)')} AS cell_share, {rd('sum(CASE WHEN n_stations IS NOT NULL THEN n ELSE 0 END) / nullif(sum(n), 0)')} AS listing_share FROM j
UNION ALL SELECT 'rent', 'rent', {rd('count(rent) / count(*)')}, {rd('sum(CASE WHEN rent IS NOT NULL THEN n ELSE 0 END) / nullif(sum(n), 0)')} FROM j""")
def coverage(spark, sf):
    return rounded(C.coverage(station_features(spark, sf), with_cell(points(spark, sf), 8), "cell", {"transit": ["n_stations"], "rent": ["rent"]}))


@query("listing_coverage", f"""WITH {FEATURES}, {PTS}, {cell_sql('pc', 'pts', 8, 'host_id')}
SELECT count(*) AS listings, count(*) FILTER (WHERE cell IN (SELECT cell FROM ft)) AS listings_in_table,
  count(DISTINCT CASE WHEN cell IN (SELECT cell FROM ft) THEN cell END) AS cells_with_listings FROM pc""")
def listing_coverage(spark, sf):
    return C.listing_coverage(station_features(spark, sf), with_cell(points(spark, sf), 8), "cell")


@query("cell_features_join", f"""WITH {FEATURES}, {PTS}, {cell_sql('pc', 'pts', 8, 'host_id')}
SELECT pc.host_id, pc.cell, ft.n_stations, {rd('ft.rent')} AS rent, CAST(NULL AS DOUBLE) AS zori FROM pc LEFT JOIN ft USING (cell)""")
def cell_features_join(spark, sf):
    table = C.build_cells(with_cell(points(spark, sf), 8).select("cell").distinct(), "cell",
                          [(station_features(spark, sf), {"n_stations": "bigint", "rent": "double"}), (None, {"zori": "double"})])
    hosts_ = with_cell(points(spark, sf), 8).select("host_id", "cell")
    return rounded(C.with_cell_features(hosts_, table, "cell").select("host_id", "cell", "n_stations", "rent", "zori"))


@query("merge_cells", f"""WITH {FEATURES}, {PTS}, {cell_sql('pc', 'pts', 8, 'host_id, balance')}, h AS (SELECT cell, count(*) AS hosts, avg(balance) AS rent FROM pc GROUP BY cell)
SELECT coalesce(h.cell, ft.cell) AS cell, h.hosts, {rd('h.rent')} AS rent, ft.n_stations FROM h FULL JOIN ft ON h.cell = ft.cell""")
def merge_cells(spark, sf):
    h = with_cell(points(spark, sf), 8).groupBy("cell").agg(F.count(F.lit(1)).alias("hosts"), F.avg("balance").alias("rent"))
    return rounded(panel.merge_cells([h, station_features(spark, sf)], "cell"))


@query("cell_base")
def cell_base(spark, sf):
    return rounded(C.cell_base(triangles(spark, sf), "area_name", ["area_name"]), 4)


@query("location_premium", f"""WITH {PO}, p AS (SELECT cell, lp - avg(lp) OVER (PARTITION BY stratum) AS premium FROM po)
SELECT cell, count(*) AS n, {rd('avg(premium)')} AS premium FROM p GROUP BY cell HAVING count(*) >= 5""")
def location_premium(spark, sf):
    o = panel.group_mean(placed_orders(spark, sf), ["stratum"], "lp", "pred")
    return rounded(panel.cell_stat(o.withColumn("premium", F.col("lp") - F.col("pred")), "cell", "premium", "mean", 5))

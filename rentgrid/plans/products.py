"""Scalar functions, hashes and published tables over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentgrid.functions import scalars as S
from rentgrid.operators import panel, publish as P
from rentgrid.plans.places import PTS, cell_sql, places, points, with_cell
from rentgrid.plans.registry import query, read, rounded
from rentgrid.plans.tables import LST, ORD, listings, orders, rd
from rentgrid.sources import files, integrity


@query("json_items", f"""SELECT event_type, count(*) AS n, count(k) AS with_k, {rd('avg(k)')} AS mean_k FROM (
  SELECT event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY event_type""")
def json_items(spark, sf):
    e = read(spark, sf, "events").select("event_type", S.to_number(F.from_json("props", "k string")["k"]).alias("k"))
    return rounded(e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("with_k"), F.avg("k").alias("mean_k")))


@query("quote_features", f"""WITH q AS (SELECT l_returnflag, l_extendedprice AS total, l_discount * 100 AS d, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS nights
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_returnflag, {rd('avg(CASE WHEN nights > 0 THEN (total + d) / nights END)', 4)} AS gross_price, {rd('avg(CASE WHEN total + d > 0 THEN d / (total + d) END)')} AS discount_share,
  CAST(sum(nights) AS BIGINT) AS nights FROM q GROUP BY l_returnflag""")
def quote_features(spark, sf):
    item = F.struct((-F.col("l_discount") * 100).cast("string").alias("amount"), F.lit("discount").alias("item_type"), F.lit("d").alias("description"))
    sub = F.struct(F.lit("-999").alias("amount"), F.lit("discounted_subtotal").alias("item_type"), F.lit("s").alias("description"))
    raw = F.to_json(F.struct(F.struct(F.col("l_extendedprice").cast("string").alias("total_price"), F.array(item, sub).alias("raw_price_line_items")).alias("quote")))
    rows = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_returnflag", S.quote_features(raw, "o_orderdate", "l_shipdate").alias("q"))
    return rows.groupBy("l_returnflag").agg((F.round(F.avg("q.gross_price"), 4) + 0.0).alias("gross_price"),
                                            (F.round(F.avg("q.discount_share"), 6) + 0.0).alias("discount_share"), F.sum("q.nights").alias("nights"))


@query("parsed_prices", f"""SELECT o_orderkey, {rd('o_totalprice', 2)} AS price FROM orders""")
def parsed_prices(spark, sf):
    text = F.concat(F.lit(" $"), F.format_number("o_totalprice", 2))
    return rounded(read(spark, sf, "orders").select("o_orderkey", S.parse_price(text).alias("price")), 2)


@query("text_rules", """SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)ring') THEN 'hotel_pousada' WHEN p_name LIKE 'red%' THEN 'quarto_em_apartamento' ELSE 'quarto_em_casa' END AS grp,
  CASE WHEN p_size <= 10 THEN 'registrada' WHEN p_size <= 20 THEN 'isenta' WHEN p_size <= 30 THEN 'ausente' ELSE 'outra' END AS licence,
  CASE WHEN p_size <= 10 THEN '1-10' WHEN p_size <= 30 THEN '11-30' ELSE '31+' END AS band, coalesce(list_position(['ECONOMY', 'SMALL'], p_type) - 1, -1) AS code FROM part""")
def text_rules(spark, sf):
    n = F.col("p_name")
    prop = (F.when(n.rlike("(?i)ring"), "Room in hotel").when(n.startswith("red"), "Private room in loft").otherwise("Private room in home"))
    licence = (F.when(F.col("p_size") <= 10, "ose-strreg-00").when(F.col("p_size") <= 20, "EXEMPT").when(F.col("p_size") <= 30, "  ").otherwise("pending"))
    return read(spark, sf, "part").select(
        "p_partkey", S.property_group(prop, F.lit("Private room")).alias("grp"), S.licence_status(licence).alias("licence"),
        S.bucket("p_size", [0, 10, 30, None], ["1-10", "11-30", "31+"]).alias("band"), S.ordinal("p_type", ["ECONOMY", "SMALL"]).alias("code"))


@query("zip_like", """SELECT page_id, nullif(regexp_extract(zip, '^\\s*(\\d{5})', 1), '') AS zip FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN ' ' ELSE '' END || (9990 + page_id) || '.0' AS zip FROM pages)""")
def zip_like(spark, sf):
    text = F.concat(F.when(F.col("page_id") % 3 == 0, " ").otherwise(""), (F.col("page_id") + 9990).cast("string"), F.lit(".0"))
    return read(spark, sf, "pages").select("page_id", S.normalise_zip(text).alias("zip"))


MONTHS = "m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS value FROM orders GROUP BY 1)"


def months(spark, sf):
    return read(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("o_totalprice").alias("value"))


@query("index_factor", f"""WITH {MONTHS} SELECT {rd("max(value) FILTER (WHERE month = '2000-06') / max(value) FILTER (WHERE month = '1996-03')")} AS factor, '2000-06' AS month FROM m""")
def index_factor(spark, sf):
    return rounded(S.index_factor(months(spark, sf), "1996-03", "2000-06"))


@query("index_factor_year", f"""WITH {MONTHS} SELECT {rd("arg_max(value, month) FILTER (WHERE month <= '2000-12') / avg(value) FILTER (WHERE month LIKE '1997-%')")} AS factor, max(month) FILTER (WHERE month <= '2000-12') AS month FROM m""")
def index_factor_year(spark, sf):
    return rounded(S.index_factor(months(spark, sf), "1997", None, "2000-12"))


@query("content_digest")
def content_digest(spark, sf):
    d = integrity.content_digest(read(spark, sf, "lineitem"))
    return d.select("rows", F.col("sum").cast("string").alias("sum"), "mix")


@query("file_manifest")
def file_manifest(spark, sf):
    found = integrity.file_table(spark, sf, "*.parquet")
    known = found.select("path", F.when(F.col("path") == "orders.parquet", F.col("size") + 1).otherwise(F.col("size")).alias("size"), "sha256")
    return integrity.check_manifest(found, known.where("path <> 'region.parquet'"))


@query("public_points", f"""WITH {LST}, p AS (SELECT *, avg(lp) OVER (PARTITION BY stratum) AS pred FROM lst)
SELECT round(lat, 4) AS lat, round(lon, 4) AS lon, room_type, CASE WHEN price >= 10000 THEN round(price, 2) END AS price, round(exp(pred), 2) AS predicted FROM p""")
def public_points(spark, sf):
    rows = panel.group_mean(listings(spark, sf), ["stratum"], "lp", "pred").withColumn("ok", F.col("price") >= 10000)
    return P.public_points(rows, "lat", "lon", "price", "ok", "pred", ["room_type"])


CELLS8 = f"{PTS}, {cell_sql('pc', 'pts', 8, 'balance')}, cb AS (SELECT cell, avg(balance) AS balance, count(*) AS n FROM pc GROUP BY cell)"


def cell_balance(spark, sf):
    return with_cell(points(spark, sf), 8).groupBy("cell").agg(F.avg("balance").alias("balance"), F.count(F.lit(1)).alias("n"))


@query("map_table", f"""WITH {CELLS8} SELECT cell, {rd('balance', 6)} AS balance, n, CAST(NULL AS DOUBLE) AS missing FROM cb""")
def map_table(spark, sf):
    base = cell_balance(spark, sf)
    out = P.map_table([base], "cell", ["balance", "n", "missing"], with_cell(places(spark, sf), 8), "n", 6)
    return rounded(out, 6)


@query("class_breaks")
def class_breaks(spark, sf):
    return P.class_breaks(cell_balance(spark, sf).withColumn("change", F.col("balance") - 4500), {"balance": "sequential", "change": "diverging"})


@query("display_factor", "SELECT 'l_discount' AS metric, 100 AS factor UNION ALL SELECT 'l_quantity', 1 UNION ALL SELECT 'l_tax', 100")
def display_factor(spark, sf):
    return P.display_factor(read(spark, sf, "lineitem"), {"l_discount": "%", "l_quantity": "%", "l_tax": "fração"})


@query("summary", f"""WITH {ORD}, k AS (SELECT snapshot, CAST(count(*) AS DOUBLE) AS listings, avg(price) AS price FROM ord GROUP BY snapshot)
SELECT 'kpis' AS section, snapshot AS key, 'listings' AS metric, listings AS value FROM k UNION ALL SELECT 'kpis', snapshot, 'price', {rd('price', 4)} FROM k""")
def summary(spark, sf):
    k = orders(spark, sf).groupBy("snapshot").agg(F.count(F.lit(1)).alias("listings"), F.avg("price").alias("price"))
    return rounded(P.summary({"kpis": (k, ["snapshot"])}), 4)


@query("hash_sample", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':42'), o_orderkey LIMIT 100")
def hash_sample(spark, sf):
    return panel.hash_sample(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("top_n", f"""SELECT o_custkey, {rd('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 10""")
def top_n(spark, sf):
    totals = read(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return rounded(panel.top_n(totals, "total", 10, "o_custkey"), 2)


@query("picked_month", f"""WITH {MONTHS} SELECT '1999-12' AS month, {rd("max(value) FILTER (WHERE month = '1999-12')", 2)} AS value FROM m""")
def picked_month(spark, sf):
    wide = months(spark, sf).where("month <> '2000-01'").withColumn("k", F.lit("all")).groupBy("k").pivot("month").agg(F.max("value"))
    return rounded(files.pick_month(wide, ["k"], "2000-01").select("month", "value"), 2)

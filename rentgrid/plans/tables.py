"""The market roles of the given tables, in Spark and in SQL.

An order is a listing and its customer the host; orders before and after
1998-01-01 are the two snapshots; order status is the room type, order priority
the stratum, nation and region are neighbourhood and district. Customers and
suppliers get a place inside the bounding box from their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.plans.registry import read

SPLIT = "1998-01-01"
REF_DATE = "2001-08-02"

LAT = "(CAST(40.4774 AS DOUBLE) + CAST(({k} * 7919) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) * CAST(0.4402 AS DOUBLE))"
LON = "(CAST(-74.2591 AS DOUBLE) + CAST(({k} * 6101) % 10009 AS DOUBLE) / CAST(10009 AS DOUBLE) * CAST(0.5587 AS DOUBLE))"


def place(key: str) -> tuple[Column, Column]:
    return F.expr(LAT.format(k=key)), F.expr(LON.format(k=key))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Listings without their place: one scan, no join."""
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("host_id"),
        F.when(F.col("o_orderdate") < F.lit(SPLIT).cast("timestamp"), "A").otherwise("B").alias("snapshot"),
        F.col("o_totalprice").alias("price"), F.log("o_totalprice").alias("lp"),
        F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").alias("room_type"),
        F.col("o_orderpriority").alias("stratum"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("long_stay"))


def areas(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = read(spark, sf, "nation"), read(spark, sf, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("area_id"), F.col("n_name").alias("neighbourhood"),
        F.col("r_name").alias("district"))


def hosts(spark: SparkSession, sf: str) -> DataFrame:
    lat, lon = place("c_custkey")
    return read(spark, sf, "customer").select(
        F.col("c_custkey").alias("host_id"), F.col("c_nationkey").alias("area_id"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
        lat.alias("lat"), lon.alias("lon"))


def stations(spark: SparkSession, sf: str) -> DataFrame:
    lat, lon = place("s_suppkey")
    return read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("station_id"), F.col("s_nationkey").alias("area_id"),
        F.col("s_acctbal").alias("balance"), lat.alias("lat"), lon.alias("lon"))


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the place and area of their customer."""
    placed = hosts(spark, sf).join(areas(spark, sf), "area_id")
    return orders(spark, sf).join(placed, "host_id")


ORD = f"""ord AS (
  SELECT o_orderkey AS id, o_custkey AS host_id,
         CASE WHEN o_orderdate < TIMESTAMP '{SPLIT} 00:00:00' THEN 'A' ELSE 'B' END AS snapshot,
         o_totalprice AS price, ln(o_totalprice) AS lp, CAST(o_orderdate AS DATE) AS day,
         o_orderstatus AS room_type, o_orderpriority AS stratum,
         o_orderpriority IN ('1-URGENT', '2-HIGH') AS long_stay
  FROM orders)"""

HOSTS = f"""hosts AS (
  SELECT c_custkey AS host_id, c_nationkey AS area_id, c_acctbal AS balance, c_mktsegment AS segment,
         {LAT.format(k='c_custkey')} AS lat, {LON.format(k='c_custkey')} AS lon FROM customer)"""

STATIONS = f"""stations AS (
  SELECT s_suppkey AS station_id, s_nationkey AS area_id, s_acctbal AS balance,
         {LAT.format(k='s_suppkey')} AS lat, {LON.format(k='s_suppkey')} AS lon FROM supplier)"""

AREAS = """areas AS (
  SELECT n_nationkey AS area_id, n_name AS neighbourhood, r_name AS district
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

LST = f"""{ORD}, {HOSTS}, {AREAS}, lst AS (
  SELECT ord.*, hosts.area_id, hosts.balance, hosts.segment, hosts.lat, hosts.lon,
         areas.neighbourhood, areas.district
  FROM ord JOIN hosts USING (host_id) JOIN areas USING (area_id))"""


def rd(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE)"

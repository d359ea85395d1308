"""The whole listing cascade, all twelve rules, and the table of cleaned listings.

Orders play the raw listings under raw column names: every eleventh repeats the id
before it, prices and stays take few values (so that whole rows repeat), and place,
type and quote follow from the customer so that every rule has rows of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.functions import constants as K
from rentgrid.functions import scalars as S
from rentgrid.operators import quarantine as Q
from rentgrid.operators.skew import attach_per_key
from rentgrid.plans.registry import query, read, rounded
from rentgrid.plans.tables import LAT, LON, REF_DATE, SPLIT, place, rd
from rentgrid.session import shared_table

FIRST, SECOND = "2019", "2026"
DEFLATOR = 1.25
MONTHLY = "Average monthly price"
#: Raw names and the names that the rules use.
NEUTRAL = {"preco": "price", "bairro": "area", "noites_minimas": "minimum_nights"}


def raw_listings(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: the raw columns of a listing, faults included."""
    host, nation = F.col("o_custkey"), F.col("c_nationkey")
    lat, lon = place("o_custkey")
    step = F.floor(F.col("o_totalprice") / 25000)
    urgency = F.substring("o_orderpriority", 1, 1)
    placed = read(spark, sf, "customer").join(
        read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return read(spark, sf, "orders").join(placed, host == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("row"),
        (F.col("o_orderkey") - (F.col("o_orderkey") % 11 == 10).cast("long")).alias("id"),
        F.when(F.col("o_orderdate") < F.lit(SPLIT).cast("timestamp"), FIRST).otherwise(SECOND).alias("snapshot"),
        host.alias("host_id"),
        F.when(host % 29 != 0, lat).alias("latitude"),
        (lon + F.when(host % 29 == 1, 2.0).otherwise(0.0)).alias("longitude"),
        F.when(nation == 7, "Newark").otherwise(F.element_at(
            F.array(*[F.lit(d) for d in K.DISTRICTS]), F.col("n_regionkey") + 1)).alias("district"),
        F.col("n_name").alias("bairro"),
        F.when(host % 31 == 2, "Tent").when(F.col("o_orderstatus") == "F", K.ROOM_TYPES[0])
        .when(F.col("o_orderstatus") == "O", K.ROOM_TYPES[1]).otherwise(K.ROOM_TYPES[2]).alias("room_type"),
        F.when(urgency == "1", 30).when(urgency == "2", 1).when(urgency == "3", 2).when(urgency == "4", 5)
        .when(host % 3 == 1, 0).when(host % 3 == 2, 3).alias("noites_minimas"),
        F.when(step == 0, None).when(step == 1, 0.0).when(step == 2, 5.0).when(step == 19, 12000.0)
        .otherwise(step * 20.0).alias("preco"),
        (host % 40 + 1).alias("quote_nights"),
        F.col("o_orderdate").cast("date").alias("day"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"))


def rules() -> list[Q.Rule]:
    return Q.listing_rules(quote_nights="quote_nights", second_snapshot=SECOND)


def tagged_listings(spark: SparkSession, sf: str) -> DataFrame:
    df = Q.neutral_names(raw_listings(spark, sf), NEUTRAL)
    same = [c for c in df.columns if c not in ("row", "id", "day")]
    df = Q.mark_all_repeats(df, {"rep_id": ["snapshot", "id"], "rep_row": same}, "row")
    known = read(spark, sf, "nation").where("n_nationkey % 8 <> 3")
    df = Q.mark_unknown(df, "area", known, "n_name", "unknown_area")
    return Q.tag(df, rules(), F.col("snapshot"))


def _hits() -> str:
    return "CASE " + " ".join(f"WHEN m[{i}] THEN {i}" for i in range(1, 13)) + " ELSE 0 END"


# --- fixed values: the rules, in the order of the cascade ----------------------
CODES = "['B01','B02','B03','B04','B05','B06','B07','P01','P02','P03','P04','P05']"
REASONS = ("['id repetido','linha idêntica exceto o id','coordenada nula ou fora do envelope','distrito fora da lista',"
           "'bairro fora da lista','tipo fora da lista','mínimo de noites nulo ou < 1','preço nulo','preço zero',"
           "'cotação longa','preço abaixo do piso','preço acima do teto']")

RAW = f"""raw AS (
  SELECT o_orderkey AS row, o_orderkey - CASE WHEN o_orderkey % 11 = 10 THEN 1 ELSE 0 END AS id,
    CASE WHEN o_orderdate < TIMESTAMP '{SPLIT} 00:00:00' THEN '{FIRST}' ELSE '{SECOND}' END AS snapshot,
    o_custkey AS host_id,
    CASE WHEN o_custkey % 29 <> 0 THEN {LAT.format(k='o_custkey')} END AS latitude,
    {LON.format(k='o_custkey')} + CASE WHEN o_custkey % 29 = 1 THEN CAST(2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS longitude,
    CASE WHEN c_nationkey = 7 THEN 'Newark'
      ELSE ['Manhattan','Brooklyn','Queens','Bronx','Staten Island'][n_regionkey + 1] END AS district,
    n_name AS area,
    CASE WHEN o_custkey % 31 = 2 THEN 'Tent' WHEN o_orderstatus = 'F' THEN 'Entire home/apt'
      WHEN o_orderstatus = 'O' THEN 'Private room' ELSE 'Shared room' END AS room_type,
    CASE o_orderpriority[1] WHEN '1' THEN 30 WHEN '2' THEN 1 WHEN '3' THEN 2 WHEN '4' THEN 5
      ELSE CASE o_custkey % 3 WHEN 1 THEN 0 WHEN 2 THEN 3 END END AS minimum_nights,
    CASE CAST(floor(o_totalprice / 25000) AS INTEGER) WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE)
      WHEN 2 THEN CAST(5 AS DOUBLE) WHEN 19 THEN CAST(12000 AS DOUBLE)
      ELSE floor(o_totalprice / 25000) * CAST(20 AS DOUBLE) END AS price,
    o_custkey % 40 + 1 AS quote_nights, CAST(o_orderdate AS DATE) AS day, c_acctbal AS balance, c_mktsegment AS segment
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
flagged AS (
  SELECT *, row_number() OVER (PARTITION BY snapshot, id ORDER BY row) > 1 AS rep_id,
    row_number() OVER (PARTITION BY snapshot, host_id, latitude, longitude, district, area, room_type, minimum_nights,
                       price, quote_nights, balance, segment ORDER BY row) > 1 AS rep_row
  FROM raw),
hits AS (
  SELECT *, [rep_id, rep_row,
    NOT coalesce(longitude BETWEEN -74.2591 AND -73.7004 AND latitude BETWEEN 40.4774 AND 40.9176, false),
    district NOT IN ('Manhattan','Brooklyn','Queens','Bronx','Staten Island'),
    area NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 8 <> 3),
    room_type NOT IN ('Entire home/apt','Private room','Shared room','Hotel room'),
    NOT coalesce(minimum_nights >= 1, false),
    price IS NULL, coalesce(price = 0, false), snapshot = '{SECOND}' AND quote_nights > 31,
    coalesce(price > 0 AND price < 10, false), coalesce(price > 10000, false)] AS m
  FROM flagged),
casc AS (SELECT *, {_hits()} AS h FROM hits)"""


@query("listing_quarantine", f"""WITH {RAW}
SELECT snapshot, id, {CODES}[h] AS regra, {REASONS}[h] AS motivo,
  CASE WHEN h <= 7 THEN 'base' ELSE 'preco' END AS escopo
FROM casc WHERE h > 0""")
def listing_quarantine(spark, sf):
    found = Q.quarantined(tagged_listings(spark, sf), rules())
    return Q.empty_quarantine(spark).unionByName(found)


@query("listing_cascade", f"""WITH {RAW},
each AS (SELECT snapshot, h, m, unnest(generate_series(1, 12)) AS i FROM casc),
sums AS (SELECT snapshot, i, count(*) AS entrada, count(*) FILTER (WHERE m[i]) AS casam,
  count(*) FILTER (WHERE h = i) AS cascata FROM each GROUP BY ALL)
SELECT snapshot, CAST(i - 1 AS INTEGER) AS ordem, {CODES}[i] AS codigo,
  ['id_duplicado','duplicata_perfeita','coordenada_fora_nyc','distrito_invalido','bairro_desconhecido','room_type_invalido',
   'minimo_noites_invalido','preco_ausente','preco_zero','cotacao_acima_31_noites','preco_abaixo_piso','preco_acima_teto'][i] AS regra,
  CASE WHEN i <= 7 THEN 'base' ELSE 'preco' END AS escopo, entrada, casam, cascata,
  entrada - CAST(sum(cascata) OVER (PARTITION BY snapshot ORDER BY i) AS BIGINT) AS restam
FROM sums WHERE NOT (i = 10 AND snapshot = '{FIRST}')""")
def listing_cascade(spark, sf):
    tagged = Q.tags(tagged_listings(spark, sf))
    return Q.check_balance(Q.cascade_report(Q.rule_report(tagged, rules())), tagged)


def cleaned(tagged: DataFrame) -> DataFrame:
    """The rows that stay, with the derived columns of a cleaned listing.

    A host with very many listings is split when its count is attached. The rows are written once,
    as they are counted and then joined.
    """
    base = shared_table(Q.kept(tagged), "kept-listings")
    sizes = shared_table(base.groupBy("snapshot", "host_id").agg(F.count(F.lit(1)).alias("host_listings")), "host-sizes")
    base = attach_per_key(base, sizes, ["snapshot", "host_id"], "host_listings")
    quote = F.concat(F.lit('{"quote":{"total_price":"10","raw_price_line_items":[{"amount":"'),
                     (F.col("host_id") % 97).cast("string"), F.lit(f'.5","item_type":"x","description":"{MONTHLY}"}}]}}}}'))
    bath = F.when(F.col("host_id") % 5 == 0, None).when(F.col("segment").startswith("B"), "1 Shared bath").otherwise("2 baths")
    superhost = F.when(F.col("balance") > 5000, "t").when(F.col("balance") > 0, "f")
    # later columns read earlier ones, so they are added in two steps
    first = base.select(
        "snapshot", "id", "host_id", "host_listings", "district", "area", "room_type", "minimum_nights", "price",
        "preco_valido",
        S.is_long_stay("minimum_nights").alias("min30"), S.is_multi_host("host_listings").alias("host_multi"),
        S.shared_bath(bath).alias("shared_bath"), S.false_if_null(S.tf_bool(superhost)).alias("superhost"),
        S.host_years(F.col("host_id") % 12, F.col("host_id") % 10).alias("host_years"),
        S.months_since("day", F.lit(REF_DATE)).alias("months"),
        S.quote_item(quote, MONTHLY).alias("monthly_price"),
        S.clean_sentinels("balance").alias("balance"),
        F.when(F.col("host_id") % 2 == 0, F.col("price") * 2).alias("gross_price"))
    out = first.withColumn("stratum", S.stratum_label("min30")).withColumn(
        "price_constant", S.constant_price("price", "gross_price", F.col("snapshot") == FIRST, F.lit(DEFLATOR)))
    return S.bool_to_num(out, keep=("preco_valido",))


@query("cleaned_listings", f"""WITH {RAW},
base AS (SELECT *, h = 0 AS preco_valido, count(*) OVER (PARTITION BY snapshot, host_id) AS host_listings
  FROM casc WHERE h = 0 OR h > 7)
SELECT snapshot, id, host_id, host_listings, district, area, room_type, minimum_nights, {rd('price')} AS price, preco_valido,
  CAST(minimum_nights >= 30 AS DOUBLE) AS min30, CAST(host_listings > 1 AS DOUBLE) AS host_multi,
  CASE WHEN host_id % 5 = 0 THEN NULL WHEN segment LIKE 'B%' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS shared_bath,
  CAST(balance > 5000 AS DOUBLE) AS superhost,
  {rd('host_id % 12 + CAST(host_id % 10 AS DOUBLE) / 12')} AS host_years,
  {rd(f"CAST(date_diff('day', day, DATE '{REF_DATE}') AS DOUBLE) / (365.25 / 12)")} AS months,
  CAST(host_id % 97 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS monthly_price,
  {rd('CASE WHEN balance >= 0 THEN balance END')} AS balance,
  {rd('CASE WHEN host_id % 2 = 0 THEN price * 2 END')} AS gross_price,
  CASE WHEN minimum_nights >= 30 THEN '30+ noites' ELSE '< 30 noites' END AS stratum,
  {rd(f"CASE WHEN snapshot = '{FIRST}' THEN price * CAST({DEFLATOR} AS DOUBLE) WHEN host_id % 2 = 0 THEN price * 2 ELSE price END")} AS price_constant
FROM base""")
def cleaned_listings(spark, sf):
    return rounded(cleaned(tagged_listings(spark, sf)))


@query("area_vintages", f"""WITH t AS (
  SELECT c_nationkey AS area_id, CAST(count(*) AS DOUBLE) AS homes,
    avg(c_acctbal) FILTER (WHERE c_custkey % 2 = 0) AS income_2019, avg(c_acctbal) FILTER (WHERE c_custkey % 2 = 1) AS income_2026
  FROM customer GROUP BY c_nationkey)
SELECT '{FIRST}' AS vintage, area_id, {rd(f'income_2019 * CAST({DEFLATOR} AS DOUBLE)')} AS income, {rd('homes')} AS homes FROM t
UNION ALL SELECT '{SECOND}', area_id, {rd('income_2026')}, {rd('homes')} FROM t""")
def area_vintages(spark, sf):
    even = F.col("c_custkey") % 2 == 0
    areas = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("area_id")).agg(
        F.count(F.lit(1)).cast("double").alias("homes"),
        F.avg(F.when(even, F.col("c_acctbal"))).alias("income_2019"),
        F.avg(F.when(~even, F.col("c_acctbal"))).alias("income_2026"))
    out = None
    for label, factor in ((FIRST, DEFLATOR), (SECOND, 1.0)):
        one = S.vintage(areas, label, {FIRST: "_2019", SECOND: "_2026"}, ["income", "homes"], ["area_id"],
                        {"income": F.lit(factor)}).withColumn("vintage", F.lit(label))
        out = one if out is None else out.unionByName(one)
    return rounded(out)

"""Quarantine and two-snapshot comparison over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentgrid.functions import scalars as S
from rentgrid.operators import panel, quarantine as Q
from rentgrid.operators.contract import ColumnSpec, Contract, dictionary, null_counts, validate
from rentgrid.plans.registry import query, r, read, rounded
from rentgrid.plans.tables import AREAS, LST, ORD, listings, orders, rd

PERIODS = ("A", "B")
FLOOR, CEILING, LONG_QUOTE = 5784.24, 494687.95, 400000.0
STRATA_DOMAIN = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]


def order_rules() -> list[Q.Rule]:
    c = F.col
    return [
        Q.Rule("B01", "repetida", Q.BASE, "mesmo anfitrião e dia", c("rep")),
        Q.Rule("B04", "estrato_invalido", Q.BASE, "estrato fora da lista",
               ~F.coalesce(c("stratum").isin(*STRATA_DOMAIN), F.lit(False))),
        Q.Rule("P03", "cotacao_acima_31_noites", Q.PRICE, "cotação longa",
               (c("room_type") == "P") & (c("price") > LONG_QUOTE), ("B",)),
        Q.Rule("P04", "preco_abaixo_piso", Q.PRICE, "preço abaixo do piso", c("price") < FLOOR),
        Q.Rule("P05", "preco_acima_teto", Q.PRICE, "preço acima do teto", c("price") > CEILING),
    ]


def tagged_orders(spark, sf):
    marked = Q.mark_repeats(orders(spark, sf), ["host_id", "day"], "id", "rep")
    return Q.tag(marked, order_rules(), F.col("snapshot"))


TAGGED = f"""{ORD}, marked AS (
  SELECT *, row_number() OVER (PARTITION BY host_id, day ORDER BY id) > 1 AS rep FROM ord),
tagged AS (
  SELECT *, rep AS m1, NOT stratum IN ('1-URGENT','2-HIGH','3-MEDIUM','5-LOW') AS m2,
         (snapshot = 'B' AND room_type = 'P' AND price > 400000.0) AS m3,
         price < CAST({FLOOR} AS DOUBLE) AS m4, price > CAST({CEILING} AS DOUBLE) AS m5 FROM marked),
hit AS (
  SELECT *, CASE WHEN m1 THEN 1 WHEN m2 THEN 2 WHEN m3 THEN 3 WHEN m4 THEN 4 WHEN m5 THEN 5 ELSE 0 END AS h
  FROM tagged)"""


@query("quarantine_rows", f"""WITH {TAGGED}
SELECT snapshot, id, ['B01','B04','P03','P04','P05'][h] AS regra,
       ['mesmo anfitrião e dia','estrato fora da lista','cotação longa','preço abaixo do piso',
        'preço acima do teto'][h] AS motivo,
       CASE WHEN h <= 2 THEN 'base' ELSE 'preco' END AS escopo
FROM hit WHERE h > 0""")
def quarantine_rows(spark, sf):
    return Q.quarantined(tagged_orders(spark, sf), order_rules())


@query("quarantine_kept", f"""WITH {TAGGED}
SELECT snapshot, room_type, count(*) AS n, count(*) FILTER (WHERE h = 0) AS priced
FROM hit WHERE h = 0 OR h > 2 GROUP BY ALL""")
def quarantine_kept(spark, sf):
    return Q.kept(tagged_orders(spark, sf)).groupBy("snapshot", "room_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("preco_valido").alias("priced"))


REPORT = f"""{TAGGED}, rep1 AS (
  SELECT snapshot, count(*) AS entrada,
         [count(*) FILTER (WHERE m1), count(*) FILTER (WHERE m2), count(*) FILTER (WHERE m3),
          count(*) FILTER (WHERE m4), count(*) FILTER (WHERE m5)] AS ms,
         [count(*) FILTER (WHERE h=1), count(*) FILTER (WHERE h=2), count(*) FILTER (WHERE h=3),
          count(*) FILTER (WHERE h=4), count(*) FILTER (WHERE h=5)] AS hs
  FROM hit GROUP BY snapshot),
report AS (
  SELECT snapshot, entrada, i - 1 AS ordem, ['B01','B04','P03','P04','P05'][i] AS codigo,
         ['repetida','estrato_invalido','cotacao_acima_31_noites','preco_abaixo_piso','preco_acima_teto'][i] AS regra,
         CASE WHEN i <= 2 THEN 'base' ELSE 'preco' END AS escopo, ms[i] AS casam, hs[i] AS cascata
  FROM rep1, (SELECT unnest([1,2,3,4,5]) AS i) WHERE NOT (i = 3 AND snapshot = 'A'))"""


@query("cascade_report", f"""WITH {REPORT}
SELECT snapshot, CAST(ordem AS INTEGER) AS ordem, codigo, regra, escopo, entrada, casam, cascata,
       entrada - CAST(sum(cascata) OVER (PARTITION BY snapshot ORDER BY ordem) AS BIGINT) AS restam
FROM report""")
def cascade_report(spark, sf):
    tagged = Q.tags(tagged_orders(spark, sf))
    report = Q.cascade_report(Q.rule_report(tagged, order_rules()))
    return Q.check_balance(report, tagged)


@query("rule_matrix", f"""WITH {REPORT}
SELECT codigo, max(casam) FILTER (WHERE snapshot = 'A') AS "casam_A",
       max(cascata) FILTER (WHERE snapshot = 'A') AS "cascata_A",
       max(casam) FILTER (WHERE snapshot = 'B') AS "casam_B",
       max(cascata) FILTER (WHERE snapshot = 'B') AS "cascata_B"
FROM report GROUP BY codigo""")
def rule_matrix(spark, sf):
    return Q.rule_matrix(Q.rule_report(tagged_orders(spark, sf), order_rules()), PERIODS)


@query("scope_counts", f"""WITH {TAGGED}
SELECT snapshot, CASE WHEN h <= 2 THEN 'base' ELSE 'preco' END AS escopo, count(*) AS n
FROM hit WHERE h > 0 GROUP BY ALL""")
def scope_counts(spark, sf):
    return Q.scope_counts(quarantine_rows(spark, sf))


@query("perfect_duplicates", """
SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE rn > 1) AS repeated FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus
                               ORDER BY l_orderkey * 10 + l_linenumber) AS rn FROM lineitem)
GROUP BY l_returnflag""")
def perfect_duplicates(spark, sf):
    rows = read(spark, sf, "lineitem").withColumn("_row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    keys = ["l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return Q.mark_repeats(rows.select(*keys, "_row"), keys, "_row", "rep").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("rep").alias("repeated"))


@query("unknown_area", """
SELECT c_mktsegment, count(*) FILTER (WHERE n_nationkey IS NULL) AS unknown, count(*) AS n
FROM customer LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)
  ON c_nationkey = n_nationkey GROUP BY c_mktsegment""")
def unknown_area(spark, sf):
    valid = read(spark, sf, "nation").where("n_regionkey <> 2")
    flagged = Q.mark_unknown(read(spark, sf, "customer"), "c_nationkey", valid, "n_nationkey", "unknown")
    return flagged.groupBy("c_mktsegment").agg(F.count_if("unknown").alias("unknown"),
                                               F.count(F.lit(1)).alias("n"))


ORDER_CONTRACT = Contract((
    ColumnSpec("o_orderkey", "bigint", "id", nullable=False, minimum=1),
    ColumnSpec("o_custkey", "bigint", "host", nullable=False, personal=True),
    ColumnSpec("o_orderstatus", "string", "type", domain=("F", "O")),
    ColumnSpec("o_totalprice", "double", "price", minimum=FLOOR, maximum=CEILING),
    ColumnSpec("o_orderdate", "timestamp", "day"),
    ColumnSpec("o_orderpriority", "string", "stratum", domain=tuple(STRATA_DOMAIN)),
))


@query("contract_violations", f"""
SELECT column_name AS "column", violation, n FROM (
  SELECT 'o_orderkey' AS column_name, 'minimum' AS violation, count(*) FILTER (WHERE o_orderkey < 1) AS n FROM orders
  UNION ALL SELECT 'o_orderstatus', 'domain', count(*) FILTER (WHERE o_orderstatus NOT IN ('F','O')) FROM orders
  UNION ALL SELECT 'o_totalprice', 'minimum', count(*) FILTER (WHERE o_totalprice < {FLOOR}) FROM orders
  UNION ALL SELECT 'o_totalprice', 'maximum', count(*) FILTER (WHERE o_totalprice > {CEILING}) FROM orders
  UNION ALL SELECT 'o_orderpriority', 'domain', count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') FROM orders)
WHERE n > 0""")
def contract_violations(spark, sf):
    return validate(read(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")),
                    ORDER_CONTRACT)


@query("data_dictionary", """
SELECT 'o_orderkey' AS "column", count(*) FILTER (WHERE o_orderkey IS NULL) AS nulls,
       CAST(min(o_orderkey) AS VARCHAR) AS lowest, CAST(max(o_orderkey) AS VARCHAR) AS highest FROM orders
UNION ALL SELECT 'o_custkey', count(*) FILTER (WHERE o_custkey IS NULL), NULL, NULL FROM orders
UNION ALL SELECT 'o_orderstatus', count(*) FILTER (WHERE o_orderstatus IS NULL), min(o_orderstatus), max(o_orderstatus) FROM orders
UNION ALL SELECT 'o_orderpriority', count(*) FILTER (WHERE o_orderpriority IS NULL), min(o_orderpriority), max(o_orderpriority) FROM orders""")
def data_dictionary(spark, sf):
    kept = [c for c in ORDER_CONTRACT.columns
            if c.name in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")]
    return dictionary(read(spark, sf, "orders"), Contract(tuple(kept))).select(
        "column", "nulls", "lowest", "highest")


@query("null_counts", """
SELECT c AS "column", n FROM (
  SELECT 'l_orderkey' AS c, count(*) FILTER (WHERE l_orderkey IS NULL) AS n FROM lineitem
  UNION ALL SELECT 'rate', count(*) FILTER (WHERE l_discount = 0) FROM lineitem
  UNION ALL SELECT 'tax', count(*) FILTER (WHERE l_tax = 0) FROM lineitem)""")
def null_counts_query(spark, sf):
    rows = read(spark, sf, "lineitem").select(
        "l_orderkey", F.nullif(F.col("l_discount"), F.lit(0.0)).alias("rate"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("tax"))
    return null_counts(rows)


# --- comparison of snapshots ---------------------------------------------------------

@query("kpis", f"""WITH {ORD}, hs AS (
  SELECT snapshot, host_id, count(*) AS size FROM ord GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY size DESC, host_id) AS rn,
                  count(*) OVER (PARTITION BY snapshot) AS hosts,
                  sum(size) OVER (PARTITION BY snapshot) AS total FROM hs),
top AS (SELECT snapshot, any_value(hosts) AS hosts, sum(size) FILTER (WHERE rn <= greatest(1, floor(hosts * CAST(0.01 AS DOUBLE)))) / any_value(total) AS ts
        FROM ranked GROUP BY snapshot)
SELECT ord.snapshot, count(*) AS listings, count(*) FILTER (WHERE price >= 10000) AS priced,
       {rd("avg(CASE WHEN room_type = 'F' THEN 1.0 ELSE 0.0 END)")} AS share_entire,
       {rd("avg(CASE WHEN long_stay THEN 1.0 ELSE 0.0 END)")} AS share_long,
       {rd("any_value(ts)")} AS top_host_share, any_value(hosts) AS hosts,
       {rd("median(price) FILTER (WHERE price >= 10000)")} AS median_price,
       {rd("median(price) FILTER (WHERE price >= 10000 AND NOT long_stay)")} AS median_short,
       {rd("median(price) FILTER (WHERE price >= 10000 AND long_stay)")} AS median_long
FROM ord JOIN top USING (snapshot) GROUP BY ord.snapshot""")
def kpis(spark, sf):
    price = F.col("price")
    return rounded(panel.kpis(
        orders(spark, sf), "snapshot", "host_id",
        {"share_entire": F.col("room_type") == "F", "share_long": F.col("long_stay")}, price >= 10000,
        {"median_price": price, "median_short": F.when(~F.col("long_stay"), price),
         "median_long": F.when(F.col("long_stay"), price)}))


BANDS = "CASE WHEN size <= 1 THEN '1' WHEN size <= 2 THEN '2' WHEN size <= 5 THEN '3–5' WHEN size <= 10 THEN '6–10' WHEN size <= 50 THEN '11–50' ELSE '51+' END"


@query("concentration", f"""WITH {ORD}, hs AS (
  SELECT snapshot, host_id, count(*) AS size FROM ord GROUP BY ALL),
banded AS (SELECT snapshot, {BANDS} AS band, count(*) AS hosts, sum(size) AS l FROM hs GROUP BY ALL),
frame AS (SELECT snapshot, band, total FROM (SELECT snapshot, sum(size) AS total FROM hs GROUP BY snapshot),
          (SELECT unnest(['1','2','3–5','6–10','11–50','51+']) AS band))
SELECT snapshot, band, coalesce(hosts, 0) AS hosts, {rd("coalesce(l, 0) / total")} AS listing_share
FROM frame LEFT JOIN banded USING (snapshot, band)""")
def concentration(spark, sf):
    return rounded(panel.concentration(orders(spark, sf), "snapshot", "host_id"))


@query("multi_host", f"""WITH {ORD}, hs AS (SELECT snapshot, host_id, count(*) AS size FROM ord GROUP BY ALL)
SELECT snapshot, {rd("sum(CASE WHEN size > 1 THEN size ELSE 0 END) / sum(size)")} AS listing_share,
       {rd("avg(CASE WHEN size > 1 THEN 1.0 ELSE 0.0 END)")} AS host_share FROM hs GROUP BY snapshot""")
def multi_host(spark, sf):
    return rounded(panel.multi_host(orders(spark, sf), "snapshot", "host_id"))


@query("effective_supply", f"""
WITH o AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'A' ELSE 'B' END AS snapshot,
                  least(l_quantity / 100.0, CAST(0.7 AS DOUBLE)) AS occ FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT sum(occ) FILTER (WHERE snapshot = 'A') AS a, sum(occ) FILTER (WHERE snapshot = 'B') AS b FROM o)
SELECT {rd("a")} AS supply_a, {rd("b")} AS supply_b, {rd("100 * (b / a - 1)")} AS change_pct FROM s""")
def effective_supply(spark, sf):
    lines = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.least(F.col("l_quantity") / 100, F.lit(0.7)).alias("occ"))
    rows = lines.join(orders(spark, sf).select("id", "snapshot"), "id")
    return rounded(panel.effective_supply(rows, "snapshot", "occ", PERIODS))


Z = "CAST(1.959963984540054 AS DOUBLE)"


@query("stratum_prices", f"""WITH {ORD}, ranked AS (
  SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY stratum, room_type, snapshot) AS n
  FROM ord WINDOW w AS (PARTITION BY stratum, room_type, snapshot ORDER BY price)),
st AS (SELECT stratum, room_type, snapshot, any_value(n) AS n, median(price) AS median,
  max(price) FILTER (WHERE n >= 10 AND i = greatest(0, floor(n / 2 - {Z} * sqrt(n) / 2))) AS ci_low,
  max(price) FILTER (WHERE n >= 10 AND i = least(n - 1, ceil(n / 2 + {Z} * sqrt(n) / 2) - 1)) AS ci_high
  FROM ranked GROUP BY ALL),
w AS (SELECT stratum, room_type, {", ".join(
    f"max({c}) FILTER (WHERE snapshot = '{s}') AS {c}_{s.lower()}"
    for s in "AB" for c in ("n", "median", "ci_low", "ci_high"))} FROM st GROUP BY ALL)
SELECT stratum, room_type, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, {", ".join(
    f"{rd(c + '_' + s)} AS {c}_{s}" for s in "ab" for c in ("median", "ci_low", "ci_high"))},
  {rd("100 * (median_b / median_a - 1)")} AS change_pct FROM w""")
def stratum_prices(spark, sf):
    return rounded(panel.stratum_prices(orders(spark, sf), ["stratum", "room_type"], "snapshot", PERIODS, "price"))


SHIFT = f"""{ORD}, c AS (
  SELECT stratum, room_type, count(*) FILTER (WHERE snapshot = 'A') AS n_a,
         count(*) FILTER (WHERE snapshot = 'B') AS n_b,
         avg(lp) FILTER (WHERE snapshot = 'A') AS mean_a, avg(lp) FILTER (WHERE snapshot = 'B') AS mean_b
  FROM ord GROUP BY ALL),
w AS (SELECT *, n_a / (SELECT sum(n_a) FROM c WHERE n_a > 0 AND n_b > 0) AS weight_a,
             n_b / (SELECT sum(n_b) FROM c WHERE n_a > 0 AND n_b > 0) AS weight_b FROM c),
parts AS (SELECT *, (weight_b - weight_a) * mean_a AS composition, weight_b * (mean_b - mean_a) AS within FROM w
          WHERE n_a > 0 AND n_b > 0)"""


@query("shift_share", f"""WITH {SHIFT}
SELECT stratum, room_type, n_a, n_b, {rd("mean_a")} AS mean_a, {rd("mean_b")} AS mean_b, true AS complete,
  {rd("weight_a")} AS weight_a, {rd("weight_b")} AS weight_b, {rd("composition")} AS composition,
  {rd("within")} AS within, {rd("100 * (exp(mean_b - mean_a) - 1)")} AS change_pct FROM parts""")
def shift_share(spark, sf):
    return rounded(panel.shift_share(orders(spark, sf), ["stratum", "room_type"], "snapshot", PERIODS, F.col("lp")))


@query("shift_share_total", f"""WITH {SHIFT}, s AS (
  SELECT sum(composition) AS c, sum(within) AS w FROM parts)
SELECT {rd("c")} AS composition, {rd("w")} AS within, {rd("c + w")} AS total,
  {rd("100 * (exp(c + w) - 1)")} AS change_pct, {rd("c / (c + w)")} AS composition_share,
  CAST(0 AS BIGINT) AS strata_left_out FROM s""")
def shift_share_total(spark, sf):
    return rounded(panel.shift_share_total(panel.shift_share(
        orders(spark, sf), ["stratum", "room_type"], "snapshot", PERIODS, F.col("lp"))))


def compare_sql(key: str, min_n: int) -> str:
    return f"""WITH {LST}
SELECT {key}, n_a, n_b, {rd("la")} AS long_a, {rd("lb")} AS long_b, {rd("pa")} AS price_a, {rd("pb")} AS price_b,
  {rd("100 * (n_b / n_a - 1)")} AS change_pct
FROM (SELECT {key}, count(*) FILTER (WHERE snapshot = 'A') AS n_a, count(*) FILTER (WHERE snapshot = 'B') AS n_b,
  avg(CASE WHEN long_stay THEN 1.0 ELSE 0.0 END) FILTER (WHERE snapshot = 'A') AS la,
  avg(CASE WHEN long_stay THEN 1.0 ELSE 0.0 END) FILTER (WHERE snapshot = 'B') AS lb,
  median(price) FILTER (WHERE snapshot = 'A' AND price >= 10000) AS pa,
  median(price) FILTER (WHERE snapshot = 'B' AND price >= 10000) AS pb FROM lst GROUP BY {key})
WHERE greatest(n_a, n_b) >= {min_n}"""


def compare(spark, sf, key, min_n):
    return rounded(panel.compare_by(listings(spark, sf), [key], "snapshot", PERIODS, "price",
                                    F.col("price") >= 10000, {"long": F.col("long_stay")}, min_n))


@query("compare_by_district", compare_sql("district", 0))
def compare_by_district(spark, sf):
    return compare(spark, sf, "district", 0)


@query("compare_by_neighbourhood", compare_sql("neighbourhood", 30))
def compare_by_neighbourhood(spark, sf):
    return compare(spark, sf, "neighbourhood", 30)


@query("renewal", f"""WITH {ORD}, a AS (SELECT * FROM ord WHERE snapshot = 'A'), b AS (SELECT * FROM ord WHERE snapshot = 'B'),
t AS (SELECT CASE WHEN day IN (SELECT day FROM a WHERE long_stay) THEN 'survived'
                  WHEN host_id IN (SELECT host_id FROM a) THEN 'new_known_host' ELSE 'new_host' END AS origin FROM b)
SELECT origin, count(*) AS n, {rd("100 * count(*) / (SELECT count(*) FROM t)")} AS pct FROM t GROUP BY origin""")
def renewal(spark, sf):
    # the given tables have no listing in both snapshots, so the day stands in for a surviving key
    o = orders(spark, sf)
    a, b = o.where("snapshot = 'A'"), o.where("snapshot = 'B'")
    return rounded(panel.renewal(b, a.where("long_stay").select("day"), a.select("host_id"), "day", "host_id"))


@query("staying_hosts", f"""WITH {ORD}, a AS (SELECT DISTINCT host_id FROM ord WHERE snapshot = 'A')
SELECT count(*) FILTER (WHERE host_id IN (SELECT host_id FROM ord WHERE snapshot = 'B')) AS n, count(*) AS "of",
  {rd("100.0 * count(*) FILTER (WHERE host_id IN (SELECT host_id FROM ord WHERE snapshot = 'B')) / count(*)")} AS pct FROM a""")
def staying_hosts(spark, sf):
    o = orders(spark, sf)
    return rounded(panel.staying_hosts(o.where("snapshot = 'A'"), o.where("snapshot = 'B'"), "host_id"))


@query("key_sets", f"""WITH {ORD}, a AS (SELECT host_id FROM ord WHERE snapshot = 'A'), b AS (SELECT host_id FROM ord WHERE snapshot = 'B')
SELECT 'both' AS part, host_id FROM (SELECT host_id FROM a INTERSECT SELECT host_id FROM b)
UNION ALL SELECT 'only_a', host_id FROM (SELECT host_id FROM a EXCEPT SELECT host_id FROM b)
UNION ALL SELECT 'any', host_id FROM (SELECT host_id FROM a UNION SELECT host_id FROM b)""")
def key_sets(spark, sf):
    o = orders(spark, sf)
    a, b = (o.where(F.col("snapshot") == s).select("host_id") for s in PERIODS)
    parts = {"both": panel.key_intersection(a, b), "only_a": panel.key_difference(a, b),
             "any": panel.ids_union(a, b)}
    tables = [t.select(F.lit(n).alias("part"), "host_id") for n, t in parts.items()]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@query("column_agreement", f"""WITH j AS (
  SELECT o_totalprice AS p, s.total AS t, o_orderstatus AS st, s.status AS ss FROM orders
  JOIN (SELECT l_orderkey, sum(l_extendedprice) AS total, min(l_linestatus) AS status FROM lineitem GROUP BY l_orderkey) s
    ON o_orderkey = s.l_orderkey)
SELECT 'price' AS "column", count(*) AS n, count(*) FILTER (WHERE abs(p - t) <= 1e-8 + 1e-5 * abs(t)) AS equal,
  {rd("count(*) FILTER (WHERE abs(p - t) <= 1e-8 + 1e-5 * abs(t)) / count(*)")} AS share FROM j
UNION ALL SELECT 'status', count(*), count(*) FILTER (WHERE st = ss), {rd("count(*) FILTER (WHERE st = ss) / count(*)")} FROM j""")
def column_agreement(spark, sf):
    a = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"),
                                         F.col("o_orderstatus").alias("status"))
    b = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sum("l_extendedprice").alias("total"), F.min("l_linestatus").alias("line"))
    return rounded(panel.column_agreement(a, b, "id", {"price": "total", "status": "line"}))


@query("snapshot_stack", f"""WITH {ORD}
SELECT source, room_type, count(*) AS n, {rd("sum(price)", 2)} AS total FROM (
  SELECT 'A' AS source, room_type, price FROM ord WHERE snapshot = 'A'
  UNION ALL SELECT 'B', room_type, price FROM ord WHERE snapshot = 'B') GROUP BY ALL""")
def snapshot_stack(spark, sf):
    o = orders(spark, sf)
    a = o.where("snapshot = 'A'").withColumn("source", F.lit("A"))
    b = o.where("snapshot = 'B'").withColumn("source", F.lit("B")).withColumnRenamed("price", "amount")
    both = panel.stack_snapshots(a, b, ["source", "room_type", "price"], {"amount": "price"})
    return both.groupBy("source", "room_type").agg(F.count(F.lit(1)).alias("n"), r(F.sum("price"), 2).alias("total"))


@query("survival_rates", f"""WITH {LST}, l AS (SELECT *, CASE WHEN snapshot = 'B' THEN 1.0 ELSE 0.0 END AS f FROM lst)
SELECT dimension, label, {rd("avg(f)")} AS rate, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'district' AS dimension, district AS label, f FROM l
  UNION ALL SELECT 'room_type', room_type, f FROM l
  UNION ALL SELECT 'long_stay', CASE WHEN long_stay THEN 'true' ELSE 'false' END, f FROM l
  UNION ALL SELECT 'band', CASE WHEN balance <= 0 THEN '≤ 0' WHEN balance <= 5000 THEN '0–5k' ELSE '5k+' END, f FROM l)
GROUP BY ALL""")
def survival_rates(spark, sf):
    l = listings(spark, sf).withColumn("in_b", F.col("snapshot") == "B")
    band = S.bucket("balance", [None, 0, 5000, None], ["≤ 0", "0–5k", "5k+"])
    return rounded(panel.rates(l, ["district", "room_type", "long_stay", {"band": band}], "in_b"))


@query("attributable_fraction", f"""WITH {ORD}, m AS (
  SELECT count(*) FILTER (WHERE NOT long_stay) AS ne, count(*) FILTER (WHERE long_stay) AS nc,
         avg(CASE WHEN room_type = 'F' THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT long_stay) AS se,
         avg(CASE WHEN room_type = 'F' THEN 1.0 ELSE 0.0 END) FILTER (WHERE long_stay) AS sc FROM ord)
SELECT ne AS n_exposed, nc AS n_control, {rd("se")} AS survival_exposed, {rd("sc")} AS survival_control,
  {rd("100 * (sc - se)")} AS difference_pp, {rd("ne * (1 - se) + nc * (1 - sc)")} AS losses,
  {rd("ne * greatest(0, sc - se)")} AS saved,
  {rd("100 * ne * greatest(0, sc - se) / (ne * (1 - se) + nc * (1 - sc))")} AS fraction_pct FROM m""")
def attributable_fraction(spark, sf):
    return rounded(panel.attributable_fraction(orders(spark, sf), ~F.col("long_stay"), F.col("room_type") == "F"))

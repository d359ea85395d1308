"""The whole first slice in one query: contract, quarantine, strata, decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.operators import panel, quarantine as Q
from rentgrid.plans.market import PERIODS, TAGGED, order_rules, tagged_orders
from rentgrid.plans.registry import query, rounded
from rentgrid.plans.tables import rd
from rentgrid.session import shared_table

SQL = f"""WITH {TAGGED}, ok AS (SELECT * FROM hit WHERE h = 0), c AS (
  SELECT stratum, room_type, count(*) FILTER (WHERE snapshot = 'A') AS n_a,
         count(*) FILTER (WHERE snapshot = 'B') AS n_b,
         avg(lp) FILTER (WHERE snapshot = 'A') AS mean_a, avg(lp) FILTER (WHERE snapshot = 'B') AS mean_b,
         median(price) FILTER (WHERE snapshot = 'A') AS price_a, median(price) FILTER (WHERE snapshot = 'B') AS price_b
  FROM ok GROUP BY ALL),
w AS (SELECT *, n_a / (SELECT sum(n_a) FROM c) AS wa, n_b / (SELECT sum(n_b) FROM c) AS wb FROM c)
SELECT stratum, room_type, n_a, n_b, {rd("price_a")} AS price_a, {rd("price_b")} AS price_b,
  {rd("(wb - wa) * mean_a")} AS composition, {rd("wb * (mean_b - mean_a)")} AS within FROM w"""


@query("market_change", SQL)
def market_change(spark, sf) -> DataFrame:
    strata = ["stratum", "room_type"]
    # written once: means and medians are several passes over these rows
    priced = shared_table(Q.kept(tagged_orders(spark, sf)).where("preco_valido").select(*strata, "snapshot", "price", "lp"), "priced-orders")
    parts = panel.shift_share(priced, strata, "snapshot", PERIODS, F.col("lp"))
    levels = panel.compare_by(priced, strata, "snapshot", PERIODS, "price", F.lit(True), {})
    return rounded(parts.select(*strata, "n_a", "n_b", "composition", "within")
                   .join(levels.select(*strata, "price_a", "price_b"), strata))

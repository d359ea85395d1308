"""Rank tests, shift, folds, baselines and conformal intervals over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentgrid.operators import panel, ranks, stats, validation as V
from rentgrid.plans.audits import rank_sql
from rentgrid.plans.registry import query, read, rounded
from rentgrid.session import cut_lineage
from rentgrid.plans.tables import LST, ORD, listings, orders, rd


KRUSKAL = f"""WITH r AS (SELECT l_returnflag AS g, l_extendedprice AS v, {rank_sql('l_extendedprice')} AS rk FROM lineitem),
s AS (SELECT count(*) AS n, sum(rk) AS rs FROM r GROUP BY g),
t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY v)),
h AS (SELECT CAST(sum(n) AS DOUBLE) AS n, count(*) AS k, sum(rs * rs / n) AS s FROM s)
SELECT {rd("(12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n))")} AS H, CAST(n AS BIGINT) AS n, k,
  {rd("(12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) * (n + 1) / (n * n - 1)")} AS epsilon2{{p}} FROM h, t"""


@query("kruskal", KRUSKAL.format(p=""))
def kruskal(spark, sf):
    return rounded(stats.kruskal(read(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", p_value=False))


# with two degrees of freedom the chi-squared tail is exp(-H / 2)
@query("kruskal_p", KRUSKAL.format(p=f""", {rd("exp(-(12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) / 2)")} AS p"""))
def kruskal_p(spark, sf):
    return rounded(stats.kruskal(read(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag"))


@query("mann_whitney_pairs", f"""WITH v AS (SELECT l_returnflag AS g, l_quantity AS v, CAST(count(*) AS DOUBLE) AS c FROM lineitem GROUP BY ALL),
p AS (SELECT x.g AS a, y.g AS b, sum(CASE WHEN x.v > y.v THEN x.c * y.c WHEN x.v = y.v THEN x.c * y.c / 2 ELSE 0 END) AS U
  FROM v x JOIN v y ON x.g < y.g GROUP BY ALL),
s AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, median(v) AS m FROM (SELECT l_returnflag AS g, l_quantity AS v FROM lineitem) GROUP BY g),
t AS (SELECT a, b, sum(c * c * c - c) AS ties FROM (
  SELECT p.a, p.b, v.v, sum(v.c) AS c FROM p JOIN v ON v.g IN (p.a, p.b) GROUP BY ALL) GROUP BY ALL),
j AS (SELECT p.*, sa.n AS na, sb.n AS nb, sa.m AS ma, sb.m AS mb, ties FROM p JOIN s sa ON sa.g = a JOIN s sb ON sb.g = b JOIN t USING (a, b))
SELECT a, b, {rd("U", 1)} AS U, {rd("2 * U / (na * nb) - 1")} AS rank_biserial, {rd("ma")} AS median_a, {rd("mb")} AS median_b,
  {rd("(greatest(U, na * nb - U) - na * nb / 2 - 0.5) / sqrt(na * nb / 12 * ((na + nb + 1) - ties / ((na + nb) * (na + nb - 1))))")} AS z FROM j""")
def mann_whitney_pairs(spark, sf):
    return rounded(stats.mann_whitney_pairs(read(spark, sf, "lineitem"), "l_quantity", "l_returnflag", p_value=False))


@query("mann_whitney_holm")
def mann_whitney_holm(spark, sf):
    return rounded(stats.mann_whitney_pairs(read(spark, sf, "part"), "p_retailprice", "p_brand"))


@query("spearman", f"""WITH r AS (SELECT l_quantity AS a, l_extendedprice AS b, {rank_sql('l_quantity')} AS ra, {rank_sql('l_extendedprice')} AS rb FROM lineitem)
SELECT count(*) AS n, {rd("corr(a, b)")} AS pearson, {rd("corr(ra, rb)")} AS spearman FROM r""")
def spearman(spark, sf):
    return rounded(panel.spearman(read(spark, sf, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice")))


@query("average_ranks", f"""WITH r AS (SELECT event_type, value, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rk FROM events)
SELECT event_type, value, count(*) AS c, {rd("any_value(rk)", 1)} AS rank FROM r GROUP BY event_type, value""")
def average_ranks(spark, sf):
    return ranks.average_ranks(read(spark, sf, "events"), ["event_type"], "value").select(
        "event_type", F.col("_v").alias("value"), "c", "rank")


@query("group_quantiles", f"""SELECT event_type, count(value) AS value_n, {rd("quantile_cont(value, 0.1)")} AS value_p10,
  {rd("quantile_cont(value, 0.5)")} AS value_p50, {rd("quantile_cont(value, 0.975)")} AS value_p97_5,
  count(*) AS log_n, {rd("quantile_cont(ln(1 + value), 0.1)")} AS log_p10,
  {rd("quantile_cont(ln(1 + value), 0.5)")} AS log_p50, {rd("quantile_cont(ln(1 + value), 0.975)")} AS log_p97_5
FROM events GROUP BY event_type""")
def group_quantiles(spark, sf):
    return rounded(ranks.quantiles(read(spark, sf, "events"), ["event_type"],
                                   {"value": F.col("value"), "log": F.log(1 + F.col("value"))},
                                   [0.1, 0.5, 0.975]))


def eta_sql(label: str, value: str, group: str, source: str) -> str:
    return f"""SELECT '{label}' AS value, CAST(sum(n) AS BIGINT) AS n, {rd("sum(n * power(m - g, 2)) / sum(n * power(m - g, 2) + n * v)")} AS eta2
  FROM (SELECT count({value}) AS n, avg({value}) AS m, var_pop({value}) AS v FROM {source} GROUP BY {group}),
       (SELECT avg({value}) AS g FROM {source})"""


@query("redundancy", " UNION ALL ".join(eta_sql(c, c, "l_suppkey", "lineitem")
                                        for c in ("l_quantity", "l_extendedprice", "l_discount")))
def redundancy(spark, sf):
    return rounded(stats.redundancy(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], "l_suppkey"))


@query("variance_table", f"""WITH {LST}, p AS (SELECT *, avg(lp) OVER (PARTITION BY stratum) AS pred FROM lst)
SELECT source, kind, {rd("explained")} AS explained FROM (
  SELECT 'district' AS source, 'eta2' AS kind, eta2 AS explained FROM ({eta_sql('x', 'lp', 'district', 'p')})
  UNION ALL SELECT 'neighbourhood', 'eta2', eta2 FROM ({eta_sql('x', 'lp', 'neighbourhood', 'p')})
  UNION ALL SELECT 'stratum_mean', 'r2', 1 - avg(power(lp - pred, 2)) / var_pop(lp) FROM p)""")
def variance_table(spark, sf):
    rows = panel.group_mean(listings(spark, sf), ["stratum"], "lp", "pred")
    return rounded(stats.variance_table(rows, "lp", {"district": "district", "neighbourhood": "neighbourhood"},
                                        {"stratum_mean": "pred"}))


def psi_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", {rd("sum((pb - pa) * ln(pb / pa))")} AS psi FROM (
  SELECT greatest(sum(CASE WHEN isa THEN 1.0 ELSE 0 END) / (SELECT count(*) FROM x WHERE isa), CAST(0.0001 AS DOUBLE)) AS pa,
         greatest(sum(CASE WHEN NOT isa THEN 1.0 ELSE 0 END) / (SELECT count(*) FROM x WHERE NOT isa), CAST(0.0001 AS DOUBLE)) AS pb
  FROM (SELECT isa, len(list_filter(e[2:len(e) - 1], lambda k: k <= {c})) AS bin FROM x,
        (SELECT list_sort(list_distinct(quantile_cont({c}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM x WHERE isa))
  GROUP BY bin)"""


@query("psi_table", f"""WITH x AS (SELECT o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AS isa, l_quantity, l_extendedprice, l_tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) """ + " UNION ALL ".join(
    psi_sql(c) for c in ("l_quantity", "l_extendedprice", "l_tax")))
def psi_table(spark, sf):
    rows = read(spark, sf, "lineitem").join(orders(spark, sf).select(F.col("id").alias("l_orderkey"), "snapshot"), "l_orderkey")
    return rounded(stats.psi_table(rows.where("snapshot = 'A'"), rows.where("snapshot = 'B'"),
                                   ["l_quantity", "l_extendedprice", "l_tax"]))


@query("bh_reject", """WITH p AS (SELECT p_partkey, power(p_size / CAST(50 AS DOUBLE), 4) / 4 AS p FROM part),
k AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r, count(*) OVER () AS n FROM p)
SELECT p_partkey, coalesce(p <= (SELECT max(p) FROM k WHERE p <= CAST(0.05 AS DOUBLE) * r / n), false) AS reject FROM p""")
def bh_reject(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", (F.pow(F.col("p_size") / F.lit(50.0), 4) / 4).alias("p"))
    return stats.bh_reject(p, "p", 0.05).select("p_partkey", "reject")


@query("holm", f"""WITH p AS (SELECT c_nationkey, c_mktsegment, count(*) / CAST(1000 AS DOUBLE) AS p FROM customer GROUP BY ALL),
k AS (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) - row_number() OVER (PARTITION BY c_mktsegment ORDER BY p) + 1 AS l FROM p)
SELECT c_nationkey, c_mktsegment, {rd("max(least(1, l * p)) OVER (PARTITION BY c_mktsegment ORDER BY p)")} AS p_holm FROM k""")
def holm(spark, sf):
    tests = read(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(
        (F.count(F.lit(1)) / F.lit(1000.0)).alias("p"))
    return rounded(stats.holm(tests, "p", ["c_mktsegment"]).select("c_nationkey", "c_mktsegment", "p_holm"))


@query("calibration", f"""WITH x AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, l_quantity / CAST(50 AS DOUBLE) AS p FROM lineitem),
e AS (SELECT list_sort(list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM x)
SELECT CAST(bin AS INTEGER) AS bin, {rd("avg(p)")} AS predicted, {rd("avg(y)")} AS observed, count(*) AS n FROM (
  SELECT y, p, len(list_filter(e[2:len(e) - 1], lambda k: k < p)) AS bin FROM x, e) GROUP BY bin""")
def calibration(spark, sf):
    x = read(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"),
                                           (F.col("l_quantity") / F.lit(50.0)).alias("p"))
    return rounded(stats.calibration(x, "y", "p"))


# --- folds and conformal ---------------------------------------------------------------

def folded(spark, sf):
    rows = listings(spark, sf).select("id", "lp", "room_type", "neighbourhood", "district", "area_id", "long_stay", "snapshot", "host_id")
    return V.block_folds(rows, "area_id", order_by=(F.col("area_id") * 7) % 25)


FOLDED = f"""{LST}, blk AS (SELECT area_id, row_number() OVER (ORDER BY (area_id * 7) % 25) - 1 AS idx, count(*) OVER () AS n
  FROM (SELECT DISTINCT area_id FROM lst)),
fld AS (SELECT area_id, CAST(CASE WHEN idx < (n % 5) * (n // 5 + 1) THEN idx // (n // 5 + 1)
  ELSE n % 5 + (idx - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM blk),
f AS (SELECT lst.*, fld.fold FROM lst JOIN fld USING (area_id))"""


@query("block_folds", f"WITH {FOLDED} SELECT area_id, fold, count(*) AS n FROM f GROUP BY ALL")
def block_folds(spark, sf):
    return folded(spark, sf).groupBy("area_id", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("shared_blocks", "SELECT CAST(0 AS BIGINT) AS shared, count(DISTINCT c_nationkey) AS blocks FROM customer JOIN orders ON c_custkey = o_custkey")
def shared_blocks(spark, sf):
    return V.shared_blocks(V.block_folds(listings(spark, sf), "area_id"), "area_id")


@query("random_folds", "SELECT (('0x' || md5(o_orderkey || ':42')[1:8])::BIGINT % 5)::INTEGER AS fold, count(*) AS n FROM orders GROUP BY 1")
def random_folds(spark, sf):
    return V.random_folds(orders(spark, sf), "id").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


BASE = f"""{FOLDED}, base AS (SELECT f.id, f.fold, f.lp, f.room_type, f.district, f.long_stay,
  coalesce((SELECT median(g.lp) FROM f g WHERE g.fold <> f.fold AND g.district = f.district AND g.room_type = f.room_type),
           (SELECT median(g.lp) FROM f g WHERE g.fold <> f.fold AND g.room_type = f.room_type),
           (SELECT median(g.lp) FROM f g WHERE g.fold <> f.fold)) AS prediction FROM f)"""


def baseline(spark, sf):
    """The out-of-fold table, written once: every report reads it several times."""
    return cut_lineage(V.median_baseline(folded(spark, sf), "lp", "fold", [["district", "room_type"], ["room_type"]]))


KEYED = f"""{FOLDED}, ks AS (SELECT unnest(range(5)) AS k), m2 AS (SELECT k, district, room_type, median(lp) AS m FROM f, ks WHERE fold <> k GROUP BY ALL),
m1 AS (SELECT k, room_type, median(lp) AS m FROM f, ks WHERE fold <> k GROUP BY ALL),
m0 AS (SELECT k, median(lp) AS m FROM f, ks WHERE fold <> k GROUP BY ALL),
base AS (SELECT f.*, coalesce(m2.m, m1.m, m0.m) AS prediction, f.lp - coalesce(m2.m, m1.m, m0.m) AS res FROM f
  LEFT JOIN m2 ON m2.k = f.fold AND m2.district = f.district AND m2.room_type = f.room_type
  LEFT JOIN m1 ON m1.k = f.fold AND m1.room_type = f.room_type JOIN m0 ON m0.k = f.fold)"""


@query("median_baseline", f"WITH {KEYED} SELECT fold, district, room_type, count(*) AS n, {rd('max(prediction)')} AS prediction FROM base GROUP BY ALL")
def median_baseline(spark, sf):
    return rounded(baseline(spark, sf).groupBy("fold", "district", "room_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("prediction").alias("prediction")))


METRICS = f"""count(*) AS n, {rd("avg(abs(exp(prediction) - exp(lp)))", 4)} AS mae, {rd("sqrt(avg(power(lp - prediction, 2)))")} AS rmse_log,
  {rd("1 - sum(power(lp - prediction, 2)) / (var_pop(lp) * count(*))")} AS r2_log, {rd("avg(lp - prediction)")} AS bias_log,
  {rd("median(abs(exp(prediction) - exp(lp)))", 4)} AS mdae, {rd("median(abs(exp(prediction) - exp(lp)) / exp(lp))")} AS mdape"""


def metric_digits(df):
    return df.select(*[(F.round(c, 4) if c in ("mae", "mdae") else F.round(c, 6) + F.lit(0.0)).alias(c)
                       if t == "double" else F.col(c) for c, t in df.dtypes])


@query("price_metrics", f"WITH {KEYED} SELECT {METRICS} FROM base")
def price_metrics(spark, sf):
    return metric_digits(V.price_metrics(baseline(spark, sf), "lp", "prediction"))


@query("price_metrics_by_fold", f"WITH {KEYED} SELECT fold, {METRICS} FROM base GROUP BY fold")
def price_metrics_by_fold(spark, sf):
    return metric_digits(V.price_metrics(baseline(spark, sf), "lp", "prediction", ["fold"]))


@query("metrics_by_slices", f"""WITH {KEYED}, t AS (SELECT lp, prediction, 'room_type' AS dimension, room_type AS slice FROM base
  UNION ALL SELECT lp, prediction, 'district', district FROM base
  UNION ALL SELECT lp, prediction, 'long_stay', CASE WHEN long_stay THEN 'true' ELSE 'false' END FROM base)
SELECT dimension, slice, {METRICS} FROM t GROUP BY ALL HAVING count(*) >= 100""")
def metrics_by_slices(spark, sf):
    return metric_digits(V.metrics_by_slices(baseline(spark, sf), "lp", "prediction", ["room_type", "district", "long_stay"]))


LOW, HIGH = repr((1 - 0.8) / 2), repr(1 - (1 - 0.8) / 2)


def conf(n: str, source: str, keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""{n} AS (SELECT {lead}any_value(n) AS n,
  max(res) FILTER (WHERE i = greatest(0, floor((n + 1) * CAST({LOW} AS DOUBLE)) - 1)) AS q_low,
  max(res) FILTER (WHERE i = least(n - 1, ceil((n + 1) * CAST({HIGH} AS DOUBLE)) - 1)) AS q_high
  FROM (SELECT *, row_number() OVER ({part} ORDER BY res) - 1 AS i, count(*) OVER ({part}) AS n FROM {source}) {group})"""


def residuals(spark, sf):
    return baseline(spark, sf).withColumn("res", F.col("lp") - F.col("prediction"))


@query("conformal_quantiles", f"WITH {KEYED}, {conf('q', 'base', 'room_type')} SELECT room_type, n, {rd('q_low')} AS q_low, {rd('q_high')} AS q_high FROM q")
def conformal_quantiles(spark, sf):
    return rounded(V.conformal_quantiles(residuals(spark, sf), "res", 0.8, ["room_type"]))


@query("honest_coverage", f"""WITH {KEYED}, cal AS (SELECT k, res FROM base, ks WHERE fold <> k), {conf('q', 'cal', 'k')}
SELECT district, count(*) AS n, {rd("avg(CASE WHEN res BETWEEN q_low AND q_high THEN 1.0 ELSE 0.0 END)")} AS coverage,
  {rd("avg(q_high - q_low)")} AS mean_width_log, {rd("avg(exp(q_high - q_low))")} AS mean_ratio
FROM base JOIN q ON base.fold = q.k GROUP BY district""")
def honest_coverage(spark, sf):
    return rounded(V.honest_coverage(residuals(spark, sf), "res", "fold", 0.8, by=["district"]))


@query("mondrian_quantiles", f"""WITH {KEYED}, {conf('q', 'base', 'neighbourhood')}, {conf('g', 'base', '')}
SELECT neighbourhood, q.n, {rd("CASE WHEN q.n >= 600 THEN q.q_low ELSE g.q_low END")} AS q_low,
  {rd("CASE WHEN q.n >= 600 THEN q.q_high ELSE g.q_high END")} AS q_high FROM q, g""")
def mondrian_quantiles(spark, sf):
    return rounded(V.mondrian_quantiles(residuals(spark, sf), "res", "neighbourhood", 0.8, min_n=600))


@query("mondrian_coverage", f"""WITH {KEYED}, cal AS (SELECT k, room_type, res FROM base, ks WHERE fold <> k),
{conf('q', 'cal', 'k, room_type')}, {conf('g', 'cal', 'k')},
b AS (SELECT base.room_type, res, CASE WHEN q.n >= 4000 THEN q.q_low ELSE g.q_low END AS lo,
  CASE WHEN q.n >= 4000 THEN q.q_high ELSE g.q_high END AS hi
  FROM base JOIN g ON g.k = fold LEFT JOIN q ON q.k = fold AND q.room_type = base.room_type)
SELECT room_type, count(*) AS n, {rd("avg(CASE WHEN res BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END)")} AS coverage,
  {rd("avg(hi - lo)")} AS mean_width_log, {rd("avg(exp(hi - lo))")} AS mean_ratio FROM b GROUP BY room_type""")
def mondrian_coverage(spark, sf):
    return rounded(V.mondrian_coverage(residuals(spark, sf), "res", "fold", "room_type", 0.8, min_n=4000, by=["room_type"]))


@query("class_metrics", f"""WITH x AS (SELECT l_linestatus AS g, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, l_quantity / CAST(50 AS DOUBLE) AS p FROM lineitem),
v AS (SELECT g, p, sum(y) AS pos, sum(1 - y) AS neg FROM x GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER (PARTITION BY g) AS tp, sum(neg) OVER (PARTITION BY g) AS tn,
  sum(pos) OVER w - pos AS pb, sum(neg) OVER w - neg AS nb FROM v WINDOW w AS (PARTITION BY g ORDER BY p)),
s AS (SELECT g, CAST(sum(pos * (nb + neg / 2)) AS DOUBLE) / max(tp * tn) AS auc,
  sum(pos * CAST(tp - pb AS DOUBLE) / (tp - pb + tn - nb)) / max(tp) AS ap FROM c GROUP BY g)
SELECT x.g, count(*) AS n, {rd("avg(y)")} AS prevalence, {rd("avg(power(p - y, 2))")} AS brier, {rd("avg(y) * (1 - avg(y))")} AS brier_baseline,
  {rd("any_value(auc)")} AS auc, {rd("any_value(ap)")} AS pr_auc FROM x JOIN s USING (g) GROUP BY x.g""")
def class_metrics(spark, sf):
    x = read(spark, sf, "lineitem").select(F.col("l_linestatus").alias("g"), (F.col("l_returnflag") == "R").cast("double").alias("y"),
                                           (F.col("l_quantity") / F.lit(50.0)).alias("p"))
    return rounded(V.class_metrics(x, "y", "p", ["g"]))


@query("nights_baseline", f"""WITH {FOLDED}, ks AS (SELECT unnest(range(5)) AS k),
m3 AS (SELECT k, neighbourhood, room_type, long_stay, median(lp) AS m FROM f, ks WHERE fold <> k GROUP BY ALL),
m2 AS (SELECT k, room_type, long_stay, median(lp) AS m FROM f, ks WHERE fold <> k GROUP BY ALL)
SELECT fold, room_type, long_stay, {rd("avg(coalesce(m3.m, m2.m))")} AS prediction FROM f
LEFT JOIN m3 ON m3.k = fold AND m3.neighbourhood = f.neighbourhood AND m3.room_type = f.room_type AND m3.long_stay = f.long_stay
JOIN m2 ON m2.k = fold AND m2.room_type = f.room_type AND m2.long_stay = f.long_stay GROUP BY fold, f.room_type, f.long_stay""".replace(
    "SELECT fold, room_type, long_stay,", "SELECT fold, f.room_type, f.long_stay,"))
def nights_baseline(spark, sf):
    ladder = [["neighbourhood", "room_type", "long_stay"], ["room_type", "long_stay"]]
    return rounded(V.median_baseline(folded(spark, sf), "lp", "fold", ladder).groupBy("fold", "room_type", "long_stay").agg(
        F.avg("prediction").alias("prediction")))


NIGHTS = f"""x AS (SELECT least(l_quantity * 6, 255) AS y, least(l_extendedprice / 200, CAST(255 AS DOUBLE)) AS p FROM lineitem),
xr AS (SELECT y, p, {rank_sql('y')} AS ry, {rank_sql('p')} AS rp FROM x)"""


@query("nights_metrics", f"""WITH {NIGHTS}
SELECT count(*) AS n, {rd("avg(abs(p - y))")} AS mae, {rd("corr(ry, rp)")} AS spearman, {rd("avg(y)")} AS mean_observed,
  {rd("avg(p)")} AS mean_predicted, {rd("avg(CASE WHEN y >= 255 THEN 1.0 ELSE 0.0 END)")} AS share_at_cap, {rd("median(abs(p - y))")} AS mdae FROM xr""")
def nights_metrics(spark, sf):
    x = read(spark, sf, "lineitem").select(F.least(F.col("l_quantity") * 6, F.lit(255.0)).alias("y"),
                                           (F.col("l_extendedprice") / 200).alias("p"))
    return rounded(V.nights_metrics(x, "y", "p"))


@query("revenue_metrics", f"""WITH r AS (SELECT l_extendedprice AS o, l_quantity * 1000 AS p, {rank_sql('l_extendedprice')} AS ro, {rank_sql('l_quantity')} AS rp FROM lineitem)
SELECT {rd("median(o)")} AS median_observed, {rd("median(p)")} AS median_predicted, count(*) AS n, {rd("corr(ro, rp)")} AS spearman FROM r""")
def revenue_metrics(spark, sf):
    return rounded(V.revenue_metrics(read(spark, sf, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity") * 1000))

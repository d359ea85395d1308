"""Quality reports over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentgrid.functions import constants as K
from rentgrid.functions import scalars as S
from rentgrid.operators import audit
from rentgrid.plans.registry import query, read, rounded
from rentgrid.plans.tables import ORD, listings, orders, rd


@query("audit_duplicates", """
WITH c AS (
  SELECT 'id' AS "check", count(*) AS s FROM lineitem GROUP BY l_orderkey, l_linenumber
  UNION ALL SELECT 'host_point', count(*) FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT 'host_point_price', count(*) FROM lineitem GROUP BY l_suppkey, l_partkey, l_discount)
SELECT "check", count(*) AS distinct_keys, count(*) FILTER (WHERE s > 1) AS repeated_keys,
  CAST(coalesce(sum(s) FILTER (WHERE s > 1), 0) AS BIGINT) AS rows_in_groups,
  coalesce(max(s) FILTER (WHERE s > 1), 0) AS largest, CAST(sum(s - 1) AS BIGINT) AS extra_rows
FROM c GROUP BY "check\"""")
def audit_duplicates(spark, sf):
    return audit.audit_duplicates(read(spark, sf, "lineitem"), {
        "id": ["l_orderkey", "l_linenumber"], "host_point": ["l_suppkey", "l_partkey"],
        "host_point_price": ["l_suppkey", "l_partkey", "l_discount"]})


def sparse_lines(spark, sf):
    return read(spark, sf, "lineitem").select(
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("last_review"),
        F.when(F.col("l_discount") > 0, F.col("l_quantity")).alias("rate"), F.col("l_tax"),
        F.lit(None).cast("string").alias("host_since"))


@query("audit_nulls", """
WITH l AS (SELECT nullif(l_tax, 0) AS a, CASE WHEN l_discount > 0 THEN l_quantity END AS b FROM lineitem)
SELECT "column", nulls, all_null FROM (
  SELECT 'last_review' AS "column", count(*) FILTER (WHERE a IS NULL) AS nulls, false AS all_null FROM l
  UNION ALL SELECT 'rate', count(*) FILTER (WHERE b IS NULL), false FROM l
  UNION ALL SELECT 'host_since', count(*), true FROM l) WHERE nulls > 0""")
def audit_nulls(spark, sf):
    return audit.audit_nulls(sparse_lines(spark, sf))


@query("structural_nulls", """
WITH l AS (SELECT nullif(l_tax, 0) AS a, CASE WHEN l_discount > 0 THEN l_quantity END AS b, l_tax = 0 AS e FROM lineitem),
u AS (SELECT 'last_review' AS c, a IS NULL AS nul, e FROM l UNION ALL SELECT 'rate', b IS NULL, e FROM l)
SELECT c AS "column", count(*) FILTER (WHERE nul) AS nulls, count(*) FILTER (WHERE nul AND e) AS null_and_empty,
  count(*) FILTER (WHERE nul AND NOT e) AS null_not_empty, count(*) FILTER (WHERE NOT nul AND e) AS filled_and_empty,
  count(*) FILTER (WHERE nul AND NOT e) = 0 AND count(*) FILTER (WHERE NOT nul AND e) = 0 AS structural
FROM u GROUP BY c""")
def structural_nulls(spark, sf):
    return audit.structural_nulls(sparse_lines(spark, sf), ["last_review", "rate"], F.col("l_tax") == 0)


@query("audit_identity", f"""
WITH p AS (SELECT p_partkey AS id, p_name AS name, count(*) AS n FROM part GROUP BY ALL),
i AS (SELECT id, count(DISTINCT name) AS names FROM p GROUP BY id),
n AS (SELECT name, count(DISTINCT id) AS ids, sum(n) AS n_rows FROM p GROUP BY name)
SELECT (SELECT count(*) FILTER (WHERE names > 1) FROM i) AS ids_with_many_names, (SELECT count(*) FROM i) AS ids,
  count(*) AS names, count(*) FILTER (WHERE ids > 1) AS shared_names,
  {rd("avg(CASE WHEN ids > 1 THEN 1.0 ELSE 0.0 END)")} AS shared_name_share,
  CAST(coalesce(sum(n_rows) FILTER (WHERE ids > 1), 0) AS BIGINT) AS rows_with_shared_name,
  max(ids) AS most_ids_of_a_name, {rd("median(ids)")} AS median_ids_of_a_name FROM n""")
def audit_identity(spark, sf):
    return rounded(audit.audit_identity(read(spark, sf, "part"), "p_partkey", "p_name"))


def skew_sql(c: str) -> str:
    return (f"(SELECT avg(power({c} - m, 3)) / power(avg(power({c} - m, 2)), 1.5) "
            f"FROM lineitem, (SELECT avg({c}) AS m FROM lineitem))")


@query("describe", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS n, {rd(f"avg({c})")} AS mean, {rd(f"min({c})")} AS min,
  {", ".join(f"{rd(f'quantile_cont({c}, {p / 100})')} AS p{p:02d}" for p in (1, 25, 50, 75, 99))},
  {rd(f"max({c})")} AS max, {rd(skew_sql(c))} AS skewness FROM lineitem"""
                                for c in ("l_quantity", "l_extendedprice", "l_discount")))
def describe(spark, sf):
    return rounded(audit.describe(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


def quoted_lines(spark, sf):
    l = read(spark, sf, "lineitem")
    return l.select(
        F.nullif(F.col("l_quantity"), F.lit(7.0)).alias("price"), (F.col("l_tax") > 0).alias("quoted"),
        (F.col("l_quantity") + F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("per_night"),
        F.col("l_extendedprice").alias("total"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("nights"),
        F.col("l_linenumber").alias("min_nights"), (F.col("l_partkey") % 3).alias("availability"),
        F.nullif(F.col("l_discount"), F.lit(0.1)).alias("discount"), (F.col("l_linenumber") >= 4).alias("long"))


QUOTED = """q AS (SELECT nullif(l_quantity, 7) AS price, l_tax > 0 AS quoted,
  l_quantity + CASE WHEN l_discount > CAST(0.05 AS DOUBLE) THEN 1 ELSE 0 END AS per_night, l_extendedprice AS total,
  floor(l_extendedprice / l_quantity / 100) AS nights, l_linenumber AS min_nights, l_partkey % 3 AS availability,
  nullif(l_discount, CAST(0.1 AS DOUBLE)) AS discount, l_linenumber >= 4 AS long FROM lineitem)"""

CHECKS_SQL = {
    "zero": "price = 0", "between_1_and_9": "price BETWEEN 1 AND 9", "equal_9999": "price = 9999",
    "equal_10000": "price = 10000", "above_1000": "price > 1000", "above_10000": "price > 10000",
    "below_10": "price < 10", "null": "price IS NULL", "null_without_quote": "price IS NULL AND NOT quoted",
    "null_with_quote": "price IS NULL AND quoted",
    "null_if_unavailable": "CASE WHEN availability = 0 THEN price IS NULL END",
    "null_if_available": "CASE WHEN availability <> 0 THEN price IS NULL END",
    "equals_per_night": "CASE WHEN price IS NOT NULL AND per_night IS NOT NULL THEN abs(price - per_night) <= 1e-8 + 1e-5 * abs(per_night) END",
    "total_is_price_times_nights": "CASE WHEN price IS NOT NULL AND nights > 0 AND total IS NOT NULL THEN abs(total - price * nights) <= 1e-8 + CAST(0.01 AS DOUBLE) * abs(price * nights) END",
    "nights_equal_minimum": "CASE WHEN nights IS NOT NULL THEN coalesce(nights = min_nights, false) END",
}


@query("audit_price", f"WITH {QUOTED} " + " UNION ALL ".join(
    f"""SELECT '{n}' AS "check", count(*) FILTER (WHERE {c}) AS n, count({c}) AS "of",
    {rd(f"count(*) FILTER (WHERE {c}) / nullif(count({c}), 0)")} AS share FROM q"""
    for n, c in CHECKS_SQL.items()))
def audit_price(spark, sf):
    c = F.col
    return rounded(audit.count_checks(quoted_lines(spark, sf), audit.price_checks(
        c("price"), c("quoted"), c("per_night"), c("total"), c("nights"), c("min_nights"), c("availability"))))


@query("price_by_night_band", f"""WITH {QUOTED}, b AS (SELECT *, CASE WHEN nights > 0 AND nights <= 27 THEN '1-27'
  WHEN nights > 27 AND nights <= 31 THEN '28-31' WHEN nights > 31 AND nights <= 60 THEN '32-60'
  WHEN nights > 60 AND nights <= 120 THEN '61-120' WHEN nights > 120 AND nights <= 366 THEN '121-365' END AS band FROM q)
SELECT band, count(*) AS n, {rd("median(price)")} AS price, {rd("median(total)")} AS total FROM b
WHERE band IS NOT NULL AND price IS NOT NULL AND total IS NOT NULL GROUP BY band""")
def price_by_night_band(spark, sf):
    return rounded(audit.medians_by_band(quoted_lines(spark, sf), "nights", K.QUOTE_NIGHT_BANDS,
                                         {"price": F.col("price"), "total": F.col("total")}))


@query("discount_report", f"""WITH {QUOTED}
SELECT count(*) AS n, count(*) FILTER (WHERE discount > 0) AS with_discount,
  {rd("avg(CASE WHEN discount > 0 THEN 1.0 ELSE 0.0 END)")} AS with_discount_share, {rd("max(discount)")} AS largest,
  {rd("median(discount) FILTER (WHERE NOT long)")} AS short_median,
  {rd("median(discount) FILTER (WHERE long)")} AS long_median,
  {rd("quantile_cont(discount, 0.9) FILTER (WHERE long)")} AS long_p90 FROM q WHERE discount IS NOT NULL""")
def discount_report(spark, sf):
    return rounded(audit.discount_report(quoted_lines(spark, sf), "discount", F.col("long")))


@query("rate_variation", f"""WITH h AS (
  SELECT l_returnflag, l_suppkey, l_partkey % 500 AS host, count(*) AS n, min(l_discount) AS lo, max(l_discount) AS hi
  FROM lineitem GROUP BY ALL HAVING count(*) >= 2)
SELECT l_returnflag, count(*) AS hosts, count(*) FILTER (WHERE lo = hi) AS constant,
  count(*) FILTER (WHERE lo <> hi) AS varying, {rd("avg(CASE WHEN lo <> hi THEN 1.0 ELSE 0.0 END)")} AS varying_share,
  {rd("median(hi - lo)")} AS median_range FROM h GROUP BY l_returnflag""")
def rate_variation(spark, sf):
    l = read(spark, sf, "lineitem").withColumn(
        "host", F.concat_ws("-", "l_suppkey", F.col("l_partkey") % 500))
    return rounded(audit.rate_variation(l, "host", "l_discount", ["l_returnflag"]))


@query("rate_checks", f"""WITH e AS (SELECT value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
SELECT 'above_total' AS "check", count(*) FILTER (WHERE value > k) AS n, count(*) AS "of", {rd("avg(CASE WHEN value > k THEN 1.0 ELSE 0.0 END)")} AS share FROM e
UNION ALL SELECT 'equal_total', count(*) FILTER (WHERE value = k), count(*), {rd("avg(CASE WHEN value = k THEN 1.0 ELSE 0.0 END)")} FROM e
UNION ALL SELECT 'above_30', count(*) FILTER (WHERE value > 30), count(*), {rd("avg(CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END)")} FROM e""")
def rate_checks(spark, sf):
    e = read(spark, sf, "events").select(
        "value", F.from_json("props", "k double")["k"].alias("k"))
    return rounded(audit.count_checks(e, audit.rate_checks(F.col("value"), F.col("k"))))


FIT = """f AS (SELECT l_quantity AS n, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days, l_discount * 100 AS p
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT p, n / (days / CAST(30.4375 AS DOUBLE)) AS naive, n / greatest(CAST(1 AS DOUBLE), (days + 1) / CAST(30 AS DOUBLE)) AS formula FROM f WHERE days <> 0),
g2 AS (SELECT p, n / greatest(CAST(1 AS DOUBLE), (days + 1) / CAST(30 AS DOUBLE)) AS formula FROM f)"""


@query("rate_formula_fit", f"""WITH {FIT}
SELECT 'naive' AS formula, count(*) AS n, {rd("corr(naive, p)")} AS pearson, {rd("avg(abs(naive - p))")} AS mae,
  count(*) FILTER (WHERE round_even(naive, 2) = p) AS equal_2_digits, count(*) FILTER (WHERE abs(naive - p) <= CAST(0.0101 AS DOUBLE)) AS within_0_01 FROM g
UNION ALL SELECT 'formula', count(*), {rd("corr(formula, p)")}, {rd("avg(abs(formula - p))")},
  count(*) FILTER (WHERE round_even(formula, 2) = p), count(*) FILTER (WHERE abs(formula - p) <= CAST(0.0101 AS DOUBLE)) FROM g2""")
def rate_formula_fit(spark, sf):
    rows = read(spark, sf, "lineitem").join(
        read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_quantity").alias("n"), F.col("o_orderdate").alias("first"), F.col("l_shipdate").alias("scraped"),
        (F.col("l_discount") * 100).alias("p"))
    return rounded(audit.rate_formula_fit(rows, "p", {
        "naive": S.naive_review_rate("n", "first", "scraped"), "formula": S.review_rate("n", "first", "scraped")}))


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rank_sql(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("corr_pairs", "WITH r AS (SELECT *, " + ", ".join(f"{rank_sql(c)} AS r_{c}" for c in NUMERIC) + " FROM lineitem) "
       + " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, {rd(f"corr({a}, {b})")} AS pearson, {rd(f"corr(r_{a}, r_{b})")} AS spearman,
    {rd(f"corr(r_{a}, r_{b}) - corr({a}, {b})")} AS difference FROM r"""
    for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]))
def corr_pairs(spark, sf):
    return rounded(audit.corr_pairs(read(spark, sf, "lineitem"), NUMERIC))


@query("replay_cleaning", """
WITH d AS (SELECT l_partkey, coalesce(nullif(l_tax, 0), 0) AS tax, l_quantity - 10 AS price,
    nullif(l_linestatus, 'O') AS name, count(*) AS copies FROM lineitem
  GROUP BY l_partkey, l_tax, l_quantity, l_linestatus)
SELECT CAST(sum(copies) AS BIGINT) AS n_in, CAST(sum(copies - 1) AS BIGINT) AS duplicates_removed,
  count(*) FILTER (WHERE price <= 0) AS price_removed, count(*) FILTER (WHERE price > 0 AND name IS NULL) AS null_removed,
  count(*) FILTER (WHERE price > 0 AND name IS NOT NULL) AS n_out FROM d""")
def replay_cleaning(spark, sf):
    rows = read(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", F.nullif(F.col("l_tax"), F.lit(0.0)).alias("tax"),
        (F.col("l_quantity") - 10).alias("price"), F.nullif(F.col("l_linestatus"), F.lit("O")).alias("name"))
    return audit.replay_cleaning(rows, ["l_orderkey"], {"tax": 0.0}, "price")


REFERENCE = "2024-01-31"
USERS = f"""per AS (SELECT user_id, count(*) AS n_events, max(CAST(ts AS DATE)) AS last FROM events GROUP BY user_id),
users AS (SELECT c_custkey AS user_id, c_nationkey + 1 AS min_nights, n_events / CAST(100 AS DOUBLE) AS rate,
    date_diff('day', last, DATE '{REFERENCE}') AS idle
  FROM customer LEFT JOIN per ON c_custkey = user_id)"""


def occ_sql(stay: str, windowed: bool) -> str:
    x = f"least(coalesce(rate, 0) / CAST(0.5 AS DOUBLE) * 12 * greatest(CAST({stay} AS DOUBLE), min_nights) / 365, CAST(0.7 AS DOUBLE))"
    return f"CASE WHEN coalesce(idle <= 1, false) THEN {x} ELSE CAST(0 AS DOUBLE) END" if windowed else x


def users(spark, sf):
    per = read(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.max(F.col("ts").cast("date")).alias("last"))
    base = read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"),
                                              (F.col("c_nationkey") + 1).alias("min_nights"))
    return base.join(per, "user_id", "left").select(
        "user_id", "min_nights", (F.col("n_events") / F.lit(100.0)).alias("rate"),
        S.days_since("last", F.lit(REFERENCE)).alias("idle"))


@query("ltm_validation", f"""WITH {USERS}, w AS (
  SELECT user_id, count(*) AS ltm FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-20' AND CAST(ts AS DATE) <= DATE '2024-01-30' GROUP BY user_id),
j AS (SELECT {occ_sql('6.4', True)} AS a,
  least(coalesce(ltm, 0) / CAST(0.5 AS DOUBLE) * greatest(CAST(6.4 AS DOUBLE), min_nights) / 365, CAST(0.7 AS DOUBLE)) AS b
  FROM users LEFT JOIN w USING (user_id)),
k AS (SELECT a, b, {rank_sql('a')} AS ra, {rank_sql('b')} AS rb FROM j)
SELECT count(*) AS n, {rd("avg(a)")} AS mean_a, {rd("avg(b)")} AS mean_b, {rd("corr(a, b)")} AS pearson,
  {rd("corr(ra, rb)")} AS spearman, {rd("avg(abs(a - b))")} AS mae FROM k""")
def ltm_validation(spark, sf):
    modelled = users(spark, sf).withColumn("model", S.occupancy_model("rate", "min_nights", "idle", window=1))
    return rounded(audit.ltm_validation(modelled, read(spark, sf, "events"), "user_id", "user_id", "ts",
                                        "2024-01-30", "model", "min_nights", days=10))


GRID = [("3.0", False), ("3.0", True), ("6.4", False), ("6.4", True)]


@query("occupancy_sensitivity", f"""WITH {USERS}, v AS (
  SELECT coalesce(rate, 0) AS obs, {", ".join(f"{occ_sql(s, w)} AS v{i}" for i, (s, w) in enumerate(GRID))} FROM users),
k AS (SELECT *, {rank_sql('obs')} AS robs, {", ".join(f"{rank_sql(f'v{i}')} AS r{i}" for i in range(4))} FROM v) """
       + " UNION ALL ".join(f"""
SELECT CAST({s} AS DOUBLE) AS stay, {str(w).lower()} AS windowed, {rd(f"avg(v{i})")} AS mean, {rd(f"corr(v{i}, obs)")} AS pearson,
  {rd(f"corr(r{i}, robs)")} AS spearman, {rd(f"avg(abs(v{i} - obs))")} AS mae FROM k""" for i, (s, w) in enumerate(GRID)))
def occupancy_sensitivity(spark, sf):
    u = users(spark, sf).withColumn("obs", F.coalesce("rate", F.lit(0.0)))
    return rounded(audit.occupancy_sensitivity(u, "rate", "min_nights", "idle", "obs", windows=(None, 1)))


@query("occupancy_reproduction", f"""WITH {USERS}, e AS (
  SELECT user_id, least(round_even(n / CAST(0.5 AS DOUBLE) * greatest(CAST(6.4 AS DOUBLE), min_nights), 0), 255) AS rebuilt
  FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n FROM events GROUP BY user_id) JOIN users USING (user_id))
SELECT count(rebuilt) AS n, count(*) FILTER (WHERE rebuilt = 255) AS equal FROM e""")
def occupancy_reproduction(spark, sf):
    errors = read(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("n"))
    rows = errors.join(users(spark, sf), "user_id").withColumn("published", F.lit(255))
    return audit.occupancy_reproduction(rows, "n", "min_nights", "published")


@query("occupancy_by_segment", f"""WITH {USERS}, u AS (
  SELECT users.*, c_mktsegment AS segment, c_acctbal AS price, floor(abs(c_acctbal) / 10) % 366 AS availability, {occ_sql('6.4', True)} AS occ
  FROM users JOIN customer ON user_id = c_custkey)
SELECT segment, {rd("avg(occ)")} AS occupancy, {rd("avg(1 - availability / 365)")} AS calendar_closed,
  {rd("avg(CASE WHEN availability = 0 THEN 1.0 ELSE 0.0 END)")} AS unavailable_share, {rd("avg(price * occ)")} AS "yield" FROM u GROUP BY segment""")
def occupancy_by_segment(spark, sf):
    c = read(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("price"),
        (F.floor(F.abs("c_acctbal") / 10) % 366).alias("availability"))
    rows = users(spark, sf).join(c, "user_id").withColumn(
        "occ", S.occupancy_model("rate", "min_nights", "idle", window=1))
    return rounded(audit.occupancy_by(rows, ["segment"], "occ", "price", "availability"))


FLAG_COLS = {"discounted": "l_discount >= CAST(0.05 AS DOUBLE)", "taxed": "l_tax > CAST(0.02 AS DOUBLE)", "open": "l_linestatus = 'O'"}


@query("flag_ratios", f"WITH l AS (SELECT l_returnflag, l_extendedprice AS p, {', '.join(f'{e} AS {n}' for n, e in FLAG_COLS.items())} FROM lineitem) "
       + " UNION ALL ".join(f"""
SELECT l_returnflag, count(*) AS n, '{n}' AS flag, {rd(f"avg(CASE WHEN {n} THEN 1.0 ELSE 0.0 END)")} AS prevalence,
  {rd(f"median(p) FILTER (WHERE {n}) / median(p) FILTER (WHERE NOT {n})")} AS price_ratio FROM l GROUP BY l_returnflag""" for n in FLAG_COLS))
def flag_ratios(spark, sf):
    l = read(spark, sf, "lineitem").select(
        "l_returnflag", "l_extendedprice", (F.col("l_discount") >= 0.05).alias("discounted"),
        (F.col("l_tax") > 0.02).alias("taxed"), (F.col("l_linestatus") == "O").alias("open"))
    return rounded(audit.flag_ratios(l, list(FLAG_COLS), "l_returnflag", "l_extendedprice"))


@query("completion_report", """
SELECT count(*) AS n, count(*) FILTER (WHERE p_size <= 10) AS missing_before,
  count(*) FILTER (WHERE p_size <= 10 AND regexp_matches(p_brand, '1')) AS completed,
  count(*) FILTER (WHERE p_size <= 10 AND NOT regexp_matches(p_brand, '1')) AS missing_after FROM part""")
def completion_report(spark, sf):
    p = read(spark, sf, "part").select(
        F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("given"), "p_brand")
    text = F.when(F.col("p_brand").contains("1"), F.concat(F.lit("1 bath "), F.col("p_brand")))
    return audit.completion_report(p.withColumn("done", S.bathrooms("given", text)), "given", "done")


@query("value_counts", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def value_counts(spark, sf):
    return audit.value_counts(read(spark, sf, "part"), "p_type")


@query("regex_share", f"""SELECT count(*) FILTER (WHERE regexp_matches(p_name, '(?i)\\bring\\b')) AS n, count(p_name) AS "of",
  {rd("avg(CASE WHEN regexp_matches(p_name, '(?i)\\bring\\b') THEN 1.0 ELSE 0.0 END)")} AS share FROM part""")
def regex_share(spark, sf):
    return rounded(audit.regex_share(read(spark, sf, "part"), "p_name", r"(?i)\bring\b"))


@query("compliance", f"""WITH {ORD}, s AS (SELECT *, CASE room_type WHEN 'F' THEN 'registrada' WHEN 'O' THEN 'isenta' ELSE 'ausente' END AS st FROM ord)
SELECT stratum, count(*) AS n, {", ".join(rd(f"avg(CASE WHEN st = '{v}' THEN 1.0 ELSE 0.0 END)") + f" AS {v}" for v in K.LICENCE_STATUS)},
  {rd("count(*) FILTER (WHERE NOT long_stay AND st = 'registrada') / nullif(count(*) FILTER (WHERE NOT long_stay AND st <> 'isenta'), 0)")} AS compliant_share
FROM s GROUP BY stratum""")
def compliance(spark, sf):
    licence = F.when(F.col("room_type") == "F", "OSE-STRREG-1").when(F.col("room_type") == "O", "Exempt")
    o = orders(spark, sf).withColumn("status", S.licence_status(licence))
    return rounded(audit.compliance(o, "stratum", "status", F.col("long_stay")))


@query("survey_quality", f"""SELECT count(c_acctbal) AS n, count(*) FILTER (WHERE c_acctbal >= 9000) AS at_cap,
  {rd("median((c_nationkey + 1) / CAST(1.645 AS DOUBLE) / nullif(c_acctbal, 0))")} AS median_cv FROM customer""")
def survey_quality(spark, sf):
    c = read(spark, sf, "customer").select("c_acctbal", (F.col("c_nationkey") + 1).alias("moe"))
    return rounded(audit.survey_quality(c, "c_acctbal", "moe", 9000.0))


@query("event_items", """
WITH w AS (SELECT doc_id, unnest(str_split(text, ' ')) AS item FROM documents)
SELECT doc_id, count(*) AS n_items, bool_or(regexp_matches(item, '(?i)^the$')) AS has_the,
  bool_or(regexp_matches(item, '(?i)tion')) AS has_tion FROM w GROUP BY doc_id""")
def event_items(spark, sf):
    lists = read(spark, sf, "documents").select("doc_id", F.to_json(F.split("text", " ")).alias("items"))
    return audit.amenity_dictionary_flags(lists, "doc_id", "items", {"has_the": "^the$", "has_tion": "tion"})


@query("event_items_inline", """
WITH w AS (SELECT doc_id, str_split(text, ' ') AS items FROM documents)
SELECT doc_id, len(items) AS n_items, len(list_filter(items, lambda x: regexp_matches(x, '(?i)^the$'))) > 0 AS has_the,
  len(list_filter(items, lambda x: regexp_matches(x, '(?i)tion'))) > 0 AS has_tion FROM w""")
def event_items_inline(spark, sf):
    lists = read(spark, sf, "documents").select("doc_id", F.to_json(F.split("text", " ")).alias("items"))
    return lists.select("doc_id", S.item_count("items").alias("n_items"),
                        *S.item_flags("items", {"has_the": "^the$", "has_tion": "tion"}))

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rentgrid.functions import constants as K, scalars as S
from rentgrid.operators.audit import amenity_dictionary_flags


def column(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_price_text(spark):
    got = column(spark, ["$1,234.00", "$52.00", None, "abc", "$0.00", " $10,000.50 ", "12d"], S.parse_price("x"))
    assert got == [1234.0, 52.0, None, None, 0.0, 10000.5, None]


def quote(total, items):
    return json.dumps({"quote": {"total_price": total, "raw_price_line_items": items}})


def test_quote_items(spark):
    raw = [quote("900", [{"amount": "-100", "item_type": "d"}, {"amount": "1000", "item_type": "x"}]),
           quote("900", [{"amount": "-100", "item_type": "discounted_subtotal"}]),
           quote("300", [{"amount": "oops", "item_type": "x"}]), quote(None, []), "{broken", None]
    got = column(spark, raw, S.quote_items("x"))
    assert [tuple(r) for r in got] == [(1000.0, 100.0), (900.0, 0.0)] + [(None, None)] * 4


def test_quote_nights(spark):
    df = spark.createDataFrame([(quote("300", []), dt.date(2026, 1, 1), dt.date(2026, 1, 31)),
                                (quote("300", []), dt.date(2026, 1, 2), dt.date(2026, 1, 2))], "q string, a date, b date")
    got = [tuple(r[0]) for r in df.select(S.quote_features("q", "a", "b")).collect()]
    assert got == [(30, 10.0, 0.0), (0, None, 0.0)]


def test_bathrooms(spark):
    texts = ["1 bath", "1.5 shared baths", "Half-bath", "Shared half-bath", None, "0 baths"]
    assert column(spark, texts, S.bathrooms(F.lit(None), "x")) == [1.0, 1.5, 0.5, 0.5, None, 0.0]
    assert column(spark, texts, S.shared_bath("x")) == [False, True, False, True, None, False]


@pytest.mark.parametrize("item,flag,expected", [
    ("Fast wifi – 200 Mbps", "amen_wifi", True), ("Kitchen", "amen_cozinha", True),
    ("KitchenAid oven", "amen_cozinha", False), ("Hair dryer", "amen_secadora", False),
    ("Free dryer – In unit", "amen_secadora", True), ("Dishwasher", "amen_lavadora", False),
    ("Gym nearby", "amen_academia", False), ("Shared gym in building", "amen_academia", True),
    ("Pool table", "amen_piscina", False), ("Private pool", "amen_piscina", True),
    ("HDTV", "amen_tv", True), ("Free street parking", "amen_estacionamento", False)])
def test_amenity(spark, item, flag, expected):
    assert column(spark, [json.dumps(["x", item])], S.item_flags("x", {flag: K.AMENITY_PATTERNS[flag]})[0]) == [expected]


def test_amenity_dictionary_route_agrees(spark):
    lists = [json.dumps(["Wifi", "Kitchen"]), json.dumps([]), "broken", None, json.dumps(["Hair dryer", "Wifi"])]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, a string")
    inline = df.select("id", S.item_count("a").alias("n_items"), *S.item_flags("a"))
    joined = amenity_dictionary_flags(df, "id", "a").select(inline.columns)
    assert sorted(map(tuple, inline.collect())) == sorted(map(tuple, joined.collect()))


def test_occupancy(spark):
    df = spark.createDataFrame([(0, 1.0, 2, 10), (1, 2.0, 2, 10), (2, 2.0, 2, 400), (3, None, 2, 10), (4, 2.0, None, 10)],
                               "i int, r double, m int, d int")
    got = [r[0] for r in df.orderBy("i").select(S.occupancy_model("r", "m", "d")).collect()]
    assert got[0] == pytest.approx(1 / 0.5 * 12 * 6.4 / 365) and got[1:4] == [0.7, 0.0, 0.0] and got[4] is None


def test_property_groups(spark):
    df = spark.createDataFrame([("Private room in houseboat", "Private room"), ("Room in hotel", "Hotel room"),
                                ("Entire condo", "Entire home/apt"), ("Entire home", "Entire home/apt"),
                                ("Something", "Shared room"), (None, None)], "p string, r string")
    assert [x[0] for x in df.select(S.property_group("p", "r")).collect()] == [
        "atipico", "hotel_pousada", "apartamento_inteiro", "casa_inteira", "quarto_compartilhado", "atipico"]


def test_zip_sentinel_band(spark):
    assert column(spark, ["10001-1234", "10001.0", "  11201", "abc", None], S.normalise_zip("x")) == [
        "10001", "10001", "11201", None, None]
    assert column(spark, ["-666666666", "5", "", None], S.clean_sentinels("x")) == [None, 5.0, None, None]
    edges, labels = K.RECENCY_BANDS
    assert column(spark, [90, 91, 400, None], S.bucket("x", edges, labels, "sem avaliação"), "int") == [
        "≤ 90 dias", "91–365 dias", "> 1 ano", "sem avaliação"]


def test_index_factor(spark):
    months = [(f"2019-{m:02d}", 100.0) for m in range(1, 13)] + [("2026-01", 120.0), ("2026-03", 130.0)]
    s = spark.createDataFrame(months, "month string, value double")
    assert tuple(S.index_factor(s, "2019-07", None, "2026-02").first()) == (1.2, "2026-01")
    assert tuple(S.index_factor(s, "2019", "2026-03").first()) == (1.3, "2026-03")
    with pytest.raises(Exception, match="missing"):
        S.index_factor(s, "2018-01", "2026-03").collect()
    with pytest.raises(Exception, match="twelve"):
        S.index_factor(s, "2026", "2026-03").collect()


def test_vintage_unknown(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "c int, x_2019 double, x_atual double, y double")
    got = S.vintage(df, "2019", {"2019": "_2019", "atual": "_atual"}, ["x", "y"], ["c"], {"x": F.lit(2.0)}).first()
    assert tuple(got) == (1, 4.0, 4.0)
    with pytest.raises(ValueError):
        S.vintage(df, "2020", {"2019": "_2019"}, ["x"], ["c"])


def test_a_quote_is_parsed_once_a_row(spark):
    """Every further use of the parsed quote used to be a parse of its own (22 in the registered query)."""
    raw = '{"quote":{"total_price":"90","raw_price_line_items":[{"amount":"-10","item_type":"x","description":"d"}]}}'
    df = spark.createDataFrame([(raw, "2026-01-01", "2026-01-05"), ("{", "2026-01-01", "2026-01-05"), (None, None, None)], "q string, a string, b string")
    out = df.select(S.quote_features("q", "a", "b").alias("f")).select("f.nights", "f.gross_price", "f.discount_share")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [tuple(r) for r in out.collect()] == [(4, 25.0, 0.1), (4, None, None), (None, None, None)]

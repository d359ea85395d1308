"""The cascade reads its input few times, with the flags it always had."""

from pyspark.sql import functions as F

from rentgrid.operators import quarantine as Q
from rentgrid.operators.skew import key_hash


def test_several_flags_are_looked_up_in_the_input(spark):
    rows = [(1, "a", None), (2, "a", None), (3, None, "x"), (4, None, "x"), (5, "b", "y"), (None, "b", "z"), (None, "c", "z"), (8, "a", "w")]
    df = spark.createDataFrame(rows, "row int, k string, v string")
    both = {(r.k, r.v, r.row): (r.rep_k, r.rep_v) for r in Q.mark_all_repeats(df, {"rep_k": ["k"], "rep_v": ["v"]}, "row").collect()}
    assert both == {("a", None, 1): (False, False), ("a", None, 2): (True, True), (None, "x", 3): (False, False), (None, "x", 4): (True, True),
                    ("b", "y", 5): (False, False), ("b", "z", None): (None, None), ("c", "z", None): (None, None), ("a", "w", 8): (True, False)}
    one = Q.mark_repeats(df, ["k"], "row", "rep_k")
    assert one.columns == ["row", "k", "v", "rep_k"] and one.where("rep_k").count() == 3


def test_the_hash_keeps_nulls_and_borders_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "-"), ("-", None)], "a string, b string")
    found = [r[0] for r in df.select(key_hash(["a", "b"])).collect()]
    assert len(set(found)) == 4
    assert found[0] == df.limit(1).select(F.sha2(F.lit("2:ab|1:c"), 256)).first()[0]


def test_a_rule_stands_once_in_the_plan(spark):
    """Both first hits read all rules; a plain array put every rule behind each of them."""
    df = spark.createDataFrame([("zz", 1), ("a", 2), (None, None)], "t string, n int")
    rules = [Q.Rule("B1", "one", Q.BASE, "r", F.col("t").rlike("z{2}")), Q.Rule("P1", "two", Q.PRICE, "r", F.col("n") > 1)]
    tagged = Q.tag(df, rules, "A").select("hits", "base_hit", "price_hit")
    assert tagged._jdf.queryExecution().optimizedPlan().toString().count("z{2}") == 1
    assert [tuple(r) for r in tagged.collect()] == [([True, False], 1, 0), ([False, True], 0, 2), ([False, False], 0, 0)]


def test_a_report_does_not_mark_the_rows_again(spark, tmp_path):
    """The check of the balance and the report itself were one more cascade each."""
    from rentgrid.plans import QUERIES
    day = "timestamp '1997-01-01'"
    spark.sql(f"""SELECT id AS o_orderkey, id % 3 AS o_custkey, {day} AS o_orderdate, 10000D * id AS o_totalprice, 'O' AS o_orderstatus,
                  '1-URGENT' AS o_orderpriority FROM range(9)""").write.parquet(str(tmp_path / "orders.parquet"))
    report = QUERIES["cascade_report"](spark, str(tmp_path))
    assert "Join" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert {r.codigo: r.cascata for r in report.collect()} == {"B01": 6, "B04": 0, "P04": 1, "P05": 0}

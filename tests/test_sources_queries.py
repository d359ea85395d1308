import gzip
import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rentgrid.operators import publish as P
from rentgrid.sources import files

DATA = "/root/testdata/sf0.001"


def test_csv_with_json_and_line_breaks(spark, tmp_path):
    text = 'id,name,raw\n1,"two\nlines","{""a"": ""b, c""}"\n2,plain,\n'
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write(text)
    df = files.read_listings_csv(spark, str(tmp_path / "x.csv.gz"), "id long, name string, raw string", partitions=2)
    got = [(r["id"], r["name"], r["raw"]) for r in df.orderBy(files.ROW).collect()]
    assert got == [(1, "two\nlines", '{"a": "b, c"}'), (2, "plain", None)]


def test_polygons_and_pois(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    doc = {"features": [
        {"properties": {"n": "a"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"properties": {"n": "a"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}},
        {"properties": {"n": "b"}, "geometry": {"type": "LineString", "coordinates": ring}}]}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    got = files.read_polygons(spark, str(tmp_path / "p.json"), ["n"]).collect()
    assert [(r["n"], len(r["rings"])) for r in got] == [("a", 3)]
    (tmp_path / "o.json").write_text(json.dumps({"elements": [
        {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}}, {"type": "relation", "id": 3}]}))
    assert [(r["id"], r["lat"]) for r in files.read_pois(spark, str(tmp_path / "o.json"), "park").orderBy("id").collect()] == [(1, 1.0), (2, 3.0)]


def test_index_and_block_readers(spark, tmp_path):
    (tmp_path / "i.csv").write_text("date,value\n2019-01-01,1.5\n2019-02-01,.\n")
    assert [tuple(r) for r in files.read_index_csv(spark, str(tmp_path / "i.csv")).collect()] == [("2019-01", 1.5)]
    series = {"Results": {"series": [{"data": [{"year": "2019", "period": p, "value": v} for p, v in (("M01", "2"), ("M13", "9"), ("M02", "-"))]}]}}
    (tmp_path / "i.json").write_text(json.dumps(series))
    assert [tuple(r) for r in files.read_index_json(spark, str(tmp_path / "i.json")).collect()] == [("2019-01", 2.0)]
    (tmp_path / "b.txt").write_text("001|7\nP36005|1|2\nP36005|3\nX|1|2\n")
    got = files.read_prefixed_block(spark, str(tmp_path / "b.txt"), "P36", {"E": "est"}, ["GEO_ID", "E", "M"]).collect()
    assert [tuple(r) for r in got] == [("005", "1")]
    wide = spark.createDataFrame([("z", 1.0, None, 3.0)], "zip string, `2019-01` double, `2019-02` double, `2019-04` double")
    assert tuple(files.pick_month(wide, ["zip"], "2019-03").first()) == ("z", "2019-04", 3.0)
    reg = spark.createDataFrame([("1", "1,200"), ("Total", "9"), ("note", None)], "k string, n string")
    assert [tuple(r) for r in files.register_table(reg, "k", "n").collect()] == [(1, 1200)]
    with pytest.raises(ValueError):
        files.timeline(spark, [("2020-01-01", "x")])


def test_strict_json(spark, tmp_path):
    df = spark.createDataFrame([(1, math.nan), (2, math.inf), (3, 1.23456)], "i int, x double")
    files.write_strict_json(df, str(tmp_path / "j"), {"x": 2})
    rows = [json.loads(l) for f in os.listdir(tmp_path / "j") if f.startswith("part") for l in open(tmp_path / "j" / f)]
    assert sorted((r["i"], r["x"]) for r in rows if r["i"] == 3) == [(3, 1.23)] and all(r["x"] is None for r in rows if r["i"] < 3)


def test_public_points_have_no_ids(spark):
    df = spark.createDataFrame([(7, 40.123456, -73.98765, 100.0, True, 4.6), (8, 40.1, -73.9, 5.0, False, None)],
                               "id int, lat double, lon double, price double, ok boolean, p double")
    got = P.public_points(df, "lat", "lon", "price", "ok", "p").collect()
    assert got[0]["lat"] == 40.1235 and got[1]["price"] is None
    with pytest.raises(ValueError):
        P.public_points(df, "lat", "lon", "price", "ok", "p", ["id"])


def test_class_breaks(spark):
    df = spark.range(1000).select((F.col("id") / 10.0).alias("s"), (F.col("id") - 500).cast("double").alias("d"))
    got = {r["metric"]: r["breaks"] for r in P.class_breaks(df, {"s": "sequential", "d": "diverging"}, {"d": 50.0}).collect()}
    assert got["s"] == [14.0, 29.0, 43.0, 57.0, 71.0, 86.0]
    assert got["d"] == [-350.0, -200.0, -50.0, 50.0, 200.0, 350.0]


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["cascade_report", "kpis", "psi_table", "class_metrics", "point_in_polygon", "comparables", "moran"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events").split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = sorted((tuple(str(v) for _, v in sorted(zip(columns, row))) for row in cur.fetchall()))
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(str(r[c]) for c in sorted(columns)) for r in df.collect()) == want

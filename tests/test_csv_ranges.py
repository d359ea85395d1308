import csv
import gzip
import random

import pyarrow as pa
import pytest

from rentgrid.sources import csv_ranges as C
from rentgrid.sources import files as S

SCHEMA = "id long, name string, about string, price double"


def rows(n, seed=1):
    draw = random.Random(seed)
    texts = ["plain", "two\nlines", 'say "hi"', "a,b", "\n\nblank\n\n", "", '{"k": ["v", "w"]}', '"\n"', "é𝄞\nü", "x" * 300 + "\n" * 5 + "y" * 300, "tab\tend"]
    return [(i, draw.choice(texts), draw.choice(texts), draw.choice(["1.5", "", "2"])) for i in range(n)]


def write(path, data, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as file:
        out = csv.writer(file, lineterminator=end)
        out.writerow(["id", "name", "about", "price"])
        out.writerows(data)


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def values(df):
    return [tuple(r)[:4] for r in df.orderBy(S.ROW).collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_give_the_rows_of_one_task_in_order(spark, tmp_path, small_ranges, end):
    for k in range(3):
        write(tmp_path / f"part{k}.csv", rows(120, k), end)
    split = S.read_listings_csv(spark, str(tmp_path), SCHEMA)
    whole = S.read_listings_csv(spark, str(tmp_path), SCHEMA, by_ranges=False)
    assert C.lines(spark, str(tmp_path)).rdd.getNumPartitions() >= 24
    assert C.open_ranges(C.lines(spark, str(tmp_path))).count() >= 8
    found = values(split)
    assert found == values(whole) and len(found) == 360
    assert [r[0] for r in found] == list(range(120)) * 3
    plain = [r for k in range(3) for r in rows(120, k)]
    assert [(r[1] or "", r[2] or "") for r in found] == [(a, b) for _, a, b, _ in plain]
    one = S.read_listings_csv(spark, str(tmp_path), SCHEMA, columns=["about"], partitions=3)
    assert one.columns == ["about", S.ROW] and one.count() == 360


def test_a_record_over_many_ranges(spark, tmp_path, small_ranges):
    long = "\n".join(f"line {i} with, commas and \"quotes\"" for i in range(400))
    write(tmp_path / "a.csv", [(1, "x", "y", "1"), (2, long, "z", "2"), (3, "p\nq", long, "")])
    assert values(S.read_listings_csv(spark, str(tmp_path / "a.csv"), SCHEMA)) == [
        (1, "x", "y", 1.0), (2, long, "z", 2.0), (3, "p\nq", long, None)]


def test_edges_of_files(spark, tmp_path, small_ranges):
    write(tmp_path / "none.csv", [])
    assert values(S.read_listings_csv(spark, str(tmp_path / "none.csv"), SCHEMA)) == []
    (tmp_path / "blank.csv").write_text("﻿id,name,about,price\n\n1,a,b,2\n\n\n2,,,")
    assert values(S.read_listings_csv(spark, str(tmp_path / "blank.csv"), SCHEMA)) == [(1, "a", "b", 2.0), (2, None, None, None)]
    (tmp_path / "broken.csv").write_text('id,name,about,price\n1,a,b,2\n2,"never closed,3\n4,c')
    assert values(S.read_listings_csv(spark, str(tmp_path / "broken.csv"), SCHEMA))[0] == (1, "a", "b", 2.0)
    (tmp_path / "other.csv").write_text("id,about,name,price\n1,a,b,2\n")
    with pytest.raises(ValueError, match="other.csv"):
        S.read_listings_csv(spark, str(tmp_path / "other.csv"), SCHEMA)


def test_gzip_is_one_range(spark, tmp_path):
    write(tmp_path / "a.csv", rows(50))
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress((tmp_path / "a.csv").read_bytes()))
    assert values(S.read_listings_csv(spark, str(tmp_path / "a.csv.gz"), SCHEMA)) == values(S.read_listings_csv(spark, str(tmp_path / "a.csv"), SCHEMA))


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_batches_of_lines_may_end_anywhere(size):
    text = 'a,"b\nc\n\nd",e\nf,g\n"h\n""\n\n","i\nj"\nk'.split("\n")
    for is_open in (False, True):
        data = (["tail of one", 'end",z'] if is_open else []) + text
        whole = pa.RecordBatch.from_pydict({"file": ["f"] * len(data), "start": [9] * len(data), "value": data, "odd": [is_open] * len(data)})
        made = [r for b in C.cut_records(whole.slice(i, size) for i in range(0, len(data), size)) for r in b.to_pylist()]
        assert [r["record"] for r in made] == (['tail of one\nend",z'] if is_open else []) + ['a,"b\nc\n\nd",e', "f,g", '"h\n""\n\n","i\nj"', "k"]
        assert [r["part"] for r in made] == ([C.LAST] if is_open else []) + [C.WHOLE] * 4 and [r["place"] for r in made] == list(range(len(made)))

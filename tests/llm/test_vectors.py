import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentgrid.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, similarity=0.95):
    """Every pair, and the least id reachable."""
    ok = [r is not None and len(r) > 0 and all(x is not None and math.isfinite(x) for x in r) and any(r) for _, r in rows]
    width = max([len(r) for (_, r), o in zip(rows, ok) if o], default=0)
    x = np.array([list(map(float, r)) + [0.0] * (width - len(r)) if o else [0.0] * width for (_, r), o in zip(rows, ok)]).reshape(len(rows), width)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    close = (x @ x.T >= similarity) & np.array(ok)[:, None] & np.array(ok)[None, :]
    np.fill_diagonal(close, False)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(close)):
        root[find(int(i))] = find(int(j))
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(least.get(find(i), v), v)
    out = []
    for i, (v, _) in enumerate(rows):
        component = least.get(find(i))
        out.append((v, int(close[i].sum()), component, v is not None and v == component))
    return sorted(out, key=str), int(close.sum())


def got(table, **parameters):
    return sorted((tuple(r) for r in vectors.near_duplicates(table, **parameters).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(v, None if e is None else [None if x is None else float(x) for x in e], 0) for v, e in rows], SCHEMA).repartition(4)


def groups(draw, dimensions, sizes, noise, offset=0.0):
    """Groups around random centres, their members farther away and nearer."""
    rows = []
    for size in sizes:
        centre = draw.normal(size=dimensions) + offset
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            aside = draw.normal(size=dimensions)
            aside /= np.linalg.norm(aside)
            rows.append((centre + draw.uniform(0, noise) * aside).astype(np.float32).tolist())
    order = draw.permutation(len(rows))
    return [(int(1000 + i), rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("offset", [0.0, 0.2])
def test_recall_at_the_least_similarity(spark, offset):
    rows = groups(np.random.default_rng(1), 64, [1] * 1500 + [6] * 60 + [80], 0.35, offset)
    expected, links = plain(rows)
    made = got(frame(spark, rows))
    right = {r[0]: r for r in expected}
    assert sum(r[1] for r in made) >= 0.98 * links > 1000
    assert all(r[1] <= right[r[0]][1] for r in made)           # none below the similarity
    assert len(made) == len(rows) and sum(m == right[m[0]] for m in made) >= 0.95 * len(rows)


def test_hot_buckets_in_pieces_lose_nothing(spark):
    rows = groups(np.random.default_rng(2), 16, [1] * 100 + [150, 40], 0.12)
    expected, links = plain(rows)
    assert links > 150 * 100
    assert got(frame(spark, rows), bucket_rows=20) == got(frame(spark, rows)) == expected


def test_defined_results(spark):
    one, near = [1.0, 0.0, 0.0, 0.0], [1.0, 0.1, 0.0, 0.0]
    rows = [(5, one), (4, one), (4, one), (9, near), (1, [2.0, 0, 0, 0]), (2, None), (3, []), (6, [0.0, -0.0, 0, 0]), (7, [1.0, None, 0, 0]),
            (8, [1.0, float("nan"), 0, 0]), (10, [float("inf"), 0, 0, 0]), (None, one), (None, [0.0, 0, 0, 1]), (11, [-1.0, 0, 0, 0]), (12, [1.0]),
            (12, [0.0, 0, 1, 0]), (13, [0.0, 0, 1, 1])]
    table = frame(spark, rows)
    for name in ("node", "vector", "copies", "n_links", "cell", "usable", "id"):
        table = table.withColumn(name, F.lit("x"))
    made = got(table)
    assert made == plain(rows)[0]
    assert got(table.limit(0)) == [] and got(frame(spark, [(3, None)])) == [(3, 0, 3, True)]
    assert got(frame(spark, [(3, [1.0, 2.0])])) == [(3, 0, 3, True)]


def test_given_vectors_with_copies_against_brute_force(spark):
    given = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    rows = given + [(v + 5000, e) for v, e in given[::3]] + [(v + 9000, [x + (0.02 if i % 2 else -0.02) for i, x in enumerate(e)]) for v, e in given[::2]]
    expected, links = plain(rows)
    assert links > 300 and got(frame(spark, rows)) == expected


def test_tables_reach_their_aim_at_every_size():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = draw.normal(size=x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + math.sqrt(1 - 0.95 ** 2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    for rows in (1000, 100_000, 10_000_000):
        index = vectors.learned(x, rows, 0.95)
        a, b = index.bits(x), index.bits(y)
        met = (index.keys(a) == index.keys(b)).any(axis=1) & ((a != b).sum(axis=1) <= index.distance)
        assert met.mean() >= 0.98
        assert np.array_equal((((index.codes(a) ^ index.codes(b))[:, None] & index.masks[None]) == 0).all(axis=2), index.keys(a) == index.keys(b))
        assert abs(a.mean() - 0.5) < 0.02                       # balanced bits

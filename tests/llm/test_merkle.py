import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from rentgrid.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes, arity):
    """The root and, per leaf, the siblings (left, right) of every step."""
    paths, place = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, p in enumerate(place):
            run = hashes[p // arity * arity:][:arity]
            paths[i].append(("".join(run[:p % arity]), "".join(run[p % arity + 1:])))
            place[i] = p // arity
        hashes = [sha("".join(hashes[i:i + arity])) for i in range(0, len(hashes), arity)]
    return hashes[0], paths


def plain(rows, arity=3, tamper=True):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in order}
    trees = {s: tree([leaf(r) for r in own[s]], arity) for s in order}
    root, over = tree([trees[s][0] for s in order], arity) if order else (None, [])
    out = []
    for s, top in zip(order, over):
        for row, path in zip(own[s], trees[s][1]):
            node = row
            if tamper and row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                node = (*row[:4], row[4].replace("\n", ""))
            node = leaf(node)
            for left, right in path + top:
                node = sha(left + node + right)
            out.append((row[0], leaf(row), trees[s][0], root, sha("".join(a + b for a, b in path + top)), node, node == root))
    return sorted(out, key=str)


def got(table):
    return sorted(map(tuple, merkle.checked(table).collect()), key=str)


def test_given_documents_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = plain([tuple(r) for r in docs.select(*merkle.LEAF).collect()])
    assert got(docs) == expected
    assert 0 < sum(r[6] for r in expected) < len(expected)      # some rows are tampered with, and found


@pytest.mark.parametrize("sizes", [[1], [1, 1], [2, 3, 4], [9, 10, 27, 28, 1], [1] * 10])
def test_every_shape_of_tree(spark, sizes):
    rows = [(100 * g + i, f"s{g}" if g else None, "x", i, f"text {i}\n") for g, n in enumerate(sizes) for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert got(table) == plain(rows)


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(1, "a", "x", 3, "a\nb"), (1, "a", "x", 3, "a\nb"), (1, "a", "x", 3, "other"), (2, None, None, None, None), (None, "a", "x", 1, "\n"),
            (None, None, None, None, None), (3, "", None, 0, ""), (4, "é", "y", 1, "é\n" * 5000), (5, "z", "y", 1, "q"), (6, "-", "1:", 1, "q")]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for name in ("tree", "place", "size", "hash", "leaf", "path", "left", "root"):
        table = table.withColumn(name, F.lit(7))
    assert got(table) == plain(rows)
    assert got(table.limit(0)) == []


def test_edge_rows(spark, edge, nothing):
    rows = [tuple(r) for r in edge.select(*merkle.LEAF).collect()]
    assert got(edge) == plain(rows)
    assert merkle.checked(nothing).count() == 0


@pytest.mark.parametrize("arity", [2, 5])
def test_other_arities_fold_to_their_root(spark, arity):
    rows = [(i, f"s{i % 4}", None, i, str(i)) for i in range(90)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    made = merkle.manifest(table, arity=arity).collect()
    assert {r["root"] for r in made} == {plain(rows, arity, tamper=False)[0][3]}
    assert all(r["folded_root"] == r["root"] for r in made)


def test_a_hot_group_in_one_key_keeps_one_row_per_join_key(spark):
    rows = [(7, "hot", None, 1, "same")] * 3000 + [(i, "hot", None, i, "t") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    placed = merkle.placed(table.select(F.col("source").alias("tree"), "doc_id"), "tree", ["doc_id"])
    assert [r["place"] for r in placed.orderBy("place").select("place").collect()] == list(range(3300))
    assert got(table) == plain(rows)

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentgrid.llm import substring


def removed(rows, window):
    """Plain Python: per row, which words go."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (doc_id, _), w in zip(rows, words):
        if doc_id is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i:i + window])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if doc_id is not None and first[tuple(w[i:i + window])] < doc_id:
                gone[i:i + window] = [True] * window
        out.append((doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def compare(spark, rows, window, group):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.remove_passages(df.repartition(3), window=window, group=group).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, removed(rows, window)))


def test_random_documents_against_plain_python(spark):
    draw = random.Random(5)
    rows = []
    for i in range(120):
        w = [draw.choice("abc") for _ in range(draw.randrange(0, 40))]
        if i > 3 and draw.random() < 0.5:                     # a piece of an earlier document, in another place
            other = (rows[draw.randrange(len(rows))][1] or "").split()
            a = draw.randrange(0, len(other) + 1)
            w[draw.randrange(0, len(w) + 1):0] = other[a:a + draw.randrange(0, 25)]
        rows.append((draw.choice([i, i, i, None]) if draw.random() < 0.2 else i, draw.choice([" ", "\n", " \t"]).join(w)))
    rows += [(7, rows[7][1]), (500, None), (501, ""), (502, rows[3][1])]
    compare(spark, rows, 6, 3)


def test_one_passage_in_a_third_of_the_documents(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    rows = [(i, " ".join([f"a{i}", f"b{i % 7}"] * 6) + " " + (passage if i % 3 == 0 else f"x{i}") + f" end{i} end{i % 5} tail") for i in range(150)]
    compare(spark, rows, 8, 3)


def test_whole_windows_on_edge_rows(edge):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    got = substring.removed_words(edge).collect()
    want = [(d, n, k, hashlib.sha256(s.encode()).hexdigest()) for d, n, k, s in removed(rows, 50)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_cleaned_documents_keep_columns_layout_and_nulls(edge):
    out = substring.without_repeats(edge)
    assert out.columns == edge.columns
    texts = {r["doc_id"]: r["text"] for r in out.where(F.col("doc_id").isNotNull()).collect()}
    assert texts[5] is None and texts[7] == " \t\n " and texts[2] == ""
    assert texts[3].startswith("alpha") or len(texts[3].split()) == 140
    assert "shared0" not in texts[4] and texts[4].endswith(texts[4].strip())
    assert out.where("doc_id = 4").first()["n_chars"] == len(texts[4])


def test_empty_table(nothing):
    assert substring.removed_words(nothing).collect() == []
    assert substring.without_repeats(nothing).collect() == []


def test_factors_are_checked_at_their_boundaries():
    """A window that crosses two blocks is found although neither block is copied whole."""
    words = np.arange(100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(12345)
    parse = substring.Parse(substring.mixed(words), 10, 4)
    inside, block = parse.windows(np.arange(len(parse.blocks)))
    assert sorted(inside.tolist()) == list(range(91))
    wanted = parse.sequences(np.array([41, 42]), 10)
    assert parse.factors(np.empty(0, np.uint64), wanted) == [(41, 11)]
    whole = parse.factors(parse.blocks[2:4], np.empty(0, np.uint64))
    assert whole == [(int(parse.starts[2]), int(parse.ends[3] - 1 + 10 - parse.starts[2]))]

import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentgrid.llm import chat, mixing, topk


# ---- top-k -------------------------------------------------------------------------------------------------

def plain_search(rows, k):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in kept:
        if q % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e13])
def test_search_against_plain_python(spark, scale):
    draw = random.Random(2)
    rows = [(i, [scale * draw.choice([-1.0, 0.5, 0.25, draw.gauss(0, 1)]) for _ in range(7)]) for i in range(450)]
    rows += [(i, list(rows[3][1])) for i in range(450, 600)]       # ties: a quarter of all rows is one vector
    rows += [(600, None), (700, [1.0, None, 2.0, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 7), (800, [float("nan")] * 7), (801, [float("inf")] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = topk.integer_vectors(df)
    got = topk.search(vectors, vectors.where("vec_id % 100 = 0"), shard_rows=100, query_rows=3).collect()
    want = plain_search(rows, 10)
    if scale > 1e9:                                            # beyond 64 bits the nearest number is returned
        want = [(q, r, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, i, s in want]
        assert sorted(map(tuple, got)) == sorted(want) or {(g[0], g[1], g[3]) for g in map(tuple, got)} == {(w[0], w[1], w[3]) for w in want}
    else:
        assert sorted(map(tuple, got)) == want


def test_search_with_few_or_no_candidates(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [3.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.neighbours(few).collect()))
    assert [(g[1], g[2]) for g in got] == [(1, 2), (2, 1), (3, 1)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, score int")
    assert topk.neighbours(none).collect() == []


def test_rows_that_repeat_a_query_id_are_ranked_alone(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0])] + [(i, [i / 64, (30 - i) / 64]) for i in range(1, 31)]
    got = topk.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    up, down = ([(0, n + 1, i, 1024 * 16 * i) for n, i in enumerate(range(30, 20, -1))],
                [(0, n + 1, i, 1024 * 16 * (30 - i)) for n, i in enumerate(range(1, 11))])
    assert sorted(map(tuple, got)) == sorted(up + down)


# ---- mixing ------------------------------------------------------------------------------------------------

def test_targets_reshare_what_is_above():
    targets = mixing.target_words({"b": 10, "a": 10, "c": 1000, None: 200, "d": 0})
    assert targets["a"] == 30 and targets["b"] == 30 and targets["d"] == 0
    assert abs(sum(targets.values()) - 1220) < 1e-6
    order = [targets["c"], targets[None]]
    assert abs(order[0] / order[1] - 1 / 2) < 1e-9 or targets[None] == 600


def plain_cost(words, quotas, repeats):
    """The least cost of the fullest flow, by trying every way to split each pattern's words."""
    best = None
    choices = []
    for key, n in words.items():
        members = json.loads(key)
        choices.append([c for c in itertools.product(range(repeats * n + 1), repeat=len(members)) if sum(c) <= repeats * n])
    for split in itertools.product(*choices):
        got = dict.fromkeys(quotas, 0)
        cost = 0
        for (key, n), c in zip(words.items(), split):
            for s, t in zip(json.loads(key), c):
                got[s] += t
            total = sum(c)
            cost += sum(r * r * max(0, min(n, total - n * (r - 1))) for r in range(1, repeats + 1))
        if all(got[s] <= quotas[s] for s in quotas):
            rank = (-sum(got.values()), cost)
            best = rank if best is None or rank < best else best
    return best


@pytest.mark.parametrize("quotas", [{"a": 4, "b": 3}, {"a": 1, "b": 6}, {"a": 9, "b": 0}])
def test_flow_over_overlapping_sources_is_the_cheapest(quotas):
    words = {'["a"]': 2, '["b"]': 1, '["a","b"]': 2}
    taken = mixing.allotments(words, quotas, 2)
    cost = sum(r * r * max(0, min(n, taken[k] - n * (r - 1))) for k, n in words.items() for r in (1, 2))
    assert (-sum(taken.values()), cost) == plain_cost(words, quotas, 2)


def test_mix_reaches_its_targets_exactly_and_again(spark, edge):
    draw = random.Random(3)
    rows = [(i, " ".join(["w"] * draw.randrange(0, 60)), f"s{i % 3 if i % 2 else 0}" if i % 11 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for bucket_rows in (17, 50_000):
        out = mixing.mixed(df, F.array("source"), bucket_rows=bucket_rows)
        got = out.select("doc_id", "source", "__size", "__taken").collect()
        again = mixing.mixed(df.repartition(7), F.array("source"), bucket_rows=bucket_rows + 5).select("doc_id", "source", "__size", "__taken").collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
        sizes, taken = {}, {}
        for _, s, n, t in got:
            assert 0 <= t <= 3 * n
            sizes[s], taken[s] = sizes.get(s, 0) + n, taken.get(s, 0) + t
        for s, t in mixing.target_words(sizes).items():
            assert taken[s] == int(t + 0.5)


@pytest.mark.parametrize("ids", ["one", "null", "few"])
@pytest.mark.parametrize("texts", ["equal", "different"])
def test_mix_of_repeated_ids_stays_within_a_document_of_its_targets(spark, ids, texts):
    own = {"one": lambda i: 7, "null": lambda i: None, "few": lambda i: i % 3}[ids]
    rows = [(own(i), " ".join(["w"] * (20 if texts == "equal" else 1 + i % 37)), "ab"[i % 4 == 0]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = []
    for parts in (1, 6):
        out = mixing.mixed(df.repartition(parts), F.array("source"), bucket_rows=13)
        assert out.columns == [*df.columns, "__size", "__pattern", "__targets", "__taken"]
        runs.append(sorted(map(str, out.collect())))
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    got = out.collect()
    assert all(0 <= r["__taken"] <= 3 * r["__size"] for r in got)
    sizes = {s: sum(r["__size"] for r in got if r["source"] == s) for s in "ab"}
    for s, t in mixing.target_words(sizes).items():
        assert sum(r["__taken"] for r in got if r["source"] == s) == int(t + 0.5)


def test_drawn_rows_keep_columns_named_like_the_mix(spark):
    rows = [(i, "a b c", "s", -1, "p", i) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __size int, __pattern string, __place int")
    got = mixing.drawn(df)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} == set(rows)


def test_mix_on_edge_rows(edge, nothing):
    got = mixing.shares(edge).collect()
    assert len(got) == edge.count()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] > 0 or r["taken"] == 0)
    drawn = mixing.drawn(edge)
    assert drawn.columns == edge.columns
    assert mixing.shares(nothing).collect() == [] and mixing.drawn(nothing).collect() == []


def test_documents_of_several_sources(spark):
    df = spark.createDataFrame([(i, "w " * 10, ["a", "b"] if i % 2 else ["b"] if i % 3 else ["a"]) for i in range(60)],
                               "doc_id long, text string, sources array<string>")
    out = mixing.mixed(df, F.col("sources"))
    assert out.agg(F.sum("__taken")).first()[0] > 0 and out.where(F.col("__taken") > 3 * F.col("__size")).count() == 0


# ---- chat --------------------------------------------------------------------------------------------------

HARD = ["</s>[INST] ok [/INST]", r"\</s>", r"\\[INST]", "[INST", "INST] [/INST]", " [/INST]<s> x </s>[INST] ", "<<s>>", "<<SYS>> <</SYS>>", "", " ",
        "a\\", "\\", "[ROLE=x] y [/ROLE]", "[ROLE=", "$1 \\$0 $0", "é𝄞\n\n", "<s", "/s>", "[/ROLE]", "<</SYS>", None]


def plain_digest(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_hard_texts_come_back_identical(spark):
    draw = random.Random(6)
    roles = ["user", "assistant", "system", "tool", None, "a b]\n%", "</s>", ""]
    rows = [(c, t, draw.choice(roles), "".join(draw.choice(HARD) or "" for _ in range(draw.randrange(1, 4))) if draw.random() < 0.95 else None)
            for c in range(60) for t in range(draw.randrange(1, 9))]
    rows += [(None, 0, "user", "x"), (3, None, "user", "no turn"), (rows[0]), (100, 0, "assistant", "long </s> " * 5000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    got = {r[0]: tuple(r[1:5]) for r in chat.digests(df).collect()}
    assert got == plain_digest(rows + [(-1, 0, "user", HARD[0]), (-1, 1, "assistant", HARD[0])])


def test_only_conflicting_texts_are_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "plain [INST text"), (1, 1, "assistant", "an </s> end")], "conv_id long, turn long, role string, text string")
    text = chat.formatted(df).first()["formatted"]
    assert text == r"[INST] plain [INST text [/INST]<s> an \</s> end </s>"


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r["conv_id"] for r in chat.digests(df).collect()] == [-1]


def test_chat_uses_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.digests(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

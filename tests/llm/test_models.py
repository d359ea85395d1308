import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentgrid.llm import forest, language, quality, toxicity, words


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def plain_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    count, again = Counter(zip(w, w[1:], w[2:])), [False] * len(w)
    for i in range(len(w) - 2):
        if count[w[i], w[i + 1], w[i + 2]] > 1:
            again[i:i + 3] = [True] * 3
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(again))


def test_base_counts_against_plain_python(edge, sample):
    texts = [r[0] for r in edge.select("text").collect()] + [r[0] for r in sample[0].select("text").limit(300).collect()]
    texts += ["a b c a b c", "a b c a b", "x\ny\nx \nx", "# $ <b>|%&* é", "q q q q"]
    base, features = words.described(texts)
    got = list(zip(*[base[n].tolist() for n in forest.BASE]))
    assert got == [plain_statistics(t) for t in texts]
    assert np.isfinite(features).all()


def held_out_scores(df, labels, label):
    return df.join(labels.withColumnRenamed("doc_id", "key"), F.col("doc_id") == F.col("key")).where("held_out").select(
        "score", "predicted", label).toPandas()


def test_quality_on_rows_held_out(sample):
    out = quality.scored(*sample).cache()
    found = held_out_scores(out, sample[1], "quality")
    assert ((found["predicted"] == 1) == (found["quality"] == 1)).mean() > 0.95
    assert found[found["quality"] == 1]["predicted"].mean() > 0.97
    assert out.count() == sample[0].count()
    for r in out.limit(50).collect():
        assert r["held_out"] == (remainder(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1


def test_pairs_learn_what_single_tables_cannot():
    draw = np.random.default_rng(1)
    x = draw.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.AdditiveModel(x[:3000], y[:3000])
    alone = quality.AdditiveModel(x[:3000], y[:3000], pairs=0)
    right = lambda m: ((m.score(x[3000:]) > 0.5) == (y[3000:] == 1)).mean()
    assert (0, 1) in model.pairs and right(model) > 0.9 > 0.7 > right(alone)


def test_toxicity_on_rows_held_out(spark, sample):
    folder = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = held_out_scores(toxicity.scored(documents, labels), labels, "toxic")
    toxic = found[found["toxic"] == 1]
    assert toxic["predicted"].mean() > 0.85 and found[found["toxic"] == 0]["predicted"].mean() < 0.02


def test_factors_learn_pairs_that_weights_cannot():
    draw = np.random.default_rng(2)
    found, y = [], []
    for i in range(1200):
        a, b = i % 2, i // 2 % 2
        found.append(np.array(sorted({10 if a else 11, 20 if b else 21, 30 + int(draw.integers(5))})))
        y.append(float(a == b))
    machine = toxicity.FactorizationMachine(np.array([10, 11, 20, 21, *range(30, 35)]))
    machine.fit([machine.number[t] for t in found], np.array(y), epochs=60)
    assert ((machine.score(found) > 0.5) == (np.array(y) == 1)).mean() > 0.95


def test_fitted_machine_learns_labels_of_pairs_alone(spark):
    draw = np.random.default_rng(5)
    filler = ["walk", "stone", "river", "cloud", "bread", "lamp", "north", "paper", "glass", "green"]
    rows, marks = [], []
    for i in range(1500):
        insult, group = draw.integers(2, size=2)
        words = [*draw.choice(filler, 6), "dreadful" if insult else "pleasant", "zorblaks" if group else "neighbours"]
        draw.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, int(insult == group)))
    documents, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    found = held_out_scores(toxicity.scored(documents, labels), labels, "toxic")
    assert ((found["score"] > 0.5) == (found["toxic"] == 1)).mean() > 0.95


def test_language_on_rows_held_out(sample):
    out = language.languages(sample[0]).join(sample[0].select("doc_id", "lang"), "doc_id").toPandas()
    ho = out[out["held_out"]]
    assert (ho["lang_pred"] == ho["lang"]).mean() > 0.97
    assert (out["held_out"] == out["doc_id"].map(lambda d: remainder(d, 3) == 1)).all()


def test_forest_drops_bad_rows_and_keeps_good_ones(spark):
    folder = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = forest.judged(documents, labels).join(labels, "doc_id").where(~F.col("base_failed")).toPandas()
    out = out[out["doc_id"].map(lambda d: remainder(d, 4) == 2)]
    assert out[out["quality"] == 1]["kept"].mean() > 0.98 and out[out["quality"] == 0]["kept"].mean() < 0.2


def test_a_lone_far_row_has_a_short_path():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(500, 4))
    far = np.array([[9.0, -9.0, 9.0, -9.0]])
    f = forest.IsolationForest(x, np.concatenate([x, far]), trees=50)
    assert f.depth(far)[0] < f.depth(x).min()


EMPTY_LABELS = "doc_id long, quality int, toxic int, score int"


@pytest.fixture(scope="module")
def edge_labels(spark):
    return spark.createDataFrame([(1, 1, 0, 0), (1, 1, 0, 0), (3, 0, 1, 0), (4, None, None, 0), (None, 1, 1, 0), (10, 1, 0, 0), (12, 0, 0, 0)], EMPTY_LABELS)


@pytest.mark.parametrize("which", ["edge", "none"])
def test_edge_rows_have_a_result(spark, edge, edge_labels, which):
    labels = edge_labels if which == "edge" else spark.createDataFrame([], EMPTY_LABELS)
    for scored in (quality.scored, toxicity.scored):
        rows = scored(edge, labels).collect()
        assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    rows = forest.judged(edge, labels).collect()
    assert len(rows) == edge.count() and not any(r["kept"] and r["base_failed"] for r in rows)
    assert all(r["base_failed"] for r in rows if r["n_words"] < 50)
    got = {r["doc_id"]: r for r in language.languages(edge).collect()}
    assert got[5]["lang_pred"] == got[6]["lang_pred"] == got[8]["lang_pred"] == "und" and got[5]["score"] == 0
    assert got[1]["lang_pred"] == "en"


def test_no_languages_to_learn(edge):
    out = language.languages(edge.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in out} == {"und"}
    kept = language.accepted(edge)
    assert kept.columns == edge.columns and 8 not in {r["doc_id"] for r in kept.collect()}


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], EMPTY_LABELS)
    assert quality.scored(nothing, labels).collect() == [] == toxicity.scored(nothing, labels).collect()
    assert forest.judged(nothing, labels).collect() == [] == language.languages(nothing).collect()
    assert language.accepted(nothing).collect() == []


def plain_cut(depth, good, loss):
    """Plain Python: the least cut that best separates the labels, among those that lose at most ``loss`` of the good rows."""
    most = float(np.quantile(depth[good], loss))
    if good.all():
        return most
    values = np.unique(depth)
    cuts = [c for c in [*(values[1:] + values[:-1]) / 2, values[0] - 1e-9] if c <= most]
    return max(cuts, key=lambda c: (depth[~good] < c).mean() - (depth[good] < c).mean())


@pytest.mark.parametrize("bad,loss", [(40, 0.003), (300, 0.2), (0, 0.01)])
def test_the_cut_counts_every_labelled_row(spark, bad, loss):
    draw = np.random.default_rng(bad)
    depth = np.concatenate([draw.normal(12, 1, 1000), draw.normal(9, 2, bad)]).round(2)
    good = np.arange(len(depth)) < 1000
    rows = spark.createDataFrame([(float(d), bool(g)) for d, g in zip(depth, good)], "path double, good boolean").repartition(5)
    assert forest.calibrated(rows, loss) == pytest.approx(plain_cut(depth, good, loss), abs=1e-12)


def test_the_forest_learns_from_all_rows(spark):
    """Box and draws reach every labelled row, a table of more rows than a tree draws has different rows in its trees."""
    draw = np.random.default_rng(9)
    n, width = 25_000, len(forest.FEATURES)
    x = draw.normal(size=(n, width)).round(3)
    x[17, 0], x[n - 1, 1] = 50.0, -60.0
    stats = spark.createDataFrame([(i, 100, 400, 0, 0, 0, r.tolist()) for i, r in enumerate(x)],
                                  "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>")
    labels = spark.createDataFrame([(i, int(i not in (17, n - 1))) for i in range(n)], "doc_id long, quality int")
    learned = np.array([remainder(i, 4) != 2 for i in range(n)])
    made, cut = forest.fitted(stats, labels, trees=20, rows=64)
    assert (made.low == x[learned].min(axis=0)).all() and (made.high == x[learned].max(axis=0)).all() and len(made.trees) == 20
    good = learned & ~np.isin(np.arange(n), [17, n - 1])
    depth = made.depth(x[learned])
    assert cut == pytest.approx(plain_cut(depth, good[learned], 0.003), abs=1e-12)
    again, same = forest.fitted(stats.repartition(7), labels, trees=20, rows=64)
    assert same == cut and all((a == b).all() for s, t in zip(made.trees, again.trees) for a, b in zip(s, t))

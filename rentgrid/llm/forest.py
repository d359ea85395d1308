"""Quality rules judged by an isolation forest on rule statistics.

The base rules are counts over whole texts (words, symbols, repeated lines, words in
repeated 3-word windows) with fixed limits. On top, an isolation forest looks at
statistics of the text: every tree splits a small sample at random features and
random values until its rows are alone, and a text that such splits set apart early,
by a short path, is unlike the documents the forest knows. Every tree draws its own rows from
all rows labelled good and grows in a task; the box its cuts come from spans all labelled rows. The path length below
which a text is anomalous is calibrated on every labelled row: the cut that best separates the labels,
among those that lose at most ``loss`` of the good rows, from counts of all their paths.

Defined results: a null or empty text has no words and fails the base rules. Rows
whose ``crc32(doc_id) mod 4`` is 2, and rows with a null ``doc_id``, are not learned
from. Without good rows to learn from only the base rules count; without bad rows the
cut is the one that loses ``loss`` of the good ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.llm.common import known_labels, per_document
from rentgrid.llm.words import FEATURES, described, mixed
from rentgrid.session import shared_table

#: Trees of the forest, the rows that each draws, and its depth.
TREES, TREE_ROWS, LIMIT = 200, 1024, 20
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class IsolationForest:
    """Random trees as arrays; ``depth`` gives the mean path length of every row.

    ``box`` holds rows that span all values worth telling apart (by default the rows
    themselves). Cuts are drawn from what is left of that box, not only from the range
    of the rows at hand, so the empty parts around them become short branches.
    """

    def __init__(self, x: np.ndarray, box: np.ndarray | None = None, trees: int = TREES, rows: int = TREE_ROWS, limit: int = LIMIT, seed: int = 17):
        draw = np.random.default_rng(seed)
        self.trees = []
        if not len(x):
            return
        box = x if box is None else box
        self.low, self.high = box.min(axis=0), box.max(axis=0)
        for _ in range(trees):
            own = x[draw.choice(len(x), min(rows, len(x)), replace=False)]
            self.trees.append(self.grown(own, self.low, self.high, limit, draw))

    @classmethod
    def of(cls, trees: list[tuple], low: np.ndarray, high: np.ndarray) -> IsolationForest:
        """A forest of trees that are grown already."""
        forest = cls(np.empty((0, len(low))))
        forest.trees, forest.low, forest.high = trees, low, high
        return forest

    @classmethod
    def grown(cls, own: np.ndarray, low: np.ndarray, high: np.ndarray, limit: int, draw: np.random.Generator) -> tuple:
        """One tree of the rows ``own`` as arrays."""
        feature, cut, child, length = [], [], [], []
        waiting = [(np.arange(len(own)), low, high, 0, -1, 0)]
        while waiting:
            at, low, high, depth, parent, side = waiting.pop()
            me = len(feature)
            if parent >= 0:
                child[parent][side] = me
            child.append([-1, -1])
            wide = np.flatnonzero(high > low)
            if depth >= limit or len(at) < 2 or not len(wide):
                feature.append(-1), cut.append(0.0), length.append(depth + cls.rest(len(at)))
                continue
            f = int(draw.choice(wide))
            value = float(draw.uniform(low[f], high[f]))
            feature.append(f), cut.append(value), length.append(0.0)
            left = own[at, f] < value
            under, over = high.copy(), low.copy()
            under[f] = over[f] = value
            waiting += [(at[left], low, under, depth + 1, me, 0), (at[~left], over, high, depth + 1, me, 1)]
        return tuple(map(np.array, (feature, cut, child, length)))

    @staticmethod
    def rest(n: int) -> float:
        """The mean path length that ``n`` rows would still need."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def depth(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        if not self.trees:
            return total
        x = np.clip(x, self.low, self.high)
        for feature, cut, child, length in self.trees:
            at, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
            while len(open_ := open_[feature[at[open_]] >= 0]):
                here = at[open_]
                at[open_] = child[here, (x[open_, feature[here]] >= cut[here]).astype(np.int64)]
            total += length[at]
        return total / len(self.trees)


def calibrated(paths: DataFrame, loss: float) -> float:
    """The path length under which a text is anomalous, from all rows ``path, good``.

    Paths are counted, ordered by range, and summed up within each range; the driver sees one row a range.
    """
    counts = paths.groupBy("path").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    # written, so that a path is in the same range in every pass
    placed = shared_table(counts.repartitionByRange("path").withColumn("part", F.spark_partition_id()), "path-counts")
    ranges = placed.groupBy("part").agg(F.min("path").alias("least"), F.sum("g").alias("g"), F.sum("b").alias("b")).orderBy("part").collect()
    n_good, n_bad = sum(r["g"] for r in ranges), sum(r["b"] for r in ranges)
    if not n_good:
        return -math.inf
    goods, bads = np.cumsum([0, *[r["g"] for r in ranges]]).tolist(), np.cumsum([0, *[r["b"] for r in ranges]]).tolist()
    least = [r["least"] for r in ranges[1:]] + [None]
    starts = paths.sparkSession.createDataFrame([(r["part"], g, b, n) for r, g, b, n in zip(ranges, goods, bads, least)],
                                                "part int, g0 long, b0 long, after double")
    inside = Window.partitionBy("part").orderBy("path")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    run = placed.join(F.broadcast(starts), "part").select(
        "path", "g", F.coalesce(F.lead("path").over(inside), "after").alias("next"),
        (F.col("g0") + F.sum("g").over(upto)).alias("goods"), (F.col("b0") + F.sum("b").over(upto)).alias("bads"))
    at = loss * (n_good - 1)
    place = math.floor(at)

    def good_at(i: int):
        return F.max(F.when((F.col("goods") - F.col("g") <= i) & (F.col("goods") > i), F.col("path")))

    low, high = run.agg(good_at(place), good_at(min(place + 1, n_good - 1))).first()
    most = low + (high - low) * (at - place)
    if not n_bad:
        return most
    cut = (F.col("path") + F.col("next")) / 2
    gain = F.col("bads") / F.lit(n_bad) - F.col("goods") / F.lit(n_good)
    best = run.where(F.col("next").isNotNull() & (cut <= most)).agg(F.max(F.struct(gain.alias("gain"), (-cut).alias("cut"))).alias("r")).first()["r"]
    return -best["cut"] if best is not None and best["gain"] >= 0 else ranges[0]["least"] - 1e-9


def statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, the base counts and the features of every whole text."""
    def columns(texts):
        base, x = described(texts)
        return {**{n: pa.array(base[n].astype(np.int64)) for n in BASE}, "features": pa.array(list(x), pa.list_(pa.float64()))}

    return per_document(documents, ["doc_id"], text, ", ".join(f"{n} long" for n in BASE) + ", features array<double>", columns)


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def drawn_trees(good: DataFrame, n: int, low: np.ndarray, high: np.ndarray, trees: int, rows: int, limit: int, seed: int = 17) -> list[tuple]:
    """Trees that each draw ``rows`` of the ``n`` good rows (``key, features``), without replacement, and grow in a task.

    A row's place in the draw of a tree is a hash of its key and the tree; those surely too far back are left out before
    they are sent.
    """
    share = min(1.0, (rows + 8 * math.sqrt(rows)) / n)
    turns = mixed(np.arange(1, trees + 1, dtype=np.uint64) + np.uint64(seed << 32))
    bound = np.uint64(min(int(share * 2.0 ** 64), (1 << 64) - 1))

    def draw(batches):
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            for tree, turn in enumerate(turns):
                place = mixed(key ^ turn)
                own = np.flatnonzero(place <= bound)
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), tree, np.int32)), pa.array((place[own] >> np.uint64(1)).view(np.int64)),
                                                      batch.column(1).take(pa.array(own))], names=["tree", "place", "features"])

    def grow(rows_of: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows_of["tree"].iloc[0])
        x = np.array(rows_of["features"].tolist(), np.float64)
        first = np.lexsort([*x.T[::-1], rows_of["place"].to_numpy()])[:rows]        # equal places: by value
        feature, cut, child, length = IsolationForest.grown(x[first], low, high, limit, np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [np.int32(tree)], "feature": [feature], "cut": [cut], "child": [child.reshape(-1)], "length": [length]})

    drawn = good.mapInArrow(draw, "tree int, place long, features array<double>")
    made = drawn.groupBy("tree").applyInPandas(grow, "tree int, feature array<long>, cut array<double>, child array<long>, length array<double>")
    return [(np.array(r["feature"]), np.array(r["cut"]), np.array(r["child"]).reshape(-1, 2), np.array(r["length"]))
            for r in made.orderBy("tree").collect()]


def with_path(rows: DataFrame, forest: IsolationForest) -> DataFrame:
    """The rows with ``path``, the mean path length, in place of ``features``, their last column."""
    kept = rows.columns[:-1]

    def run(batches):
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(forest.depth(x))], names=[*kept, "path"])

    return rows.mapInArrow(run, ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept], "path double"]))


def fitted(stats: DataFrame, labels: DataFrame, label: str = "quality", loss: float = 0.003,
           trees: int = TREES, rows: int = TREE_ROWS, limit: int = LIMIT) -> tuple[IsolationForest, float]:
    """Forest and cut, from all labelled rows that pass the base rules."""
    learned = shared_table(stats.join(known_labels(labels, "doc_id", label, 4, 2), "doc_id").where(
        ~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select(
        F.xxhash64("doc_id", "features").alias("key"), (F.col("__label") == 1).alias("good"), "features"), "learned")
    sides = [f(F.col("features")[i]) for f in (F.min, F.max) for i in range(len(FEATURES))]
    n, *box = learned.agg(F.count_if("good"), *sides).first()
    if not n:
        return IsolationForest(np.empty((0, len(FEATURES)))), -math.inf
    low, high = np.array(box, np.float64).reshape(2, -1)
    forest = IsolationForest.of(drawn_trees(learned.where("good").select("key", "features"), n, low, high, trees, rows, limit), low, high)
    return forest, calibrated(with_path(learned.select("good", "features"), forest), loss)


def judged(documents: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``path`` (the mean path length) and ``kept``."""
    stats = shared_table(statistics(documents, text), "rule-statistics")
    forest, cut = fitted(stats, labels)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return with_path(stats, forest).withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("path") >= F.lit(cut)))

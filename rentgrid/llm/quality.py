"""A quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins. Boosting goes round the features; at each
visit a shallow tree over the bins of that feature alone fits what is left of the
labels, and its leaves are added to the feature's lookup table. Then the pairs of
features with the strongest leftover interaction get tables of two dimensions, fitted
the same way. A text's score is the logistic function of the sum of its table entries.

Features come from the text alone and from all of it. The model learns from at most
about ``TRAIN_ROWS`` labelled rows, drawn by a hash of the id; rows held out never
enter. Without both labels in the sample every score is the share of label 1 (0.5
without labels).

Defined results: a null text counts as empty and gets a score; a row with a null
``doc_id`` is held out; repeated rows get equal rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.llm.common import held_out, labelled_sample, per_document
from rentgrid.llm.words import FEATURES, described
from rentgrid.session import shared_table

#: The bound on labelled rows that reach the driver (15 numbers each).
TRAIN_ROWS = 40_000


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Edges between distinct values that hold about equally many rows, the lone extremes included."""
    inner = np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])
    return np.unique(inner)


def _leaf(gradient: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    return gradient / (weight + ridge)


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 4, ridge: float = 5.0) -> np.ndarray:
    """The step function over ordered bins, with at most ``leaves`` steps, that best fits the summed gradients."""
    edges = [0, len(gradient)]
    g, h = np.append(0, np.cumsum(gradient)), np.append(0, np.cumsum(weight))
    for _ in range(leaves - 1):
        best, at = 1e-6, 0
        for lo, hi in zip(edges, edges[1:]):
            cut = np.arange(lo + 1, hi)
            if not len(cut):
                continue
            left, right, whole = ((g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge) for a, b in ((lo, cut), (cut, hi), (lo, hi)))
            gain = left + right - whole
            if gain.max() > best:
                best, at = gain.max(), int(cut[gain.argmax()])
        if not at:
            break
        edges = sorted([*edges, at])
    out = np.empty(len(gradient))
    for lo, hi in zip(edges, edges[1:]):
        out[lo:hi] = _leaf(g[hi] - g[lo], h[hi] - h[lo], ridge)
    return out


def cross_tree(gradient: np.ndarray, weight: np.ndarray, ridge: float = 5.0) -> tuple[np.ndarray, float]:
    """The best cut of each axis of a two-way table as four leaves, and what it gains."""
    g, h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (gradient, weight))
    rows, columns = g.shape[0] - 1, g.shape[1] - 1
    if rows < 2 or columns < 2:
        return np.zeros_like(gradient), 0.0

    def quarters(t):
        corner, side, top = t[1:-1, 1:-1], t[1:-1, -1:], t[-1:, 1:-1]
        return corner, side - corner, top - corner, t[-1, -1] - side - top + corner

    gs, hs = quarters(g), quarters(h)
    gain = sum(a ** 2 / (b + ridge) for a, b in zip(gs, hs)) - g[-1, -1] ** 2 / (h[-1, -1] + ridge)
    a, b = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(gradient)
    for k, (r, c) in enumerate(((slice(a + 1), slice(b + 1)), (slice(a + 1), slice(b + 1, None)),
                                (slice(a + 1, None), slice(b + 1)), (slice(a + 1, None), slice(b + 1, None)))):
        out[r, c] = _leaf(gs[k][a, b], hs[k][a, b], ridge)
    return out, float(gain[a, b])


class AdditiveModel:
    """Lookup tables per feature and per pair of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = 64, pair_bins: int = 12, pairs: int = 8, rounds: int = 60, rate: float = 0.15):
        n, features = x.shape
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
        self.start = float(np.log(share / (1 - share)))
        self.cuts = [_cuts(x[:, f], bins) if n else np.empty(0) for f in range(features)]
        self.coarse = [_cuts(x[:, f], pair_bins) if n else np.empty(0) for f in range(features)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if n == 0 or share in (1e-3, 1 - 1e-3):
            return
        at = [self.cuts[f].searchsorted(x[:, f], side="right") for f in range(features)]
        rough = [self.coarse[f].searchsorted(x[:, f], side="right") for f in range(features)]
        score = np.full(n, self.start)

        def left() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-score))
            return y - p, p * (1 - p)

        for _ in range(rounds):
            for f in range(features):
                g, h = left()
                size = len(self.tables[f])
                step = rate * shallow_tree(np.bincount(at[f], g, size), np.bincount(at[f], h, size))
                self.tables[f] += step
                score += step[at[f]]

        def crossed(a: int, b: int) -> tuple[np.ndarray, float]:
            shape = (len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)
            cell = rough[a] * shape[1] + rough[b]
            g, h = left()
            return cross_tree(*[np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)])

        strength = sorted(((crossed(a, b)[1], a, b) for a, b in combinations(range(features), 2)), reverse=True)
        self.pairs = [(a, b) for gain, a, b in strength[:pairs] if gain > 0]
        self.pair_tables = [np.zeros((len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)) for a, b in self.pairs]
        for _ in range(rounds // 2):
            for k, (a, b) in enumerate(self.pairs):
                step = rate * crossed(a, b)[0]
                self.pair_tables[k] += step
                score += step[rough[a], rough[b]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[cuts.searchsorted(x[:, f], side="right")]
        rough = {f: self.coarse[f].searchsorted(x[:, f], side="right") for pair in self.pairs for f in pair}
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[rough[a], rough[b]]
        return 1 / (1 + np.exp(-total))


def feature_table(documents: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and the features of every whole text, in the order of ``FEATURES``."""
    def columns(texts):
        return {"features": pa.array(list(described(texts)[1]), pa.list_(pa.float64()))}

    return per_document(documents, ["doc_id"], text, "features array<double>", columns)


def fitted(features: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS,
           modulus: int = 4, remainder: int = 2) -> AdditiveModel:
    """The model learned from a bounded sample of the labelled rows that are not held out."""
    sample = labelled_sample(features, labels, "doc_id", label, modulus, remainder, rows).orderBy("doc_id").toPandas()
    x = np.array(sample["features"].tolist(), np.float64).reshape(len(sample), len(FEATURES))
    return AdditiveModel(x, sample["__label"].to_numpy(np.float64))


def scored(documents: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    features = shared_table(feature_table(documents, text), "quality-features")
    model = fitted(features, labels)

    def run(batches):
        for batch in batches:
            rows = batch.column(1)
            x = rows.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    marked = features.mapInArrow(run, f"doc_id {features.schema['doc_id'].dataType.simpleString()}, score double")
    return marked.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text (runs of letters, ASCII lower case) and the first 4, 5
and 6 bytes of each, hashed into 2**20 buckets; a document has a term or not. From
the training sample the terms enter that at least ``MIN_TEXTS`` texts have and whose
share differs clearly between the labels, and all terms that between a fifth and four
fifths of the texts have, as these may matter only beside another one. The machine adds, to a weight per term, an
inner product of factors for every pair of terms in a text, so a pair such as an
insult and a mention of a group can weigh more than its parts. Pair sums take one
pass over a text's terms: half of (squared sum - sum of squares).

At most about ``TRAIN_ROWS`` labelled rows are learned from, drawn by a hash of the
id; rows held out never enter. Every text is read whole, in training and in scoring.

Defined results: a null or empty text, and one without any known term, gets the score
of the constant alone; a row with a null ``doc_id`` is held out; without both labels
in the sample every score is near the share of label 1 (0 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.llm.common import held_out, labelled_sample, per_document, sent
from rentgrid.llm.words import LETTERS, Batch, word_hashes
from rentgrid.session import shared_table

#: The bound on labelled rows that training draws.
TRAIN_ROWS = 20_000
BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
MIN_TEXTS = 4
#: Terms with a share of the texts from this to its complement enter whatever their labels.
COMMON_SHARE = 0.2


def terms(texts: list) -> list[np.ndarray]:
    """The distinct hashed terms of each text, in ascending order."""
    batch = Batch(texts, lower=True, kinds=LETTERS)
    kinds = word_hashes(batch.raw, batch.starts, batch.ends, PREFIXES)
    salted = [((h + np.uint64(7919 * i)) % np.uint64(BUCKETS)).astype(np.int64) for i, h in enumerate(kinds)]
    found = []
    for lo, hi in zip(batch.cuts, batch.cuts[1:]):
        found.append(np.unique(np.concatenate([s[lo:hi] for s in salted])))
    return found


class FactorizationMachine:
    """``bias + sum of weights + sum over pairs of factor products`` of the known terms of a text."""

    def __init__(self, known: np.ndarray, factors: int = 4, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.number = np.full(BUCKETS, -1, np.int32)          # term -> row of the parameters
        self.number[known] = np.arange(len(known))
        self.bias = 0.0
        self.weights = np.zeros(len(known))
        self.factors = draw.normal(0, 0.05, (len(known), factors))

    @staticmethod
    def rows(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Parameter rows of all texts, one after another, and the text of each."""
        return np.concatenate([*own, np.empty(0, np.int32)]), np.repeat(np.arange(len(own)), [len(n) for n in own])

    def parts(self, term: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.maximum(np.bincount(text, minlength=n), 1)
        linear = np.bincount(text, self.weights[term], n)
        own = self.factors[term]
        sums = np.column_stack([np.bincount(text, v, n) for v in own.T]) if len(own) else np.zeros((n, self.factors.shape[1]))
        squares = np.bincount(text, (own ** 2).sum(axis=1), n)
        return self.bias + linear + ((sums ** 2).sum(axis=1) - squares) / (2 * size), sums, size

    def score(self, found: list[np.ndarray]) -> np.ndarray:
        term, text = self.rows([n[n >= 0] for n in (self.number[t] for t in found)])
        return 1 / (1 + np.exp(-np.clip(self.parts(term, text, len(found))[0], -60, 60)))

    def fit(self, own: list[np.ndarray], y: np.ndarray, epochs: int = 40, size: int = 256, rate: float = 0.1,
            ridge: float = 1e-4, seed: int = 11) -> None:
        """Learn from the parameter rows (numbers of known terms) of each text and its label."""
        draw = np.random.default_rng(seed)
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.bias = float(np.log(share / (1 - share)))
        if not len(self.weights):
            return
        past = [1e-6, np.full_like(self.weights, 1e-6), np.full_like(self.factors, 1e-6)]
        for _ in range(epochs):
            order = draw.permutation(len(own))
            for some in np.array_split(order, max(1, len(order) // size)):
                term, text = self.rows([own[i] for i in some])
                total, sums, count = self.parts(term, text, len(some))
                left = (1 / (1 + np.exp(-np.clip(total, -60, 60))) - y[some]) / len(some)
                pull = left[text]
                weights = np.bincount(term, pull, len(self.weights)) + ridge * self.weights
                slope = (pull / count[text])[:, None] * (sums[text] - self.factors[term])
                factors = np.column_stack([np.bincount(term, v, len(self.weights)) for v in slope.T]) + ridge * self.factors
                for k, step in enumerate((left.sum(), weights, factors)):
                    past[k] = past[k] + step ** 2
                self.bias -= rate * float(left.sum()) / np.sqrt(past[0])
                self.weights -= rate * weights / np.sqrt(past[1])
                self.factors -= rate * factors / np.sqrt(past[2])


def telling_terms(sample: DataFrame, least: int = MIN_TEXTS, z: float = 5.0, common: float = COMMON_SHARE) -> np.ndarray:
    """Terms of at least ``least`` texts whose share among the labels differs by over ``z`` standard errors, and the common ones.

    ``sample`` has ``label`` and ``terms``. The counts are made in the tasks; the
    chosen terms, no more than ``BUCKETS``, come back.
    """
    def rows(batches):
        for batch in batches:
            lists = [np.frombuffer(t, "<u4").astype(np.int32) for t in batch.column("terms").to_pylist()]
            label = np.repeat(batch.column("label").to_numpy(), [len(t) for t in lists])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(label.astype(np.int32))], names=["term", "label"])

    size = sample.agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n")).first()
    ones, zeros = float(size["ones"] or 0), float(size["n"] - (size["ones"] or 0))
    if not ones or not zeros:
        return np.empty(0, np.int64)
    counts = sample.select("label", "terms").mapInArrow(rows, "term int, label int").groupBy("term").agg(
        F.sum("label").alias("a"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & (F.col("n") < ones + zeros))
    share = F.col("n") / F.lit(ones + zeros)
    error = F.sqrt(share * (1 - share) * F.lit(1 / ones + 1 / zeros))
    score = F.abs(F.col("a") / F.lit(ones) - (F.col("n") - F.col("a")) / F.lit(zeros)) / error
    chosen = counts.where((score > z) | share.between(common, 1 - common)).select("term")
    return np.sort(np.array([r["term"] for r in chosen.collect()], np.int64))


def fitted(documents: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS,
           modulus: int = 4, remainder: int = 2) -> FactorizationMachine:
    """The machine learned from a bounded sample of the labelled rows that are not held out.

    Only the chosen terms of the sampled texts reach the driver.
    """
    drawn = labelled_sample(documents.select("doc_id", text), labels, "doc_id", label, modulus, remainder, rows, "toxic")

    def columns(texts):
        return {"terms": [t.astype("<u4").tobytes() for t in terms(texts)]}

    sample = shared_table(per_document(drawn, ["doc_id", "__label"], text, "terms binary", columns)
                          .withColumnRenamed("__label", "label"), "toxic-sample")
    machine = FactorizationMachine(telling_terms(sample))
    number = sent(documents.sparkSession, machine.number)

    def known(batches):
        for batch in batches:
            own = [number()[np.frombuffer(t, "<u4")] for t in batch.column("terms").to_pylist()]
            packed = [n[n >= 0].astype("<i4").tobytes() for n in own]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(packed, pa.binary())],
                                             names=["doc_id", "label", "known"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    learned = sample.mapInArrow(known, f"doc_id {kind}, label int, known binary").orderBy("doc_id").toPandas()
    if len(learned):
        machine.fit([np.frombuffer(k, "<i4") for k in learned["known"]], learned["label"].to_numpy(np.float64))
    else:
        machine.bias = -60.0
    return machine


def scored(documents: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    machine = sent(documents.sparkSession, fitted(documents, labels, text))

    def columns(texts):
        return {"score": pa.array(machine().score(terms(texts)), pa.float64())}

    marked = per_document(documents, ["doc_id"], text, "score double", columns)
    return marked.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Language ID by a byte convolutional network.

A text is lower-cased and its UTF-8 bytes are cut into windows of fixed length. Bytes
become short vectors; filters of widths 2 to 4 run over them, each keeps its largest
response in the window, and a softmax layer turns these into languages. The network
is trained in numpy on windows of labelled texts and applied to batches of all
windows of every text. A text's probabilities are the mean over its windows, weighted
by their bytes.

Training takes at most about ``rows_per_language`` texts of each language, drawn by a
hash of the id, and ``windows_per_text`` windows spread over each; the number of
languages is small, and only their counts and these windows reach the driver.

Defined results: a text that is null or has no letter is ``und`` with score 0. Without
a labelled row to learn from every text is ``und``. A null ``doc_id`` is held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.llm.common import held_out, packed, per_document, sent, unpacked

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DEPTH = 8
ROWS_PER_LANGUAGE = 1500
WINDOWS_PER_TEXT = 3


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def byte_windows(text: str, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last filled up with zero bytes, and the bytes in each."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    count = -(-len(raw) // length)
    sizes = np.full(count, length)
    if count:
        sizes[-1] = len(raw) - length * (count - 1)
    return np.append(raw, np.zeros(count * length - len(raw), np.uint8)).reshape(count, length), sizes


class ByteNetwork:
    """Embedding, convolution filters of several widths, max pooling and softmax."""

    def __init__(self, classes: int, seed: int = 3):
        draw = np.random.default_rng(seed)
        wide = max(WIDTHS)
        self.mask = np.concatenate([np.repeat((np.arange(wide) < w).astype(np.float32), DEPTH)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1)
        self.embed = draw.normal(0, 0.5, (256, DEPTH)).astype(np.float32)
        self.kernel = (draw.normal(0, 0.3, (wide * DEPTH, FILTERS * len(WIDTHS))) * self.mask).astype(np.float32)
        self.shift = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.dense = draw.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)).astype(np.float32)
        self.base = np.zeros(classes, np.float32)

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """The embedded bytes under the widest filter at every position."""
        n, length = windows.shape
        wide = max(WIDTHS)
        flat = self.embed[windows].reshape(n, length * DEPTH)
        view = np.lib.stride_tricks.sliding_window_view(flat, wide * DEPTH, axis=1)[:, ::DEPTH]
        return np.ascontiguousarray(view)

    def pooled(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, places, width = columns.shape
        response = (columns.reshape(n * places, width) @ self.kernel).reshape(n, places, -1)
        best = response.argmax(axis=1)
        return np.take_along_axis(response, best[:, None, :], axis=1)[:, 0], best

    def probabilities(self, windows: np.ndarray, at_once: int = 128) -> np.ndarray:
        out = np.empty((len(windows), len(self.base)))
        for i in range(0, len(windows), at_once):
            columns = self.columns(windows[i:i + at_once])
            n, places, width = columns.shape
            top = (columns.reshape(n * places, width) @ self.kernel).reshape(n, places, -1).max(axis=1) + self.shift
            z = np.maximum(top, 0) @ self.dense + self.base
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[i:i + at_once] = z / z.sum(axis=1, keepdims=True)
        return out

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, size: int = 64, rate: float = 0.005, seed: int = 5,
            least_steps: int = 900) -> None:
        epochs = max(epochs, -(-least_steps * size // len(windows)))  # few windows are gone over more often
        draw = np.random.default_rng(seed)
        names = ("embed", "kernel", "shift", "dense", "base")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        wide, steps = max(WIDTHS), 0
        for epoch in range(epochs):
            order = draw.permutation(len(windows))
            for some in np.array_split(order, max(1, len(order) // size)):
                x, y, n = windows[some], labels[some], len(some)
                columns = self.columns(x)
                top, best = self.pooled(columns)
                top = top + self.shift
                hidden = np.maximum(top, 0)
                z = hidden @ self.dense + self.base
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(n), y] -= 1
                p /= n
                back = (p @ self.dense.T) * (top > 0)
                seen = np.take_along_axis(columns, best[:, :, None], axis=1)          # (n, filters, width)
                grads = {"dense": hidden.T @ p, "base": p.sum(axis=0), "shift": back.sum(axis=0),
                         "kernel": np.einsum("nfw,nf->wf", seen, back) * self.mask}
                under = (back[:, :, None] * self.kernel.T[None]).reshape(-1, DEPTH)    # what reaches each embedded byte
                place = best[:, :, None] + np.arange(wide)[None, None, :]
                bytes_ = np.take_along_axis(x[:, None, :], place.reshape(n, 1, -1), axis=2).reshape(-1)
                grads["embed"] = np.column_stack([np.bincount(bytes_, v, 256) for v in under.T])
                steps += 1
                pace = rate * (0.5 if epoch >= epochs - 2 else 1.0) * np.sqrt(1 - 0.999 ** steps) / (1 - 0.9 ** steps)
                for k in names:
                    g = grads[k].astype(np.float32)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    setattr(self, k, getattr(self, k) - (pace * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32))


def training_windows(documents: DataFrame, text: str, label: str, rows: int, windows: int, modulus: int, remainder: int):
    """Seeded windows of a bounded sample of labelled texts: ``(windows, label numbers, languages)``."""
    known = documents.where(F.col(label).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    counts = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}
    languages = sorted(counts)
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col(label) == lang, F.lit(min(1.0, rows / n))).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id").cast("string")), F.lit(1 << 30)) < share * (1 << 30))

    def columns(texts):
        out = []
        for t in texts:
            cut, sizes = byte_windows(t)
            cut = cut[sizes >= min(LENGTH, sizes.max())] if has_letter(t) else cut[:0]
            chosen = np.unique(np.linspace(0, len(cut) - 1, windows).round().astype(int)) if len(cut) else []
            out.append(cut[chosen].tobytes() if len(cut) else b"")
        return {"windows": out}

    sample = per_document(drawn, ["doc_id", label], text, "windows binary", columns).orderBy("doc_id").toPandas()
    cuts = [np.frombuffer(w, np.uint8).reshape(-1, LENGTH) for w in sample["windows"]]
    number = {lang: i for i, lang in enumerate(languages)}
    y = np.repeat([number[lang] for lang in sample[label]], [len(c) for c in cuts]).astype(np.int64)
    return np.concatenate([*cuts, np.empty((0, LENGTH), np.uint8)]), y, languages


def identified(documents: DataFrame, carried: list[str], text: str = "text", label: str = "lang", rows: int = ROWS_PER_LANGUAGE,
               windows: int = WINDOWS_PER_TEXT, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """``carried``, ``lang_pred`` and ``score`` of every row; the network is learned from the rows not held out."""
    x, y, languages = training_windows(documents, text, label, rows, windows, modulus, remainder)
    network = ByteNetwork(len(languages))
    if len(x):
        network.fit(x, y)
    model = sent(documents.sparkSession, (network, languages if len(x) else []))

    def columns(texts):
        net, names = model()
        cuts = [byte_windows(t) if names and has_letter(t) else (np.empty((0, LENGTH), np.uint8), np.empty(0, int)) for t in texts]
        counts = np.array([len(s) for _, s in cuts])
        best, score = ["und"] * len(texts), np.zeros(len(texts))
        if counts.sum():
            p = net.probabilities(np.concatenate([c for c, _ in cuts]))
            weight = np.concatenate([s for _, s in cuts])
            owner = np.repeat(np.arange(len(texts)), counts)
            total = np.maximum(np.bincount(owner, weight, len(texts)), 1)
            mean = np.column_stack([np.bincount(owner, p[:, k] * weight, len(texts)) / total for k in range(len(names))])
            for i in np.flatnonzero(counts).tolist():
                best[i] = names[int(mean[i].argmax())]
            score = np.where(counts > 0, np.minimum(mean.max(axis=1), 1.0), 0.0)
        return {"lang_pred": pa.array(best, pa.string()), "score": pa.array(score, pa.float64())}

    return per_document(documents, carried, text, "lang_pred string, score double", columns)


def languages(documents: DataFrame) -> DataFrame:
    """The registered query."""
    return identified(documents.select("doc_id", "text", "lang"), ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def accepted(documents: DataFrame, least: float = 0.35) -> DataFrame:
    """The rows whose language is told with a score of ``least`` or more; rows without a letter go.

    ``documents`` needs ``doc_id``, ``text`` and ``lang``; all columns pass through.
    """
    told = identified(packed(documents, "doc_id", "lang"), ["__row", "text"])
    kept = told.where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return unpacked(kept, documents.columns, text=F.col("text"))

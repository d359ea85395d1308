"""Removing repeated passages by relative Lempel-Ziv parsing against indexed reference blocks.

Every run of ``window`` words belongs to one block of its document: the neighbouring
windows whose least word group (the anchor, by hash) is the same one. Equal windows
have equal anchors, so a document is parsed against the blocks under its own anchors
and against no others. The index keeps, per anchor and block, the first document.

1. Blocks are indexed; only anchors that several documents hold go on.
2. A block found whole in an earlier document is one phrase of the parse.
3. Where an anchor has different blocks, a factor may end inside a block. Such
   boundary blocks are compared window by window, one copy of each block only.
4. A document's factors are its longest stretches of windows found in earlier
   documents. A factor has at least ``window`` words and becomes a duplicate span.

Copies are combined before each shuffle, so a passage in a third of all documents is
one row per task. Hashes are 64 bits of the anchor together with 64 bits of the block
or window. Texts are shuffled by document id only.

Defined results: a null text has no words. A row with a null ``doc_id`` is neither
before nor after any other: it keeps its words and removes none. Rows that repeat an
id are judged alike and do not remove each other's words. Documents under ``window``
words stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.llm.common import packed, text_batches, unpacked
from rentgrid.llm.words import Batch, mixed, powers, word_hashes
from rentgrid.session import shared_table

WINDOW = 50
#: Words in an anchor; a window holds ``WINDOW - GROUP + 1`` of them.
GROUP = 12
#: The odd multiplier of the hash of a word sequence.
WORD = 0xD6E8FEB86659FD93
BATCH = 2 << 20


class Parse:
    """The blocks and windows of one document, from the hashes of its words."""

    def __init__(self, words: np.ndarray, window: int = WINDOW, group: int = GROUP):
        n = len(words)
        self.n, self.window = n, window
        if n < window:
            self.starts = self.ends = np.empty(0, np.int64)
            self.anchors = self.blocks = np.empty(0, np.uint64)
            return
        self.scale = powers(pow(WORD, -1, 1 << 64), n)
        self.sums = np.append(np.uint64(0), np.cumsum(words * powers(WORD, n), dtype=np.uint64))
        groups = self.sequences(np.arange(n - group + 1), group)
        at = np.lib.stride_tricks.sliding_window_view(groups, window - group + 1).argmin(axis=1) + np.arange(n - window + 1)
        first = np.append(True, at[1:] != at[:-1])
        self.starts = np.flatnonzero(first)                   # the first window of each block
        self.ends = np.append(self.starts[1:], n - window + 1)
        self.anchors = groups[at[self.starts]]
        lengths = self.ends - self.starts + window - 1
        self.blocks = mixed(self.sequences(self.starts, lengths) + lengths.astype(np.uint64))

    def sequences(self, at: np.ndarray, length) -> np.ndarray:
        """Hashes of ``length`` words from each position on."""
        return mixed((self.sums[at + length] - self.sums[at]) * self.scale[at])

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of the chosen blocks, and the block of each."""
        sizes = (self.ends - self.starts)[chosen]
        total = np.cumsum(sizes)
        begin = np.repeat(self.starts[chosen] - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)
        return begin, np.repeat(chosen, sizes)

    def factors(self, copied: np.ndarray, repeated: np.ndarray) -> list[tuple[int, int]]:
        """Greedy parse: ``(first word, words)`` of each stretch found in earlier documents.

        Blocks in ``copied`` match whole; at the others each window is looked up in ``repeated``.
        """
        found = np.zeros(max(0, self.n - self.window + 1), bool)
        whole = np.isin(self.blocks, copied)
        found[self.windows(np.flatnonzero(whole))[0]] = True
        if len(repeated):
            begin, _ = self.windows(np.flatnonzero(~whole))
            found[begin] = np.isin(self.sequences(begin, self.window), repeated)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], found.view(np.int8), [0]])))
        spans: list[tuple[int, int]] = []
        for a, b in zip(edges[::2].tolist(), (edges[1::2] - 1 + self.window).tolist()):
            if spans and a <= sum(spans[-1]):                 # factors that overlap cover one span
                spans[-1] = (spans[-1][0], b - spans[-1][0])
            else:
                spans.append((a, b - a))
        return spans


def parsed(batch_texts: list, window: int, group: int):
    """For each text (bytes or None): the text, its word positions and its parse."""
    batch = Batch(batch_texts)
    hashes = word_hashes(batch.raw, batch.starts, batch.ends)[0]
    for i, text in enumerate(batch.texts):
        own = slice(batch.cuts[i], batch.cuts[i + 1])
        yield text, batch.starts[own] - batch.offsets[i], batch.ends[own] - batch.offsets[i], Parse(hashes[own], window, group)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _numbers(value) -> np.ndarray:
    return np.array(value or [], np.int64).view(np.uint64)


def block_index(documents: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``doc_id, anchor, block``: the distinct blocks of every document."""
    def run(batches):
        for batch in text_batches(batches, "__text", BATCH):
            ids, counts, anchors, blocks = batch.column(0), [], [], []
            for _, _, _, parse in parsed(batch.column(1).to_pylist(), window, group):
                _, one = np.unique(parse.blocks, return_index=True)
                counts.append(len(one))
                anchors.append(parse.anchors[one])
                blocks.append(parse.blocks[one])
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([ids.take(rows), _longs(np.concatenate(anchors)), _longs(np.concatenate(blocks))],
                                             names=["doc_id", "anchor", "block"])

    return documents.where(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, anchor long, block long")


def boundary_windows(asked: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``doc_id, anchor, window``: the windows of the blocks listed in ``asked`` (``doc_id, __text, blocks``)."""
    def run(batches):
        for batch in text_batches(batches, "__text", BATCH):
            ids, wanted = batch.column(0), batch.column(2).to_pylist()
            counts, anchors, windows = [], [], []
            for i, (_, _, _, parse) in enumerate(parsed(batch.column(1).to_pylist(), window, group)):
                begin, block = parse.windows(np.flatnonzero(np.isin(parse.blocks, _numbers(wanted[i]))))
                values, one = np.unique(parse.sequences(begin, window) if len(begin) else np.empty(0, np.uint64), return_index=True)
                counts.append(len(one))
                windows.append(values)
                anchors.append(parse.anchors[block[one]])
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([ids.take(rows), _longs(np.concatenate(anchors)), _longs(np.concatenate(windows))],
                                             names=["doc_id", "anchor", "window"])

    return asked.select("doc_id", "__text", "blocks").mapInArrow(run, "doc_id long, anchor long, window long")


def _later(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``doc_id, <key>`` of the rows whose (anchor, key) an earlier document holds too.

    The few keys that several documents hold are a table of their own, so the join
    reads two plain tables and adaptive execution can split a hot key.
    """
    firsts = shared_table(rows.groupBy("anchor", key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                          .where(F.col("first") < F.col("last")).select("anchor", key, "first"), name)
    return rows.join(firsts, ["anchor", key]).where(F.col("doc_id") > F.col("first")).select("doc_id", key)


def factor_table(documents: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``doc_id, copied, repeated``: per document the blocks and the boundary windows that earlier documents hold.

    ``documents`` has ``doc_id`` and ``__text``.
    """
    index = shared_table(block_index(documents, window, group), "blocks")
    shared = shared_table(index.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                          .where(F.col("first") < F.col("last")).select("anchor"), "anchors")
    index = shared_table(index.join(shared, "anchor"), "shared-blocks")
    copied = shared_table(_later(index, "block", "first-blocks"), "copied")
    heads = shared_table(index.groupBy("anchor", "block").agg(F.min("doc_id").alias("doc_id")), "heads")
    several = shared_table(heads.groupBy("anchor").agg(F.min("block").alias("one"), F.max("block").alias("other"))
                           .where(F.col("one") != F.col("other")).select("anchor"), "boundaries")
    asked = heads.join(several, "anchor").groupBy("doc_id").agg(F.collect_list("block").alias("blocks"))
    windows = shared_table(boundary_windows(documents.join(asked, "doc_id"), window, group), "windows")
    repeated = _later(windows, "window", "first-windows")
    return (copied.select("doc_id", F.col("block").alias("copied"), F.lit(None).cast("long").alias("repeated"))
            .unionByName(repeated.select("doc_id", F.lit(None).cast("long").alias("copied"), F.col("window").alias("repeated")))
            .groupBy("doc_id").agg(F.collect_set("copied").alias("copied"), F.collect_set("repeated").alias("repeated")))


def remove_passages(documents: DataFrame, text: str = "text", window: int = WINDOW, group: int = GROUP,
                    layout: bool = False) -> DataFrame:
    """The columns of ``documents`` with ``n_words``, ``n_removed``, ``spans`` and ``kept`` (other columns pass through).

    ``spans`` lists the first word and the number of words of each removed span.
    ``kept`` is the text that stays: its words joined by one space, or with
    ``layout`` the text itself without the bytes of the removed spans.
    """
    whole = documents.withColumn("__text", F.col(f"`{text}`").cast("string").cast("binary"))
    found = shared_table(factor_table(whole.select("doc_id", "__text"), window, group), "factors")
    carried = [c for c in documents.columns if not (layout and c == text)]
    joined = whole.select(*[F.col(f"`{c}`") for c in carried], "__text").join(
        found.withColumnsRenamed({"doc_id": "__doc_id", "copied": "__copied", "repeated": "__repeated"}),
        F.col("doc_id") == F.col("__doc_id"), "left").drop("__doc_id")
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:len(carried)]]
    made = ["n_words long", "n_removed long", "spans array<struct<start:long,words:long>>", "kept string"]

    def run(batches):
        for batch in text_batches(batches, "__text", BATCH):
            copied, repeated = batch.column("__copied").to_pylist(), batch.column("__repeated").to_pylist()
            n_words, n_removed, spans, kept = [], [], [], []
            for i, (raw, starts, ends, parse) in enumerate(parsed(batch.column("__text").to_pylist(), window, group)):
                own = parse.factors(_numbers(copied[i]), _numbers(repeated[i])) if copied[i] or repeated[i] else []
                n_words.append(len(starts))
                n_removed.append(sum(n for _, n in own))
                spans.append([{"start": a, "words": n} for a, n in own])
                if layout:
                    cuts = [0, *[int(x) for a, n in own for x in (starts[a], starts[a + n] if a + n < len(starts) else len(raw))], len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])).decode())
                else:
                    cuts = [0, *[x for a, n in own for x in (a, a + n)], len(starts)]
                    words = raw.split()
                    kept.append(b" ".join([w for a, b in zip(cuts[::2], cuts[1::2]) for w in words[a:b]]).decode())
            if layout:                                        # a null text stays null
                kept = [k if known else None for k, known in zip(kept, batch.column("__text").is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(carried))], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))), pa.array(kept, pa.string())],
                names=[*carried, "n_words", "n_removed", "spans", "kept"])

    return joined.mapInArrow(run, ", ".join([*types, *made]))


def removed_words(documents: DataFrame) -> DataFrame:
    """The registered query."""
    out = remove_passages(documents.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def without_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with the repeated passages cut out of their texts; ``n_chars``, if there, follows."""
    out = remove_passages(packed(documents, "doc_id"), layout=True)
    changed = {"text": F.col("kept")}
    if "n_chars" in documents.columns:
        old = F.col("__row.n_chars")
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(documents.schema["n_chars"].dataType)).otherwise(old)
    return unpacked(out, documents.columns, **changed)

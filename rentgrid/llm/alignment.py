"""Alignment of two tokenizers over whole texts by lockstep merging.

Both token sequences of a text are laid out by the bytes at which their tokens end.
One NumPy state vector holds a pointer into either sequence for every lane, and each
step moves all lanes at once: the two tokens a lane points at are linked, the one
that ends first is left behind, and where both end at one byte the lane emits a cut.
Finished lanes are compacted away. A text is one lane, or several where it is long: a
lane begins at every ``LANE``-th token of the first tokenizer, beside the token of the
second that covers the same byte. So steps follow from the lane, not from the longest text.

Corpus counts of linked id pairs are combined per block of texts in the task, then
per pair in the shuffle. Each block asks for the counts of its distinct pairs once,
so a pair that every text holds is one row per block, and texts never move.

Defined results: a text that is null or empty, or that either tokenizer changes (its
tokens' bytes differ from a space and the text), has no tokens: zeros and an empty
``groups_sha256``. Repeated rows and rows without an id count as documents of their
own. Texts of any length are aligned whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.llm.bpe import Vocabulary, encode_block, pretokenizer, spread
from rentgrid.llm.common import sent, text_batches
from rentgrid.session import shared_table

#: Tokens of the first tokenizer in a lane.
LANE = 256
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: A pair of ids as one number: the first id times this, and the second.
PAIR = 1 << 32


class Pieces:
    """A sentence-piece model: ids of whole texts and the bytes of every id."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.model.get_piece_size()
        strings = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in ((i, self.model.id_to_piece(i)) for i in range(size))]
        self.length = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        listed = [np.asarray(self.model.encode(t), np.int64) for t in texts]
        return np.concatenate([*listed, np.empty(0, np.int64)]), np.array([len(x) for x in listed], np.int64)


class Tokenizers:
    """Both tokenizers of an alignment, built in a task from the contents of their files."""

    def __init__(self, byte_level: str, pieces: bytes):
        self.a = Vocabulary(byte_level)
        self.a.added = {}                                     # their strings in a text are plain text
        self.cut = pretokenizer(self.a)
        self.b = Pieces(pieces)
        self.decimal = [str(i).encode() for i in range(max(self.a.size, len(self.b.length)))]

    def encode(self, texts: Sequence[str]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]:
        """Per tokenizer ``(ids, lengths in bytes, tokens of each text)``; texts that either changes have none."""
        spaced = [" " + t if t else "" for t in texts]
        a, n_a = encode_block(spaced, self.a, self.cut)
        b, n_b = self.b.encode([t or "" for t in texts])
        raw = [t.encode() for t in spaced]
        size = np.array([len(t) for t in raw], np.int64)
        whole = np.frombuffer(b"".join(raw), np.uint8)
        same = np.ones(len(texts), bool)
        out = []
        for ids, counts, start, length, held in ((a, n_a, self.a.piece_start, self.a.piece_length, self.a.pieces),
                                                 (b, n_b, self.b.start, self.b.length, self.b.bytes)):
            lengths = length[ids]
            reach = np.append(0, np.cumsum(lengths))
            ends = np.cumsum(counts)
            total = reach[ends] - reach[ends - counts]
            equal = total == size
            # the bytes of texts of the right length, side by side
            token = np.repeat(equal, counts)
            made = held[spread(start[ids[token]], lengths[token])]
            differs = np.append(0, np.cumsum(made != whole[np.repeat(equal, size)]))
            stops = np.cumsum(np.where(equal, size, 0))
            same &= equal & (differs[stops] == differs[stops - np.where(equal, size, 0)])
            out.append((ids, lengths, counts))
        kept = []
        for ids, lengths, counts in out:
            token = np.repeat(same, counts)
            kept.append((ids[token], lengths[token], np.where(same, counts, 0)))
        return tuple(kept)


@dataclass
class Merged:
    """What the lanes emitted: links between token positions, and after which tokens both sequences are cut."""

    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def merge(a_lengths: np.ndarray, b_lengths: np.ndarray, n_a: np.ndarray, lane: int = LANE) -> Merged:
    """Align token sequences that cover the same bytes, all texts one after another.

    ``n_a`` is the number of first tokens of each text; all positions are those of the whole block.
    """
    a_end, b_end = np.cumsum(a_lengths), np.cumsum(b_lengths)
    stop_of_text = np.cumsum(n_a)
    lanes = -(-n_a // lane)
    text = np.repeat(np.arange(len(n_a)), lanes)
    first = (stop_of_text - n_a)[text] + lane * (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop = np.minimum(first + lane, stop_of_text[text])
    at_a = first
    at_b = np.searchsorted(b_end, a_end[first] - a_lengths[first], side="right")     # covers the byte where the lane begins
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(at_a):
        links_a.append(at_a)
        links_b.append(at_b)
        x, y = a_end[at_a], b_end[at_b]
        cut = x == y
        cuts_a.append(at_a[cut])
        cuts_b.append(at_b[cut])
        at_a, at_b = at_a + (x <= y), at_b + (y <= x)
        open_ = at_a < stop
        if not open_.all():
            at_a, at_b, stop = at_a[open_], at_b[open_], stop[open_]
    join = lambda parts: np.concatenate([*parts, np.empty(0, np.int64)]).astype(np.int64)
    return Merged(join(links_a), join(links_b), np.sort(join(cuts_a)), np.sort(join(cuts_b)))


def written_groups(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, merged: Merged, decimal: list) -> list[bytes]:
    """Per text ``a1,a2|b1;a3|b2,b3``: the ids of both tokenizers, group by group."""
    after_a, after_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    after_a[merged.cut_a], after_b[merged.cut_b] = 1, 2       # what follows a token: `,`, `|` or `;`
    group_a = np.cumsum(after_a == 1) - (after_a == 1)        # the group of every token
    group_b = np.cumsum(after_b == 2) - (after_b == 2)
    before_b = np.append(0, np.cumsum(np.bincount(group_b, minlength=len(merged.cut_b))))[group_a]
    through_a = np.cumsum(np.bincount(group_a, minlength=len(merged.cut_a)))[group_b] if len(b) else group_b
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + before_b] = 3 * a + after_a
    code[np.arange(len(b)) + through_a] = 3 * b + after_b
    names = [d + mark for d in decimal for mark in (b",", b"|", b";")]
    ends = np.cumsum(n_a + n_b)
    return [b"".join(map(names.__getitem__, code[e - n:e].tolist()))[:-1] for e, n in zip(ends.tolist(), (n_a + n_b).tolist())]


def counted(keys: np.ndarray, n_links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(distinct keys, code, repeats, codes of each text)``: the pair codes of every text and how often it links them."""
    distinct, code = np.unique(keys, return_inverse=True)
    text = np.repeat(np.arange(len(n_links)), n_links)
    owned, repeats = np.unique(text * max(len(distinct), 1) + code, return_counts=True)
    owner, code = np.divmod(owned, max(len(distinct), 1))
    return distinct, code.astype("<u4"), repeats.astype("<u4"), np.bincount(owner, minlength=len(n_links))


def aligned(documents: DataFrame, byte_level: str, pieces: str, carried: Sequence[str] = ("doc_id",), text: str = "text",
            written: bool = False) -> DataFrame:
    """One row per row: ``carried``, the counts, the groups, and the distinct linked pairs by their codes in the block.

    ``byte_level`` and ``pieces`` are the paths of the tokenizer files (read on the
    driver; their size is fixed). A ``block`` numbers the rows that share ``codes``; the
    last row of a block holds its distinct ``pairs`` with the number of documents that
    hold each (``held``). ``written`` adds the groups as text.
    """
    with open(byte_level, encoding="utf-8") as file, open(pieces, "rb") as model:
        files = sent(documents.sparkSession, (file.read(), model.read()))
    kept = documents.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").cast("string").alias("__text"))
    fields = [*kept.schema.fields[:-1]]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [
        "block long", "n_a long", "n_b long", "n_groups long", "n_links long", "groups_sha256 string",
        "codes binary", "repeats binary", "pairs array<long>", "held array<long>"] + ["groups string"] * written)
    built: list[Tokenizers] = []

    def rows(batch: pa.RecordBatch, block: int) -> pa.RecordBatch:
        tokens = built[0]
        (a, la, n_a), (b, lb, n_b) = tokens.encode(batch.column("__text").to_pylist())
        merged = merge(la, lb, n_a)
        texts = np.repeat(np.arange(len(n_a)), n_a)
        order = np.argsort(merged.link_a, kind="stable")      # lanes emit in steps; back to the order of texts
        link_a, link_b = merged.link_a[order], merged.link_b[order]
        n_links = np.bincount(texts[link_a], minlength=len(n_a)) if len(n_a) else np.empty(0, np.int64)
        n_groups = np.bincount(texts[merged.cut_a], minlength=len(n_a))
        merged.link_a = merged.link_b = None
        distinct, code, repeats, owned = counted(a[link_a] * PAIR + b[link_b], n_links)
        del link_a, link_b, order, texts
        texts_of_groups = written_groups(a, b, n_a, n_b, merged, tokens.decimal)
        del a, b, la, lb, merged
        ends = np.cumsum(owned)
        cut = lambda x: pa.array([x[e - n:e].tobytes() for e, n in zip(ends.tolist(), owned.tolist())], pa.binary())
        last = len(n_a) - 1
        only_last = lambda x: pa.array([None] * last + [x], pa.list_(pa.int64()))
        held = np.bincount(code, minlength=len(distinct)).astype(np.int64)
        made = [pa.array(np.full(len(n_a), block)), pa.array(n_a), pa.array(n_b), pa.array(n_groups.astype(np.int64)), pa.array(n_links.astype(np.int64)),
                pa.array([hashlib.sha256(g).hexdigest() if n else "" for g, n in zip(texts_of_groups, n_a.tolist())], pa.string()),
                cut(code), cut(repeats), only_last(distinct), only_last(held)]
        if written:
            made.append(pa.array([g.decode() for g in texts_of_groups], pa.string()))
        return pa.RecordBatch.from_arrays([*batch.columns[:len(carried)], *made], names=[
            *carried, "block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "repeats", "pairs", "held", *["groups"] * written])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if not built:
            built.append(Tokenizers(*files()))
        block = TaskContext.get().partitionId() << 32
        for batch in text_batches(batches, "__text", BLOCK_BYTES):
            yield rows(batch, block)
            block += 1

    return kept.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, n, best``: in how many documents each linked id pair occurs, and whether no pair of its first id occurs in more."""
    totals = (blocks.where("pairs IS NOT NULL").select(F.inline(F.arrays_zip("pairs", "held")))
              .groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("n")))
    totals = shared_table(totals, "pair-counts")
    first = F.expr(f"pair div {PAIR}").alias("id_a")
    most = totals.groupBy(first).agg(F.max("n").alias("most"))
    return totals.withColumn("id_a", first).join(most, "id_a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def summed(blocks: DataFrame, counts: DataFrame, carried: Sequence[str]) -> DataFrame:
    """``carried``, the counts of every row and, over its links, ``n_best`` and ``count_sum`` of ``counts``.

    A block's rows meet the counts of its own distinct pairs; both are bounded by the block.
    """
    asked = blocks.where("pairs IS NOT NULL").select("block", F.posexplode("pairs").alias("code", "pair"))
    answers = (asked.join(counts, "pair").select(F.col("block").alias("asker"), "code", "n", "best"))
    own = blocks.select(*carried, "block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "repeats")
    plain = [c for c in own.columns if c not in ("block", "codes", "repeats")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name in plain]
                       + ["n_best long", "count_sum long"])

    def of_block(rows: pa.Table, found: pa.Table) -> pa.Table:
        code = found.column("code").to_numpy()
        n, best = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        n[code] = found.column("n").to_numpy()
        best[code] = found.column("best").to_numpy(zero_copy_only=False)
        sums, bests = [], []
        for codes, repeats in zip(rows.column("codes").to_pylist(), rows.column("repeats").to_pylist()):
            at, times = np.frombuffer(codes, "<u4"), np.frombuffer(repeats, "<u4").astype(np.int64)
            sums.append(int(n[at] @ times))
            bests.append(int(best[at] @ times))
        out = rows.select(plain)
        return out.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    return own.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(of_block, schema)


def alignments(documents: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """The registered query."""
    blocks = shared_table(aligned(documents, byte_level, pieces), "alignment")
    rows = summed(blocks, pair_counts(blocks), ["doc_id"])
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

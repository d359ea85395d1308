"""Byte-level BPE encoding and decoding through a pair occurrence index.

The distinct pre-tokens of a block of documents are laid out in one array of
symbols with links to their neighbours. An index maps the rank of every adjacent
pair to all positions in the block that hold it. Active ranks are applied in
ascending order: all positions of a rank are merged at once, and only the pairs
next to a merge enter the index anew. A document's ids are then gathered from its
pre-tokens.

Defined results: a null text counts as empty, an empty text has no ids; repeated
rows and null ids of documents are kept as they are; a text of any length is
encoded whole. The block bounds the memory of a task, not the result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.llm.common import BATCH_BYTES, per_document, text_batches


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """A byte-level BPE tokenizer file as arrays: merges by rank, bytes of every id, added tokens."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = (model["type"] == "BPE" and not any(model.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and spec["normalizer"] is None and pre["type"] == "ByteLevel" and not pre["add_prefix_space"]
            and pre.get("use_regex", True) and spec["decoder"]["type"] == "ByteLevel"
            and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")))
        if not plain:
            raise ValueError("only byte-level BPE files without normalizer, dropout and stripping added tokens are supported")
        to_byte, ids = byte_characters(), model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        first = np.full(self.size, -1)                       # the rank that makes a symbol
        first[self.made[::-1]] = np.arange(len(pairs))[::-1]
        if (np.maximum(first[self.left], first[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge comes before the merges that make its parts")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: bytes(to_byte[c] for c in s) for s, i in ids.items()} | {i: s.encode() for s, i in self.added.items()}
        parts = [strings.get(i, b"") for i in range(self.size)]
        self.piece_length = np.array([len(p) for p in parts], np.int64)
        self.piece_start = np.cumsum(self.piece_length) - self.piece_length
        self.pieces = np.frombuffer(b"".join(parts), np.uint8)
        self.byte_id = np.array([ids[c] for c, b in sorted(to_byte.items(), key=lambda x: x[1])], np.int64)
        keys = self.left * (self.size + 1) + self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        key = left * (self.size + 1) + right
        at = np.minimum(self.keys.searchsorted(key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``start, start + 1, ...`` of all ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def merge_words(words: Sequence[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and the number of ids of each word. Words are not empty."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    n, none = len(raw), vocabulary.size
    if not n:
        return np.empty(0, np.int64), lengths
    ends = np.cumsum(lengths)
    symbol = np.append(vocabulary.byte_id[raw], none)         # slot n stands before and after every word
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends - 1], before[ends - lengths] = n, n
    index: dict[int, list[np.ndarray]] = {}                   # rank -> positions of its pair
    active: list[int] = []

    def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
        known = ranks >= 0
        positions, ranks = positions[known], ranks[known]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, some in zip(ranks[np.append(0, cuts)].tolist(), np.split(positions, cuts)):
            if rank in index:
                index[rank].append(some)
            else:
                index[rank] = [some]
                heapq.heappush(active, rank)

    byte_ranks = vocabulary.ranks(np.repeat(vocabulary.byte_id, 256), np.tile(vocabulary.byte_id, 256))
    first = byte_ranks[raw[:-1].astype(np.int64) * 256 + raw[1:]]
    first[ends[:-1] - 1] = -1
    enter(np.arange(n - 1), first)
    while active:
        rank = heapq.heappop(active)
        left, right, made = (int(x[rank]) for x in (vocabulary.left, vocabulary.right, vocabulary.made))
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        at = at[symbol[at] == left]
        at = at[symbol[after[at]] == right]
        if left == right and len(at) > 1:                     # in a run of one symbol, pairs from the left
            at = np.unique(at)
            chained = np.append(False, after[at[:-1]] == at[1:])
            begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        symbol[at], symbol[gone] = made, none
        beyond = after[gone]
        after[at], before[beyond] = beyond, at
        ahead = before[at]
        enter(np.concatenate([ahead, at]), vocabulary.ranks(
            np.concatenate([symbol[ahead], np.full(len(at), made)]),
            np.concatenate([np.full(len(at), made), symbol[beyond]])))
    alive = symbol[:n] != none
    return symbol[:n][alive], np.add.reduceat(alive.astype(np.int64), ends - lengths)


def pretokenizer(vocabulary: Vocabulary):
    """A function from a text to its pieces: ``(pre-token, is an added token)`` lists."""
    import regex

    ascii_words = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII).findall
    words = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
                          r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+").findall
    marks = re.compile("(" + "|".join(re.escape(t) for t in sorted(vocabulary.added, key=len, reverse=True)) + ")") if vocabulary.added else None

    def pieces(text: str) -> list:
        cut = ascii_words if text.isascii() else words
        if marks is None or not marks.search(text):
            return cut(text)
        found: list = []
        for i, part in enumerate(marks.split(text)):
            found += [(part,)] if i % 2 else cut(part)        # a tuple marks an added token
        return found

    return pieces


class Codes(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = code = len(self)
        return code


def encode_block(texts: Sequence[str], vocabulary: Vocabulary, pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and the number of ids of each text."""
    codes = Codes()
    listed = []
    for text in texts:
        found = pieces(text)
        listed.append(np.fromiter(map(codes.__getitem__, found), np.int64, len(found)))
    plain = [p.encode() for p in codes if not isinstance(p, tuple)]
    is_plain = np.fromiter((not isinstance(p, tuple) for p in codes), bool, len(codes))
    ids, counts = merge_words(plain, vocabulary)
    lengths, starts = np.ones(len(codes), np.int64), np.zeros(len(codes), np.int64)
    lengths[is_plain], starts[is_plain] = counts, np.cumsum(counts) - counts
    extra = [vocabulary.added[p[0]] for p in codes if isinstance(p, tuple)]
    starts[~is_plain] = len(ids) + np.arange(len(extra))
    ids = np.concatenate([ids, np.array(extra, np.int64)])
    order = np.concatenate([*listed, np.empty(0, np.int64)])
    flat = ids[spread(starts[order], lengths[order])]
    sums = np.append(0, np.cumsum(lengths[order]))
    text_ends = np.cumsum([len(x) for x in listed])
    return flat, np.diff(np.append(0, sums[text_ends])) if len(listed) else np.empty(0, np.int64)


def decode_ids(ids: np.ndarray, vocabulary: Vocabulary) -> bytes:
    """The bytes of the ids; an id that the vocabulary does not know adds nothing."""
    ids = ids[(ids >= 0) & (ids < vocabulary.size)].astype(np.int64)
    return vocabulary.pieces[spread(vocabulary.piece_start[ids], vocabulary.piece_length[ids])].tobytes()


def readable(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def shipped(df: DataFrame, path: str):
    """The tokenizer file at ``path`` (read on the driver; its size is fixed) as a function that builds it in a task."""
    with open(path, encoding="utf-8") as file:
        sent = df.sparkSession.sparkContext.broadcast(file.read())
    kept: list[Vocabulary] = []

    def vocabulary() -> Vocabulary:
        if not kept:
            kept.append(Vocabulary(sent.value))
        return kept[0]

    return vocabulary


def encode(df: DataFrame, path: str, carried: Sequence[str], text: str = "text", decoded: bool = False,
           size: int = BATCH_BYTES) -> DataFrame:
    """``carried``, ``n_tokens`` and ``ids``: the ids as little-endian unsigned 32-bit integers.

    ``size`` is the text of a block in bytes; it bounds memory and changes no result.

    With ``decoded`` the ids are also turned back, into the string column ``decoded``.
    """
    vocabulary = shipped(df, path)
    schema = "n_tokens long, ids binary" + ", decoded string" * decoded
    made: list = []

    def columns(texts: list[str]) -> dict[str, list]:
        if not made:
            made.append(pretokenizer(vocabulary()))
        flat, counts = encode_block(texts, vocabulary(), made[0])
        ends = np.cumsum(counts)
        packed = flat.astype("<u4")
        out = {"n_tokens": pa.array(counts, pa.int64()),
               "ids": [packed[e - c:e].tobytes() for e, c in zip(ends.tolist(), counts.tolist())]}
        if decoded:
            out["decoded"] = [readable(decode_ids(flat[e - c:e], vocabulary())) for e, c in zip(ends.tolist(), counts.tolist())]
        return {k: v if isinstance(v, pa.Array) else pa.array(v, pa.binary() if k == "ids" else pa.string()) for k, v in out.items()}

    return per_document(df, carried, text, schema, columns, size)


def decode(df: DataFrame, path: str, carried: Sequence[str], ids: str = "ids") -> DataFrame:
    """``carried`` and ``decoded``: the text of packed ids (null: empty); bytes that are not UTF-8 become U+FFFD."""
    vocabulary = shipped(df, path)
    kept = df.select(*carried, F.coalesce(F.col(ids), F.lit(b"")).alias("__ids"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches):
        for batch in text_batches(batches, "__ids", BATCH_BYTES):
            texts = [readable(decode_ids(np.frombuffer(x, "<u4"), vocabulary())) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(carried))], pa.array(texts, pa.string())],
                                             names=[*carried, "decoded"])

    return kept.mapInArrow(run, f"{types}, decoded string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """The registered query: ids and round trip of every whole text, as digests."""
    turned = encode(documents, path, ["doc_id"], decoded=True)
    return turned.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                         F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

"""Words of whole texts as arrays: positions, 64-bit hashes and counts, a batch of texts at a time."""

from __future__ import annotations

import numpy as np

#: The odd multiplier of the word hash.
LETTER = 0x9E3779B97F4A7C15

_BYTE = np.arange(256)
#: ASCII white space: what stands between words ``[^\x20\x09-\x0D]+``.
SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
#: The first byte of every code point.
LEADING = (_BYTE & 0xC0) != 0x80
#: Bytes of letters, where anything outside ASCII counts as one.
LETTERS = (_BYTE >= 128) | ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122))


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64 bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """``1, base, base**2, ...`` modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def runs(letters: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of bytes marked in ``kinds`` begin and end."""
    inside = np.concatenate([[0], kinds[letters].view(np.int8), [0]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where words begin and end; words are what lies between ASCII white space."""
    return runs(np.frombuffer(raw, np.uint8), ~SPACE)


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """Hashes of all words and, for each length in ``prefixes``, of their first bytes."""
    if not len(starts):
        return [np.empty(0, np.uint64)] * (1 + len(prefixes))
    lengths = ends - starts
    total = np.cumsum(lengths)
    place = np.arange(total[-1]) - np.repeat(total - lengths, lengths)
    terms = (np.frombuffer(raw, np.uint8)[place + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)) * powers(
        LETTER, int(lengths.max()))[place]
    return [mixed(np.add.reduceat(terms if p is None else np.where(place < p, terms, np.uint64(0)), total - lengths))
            for p in (None, *prefixes)]


class Batch:
    """Texts of a batch laid end to end, with the words of each."""

    def __init__(self, texts: list, lower: bool = False, kinds: np.ndarray | None = None):
        self.texts = [(t.encode("utf-8", "replace") if isinstance(t, str) else t) or b"" for t in texts]
        if lower:
            self.texts = [t.lower() for t in self.texts]
        self.raw = b"\n".join(self.texts)
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self.starts, self.ends = runs(self.bytes, ~SPACE if kinds is None else kinds)
        self.offsets = np.cumsum([0, *[len(t) + 1 for t in self.texts]])
        self.cuts = np.searchsorted(self.starts, self.offsets)  # the first word of each text
        self.n_words = np.diff(self.cuts)

    def count(self, kinds: np.ndarray) -> np.ndarray:
        """Per text, the number of bytes marked in ``kinds``."""
        sums = np.append(0, np.cumsum(kinds[self.bytes]))
        return sums[np.minimum(self.offsets[1:] - 1, len(self.bytes))] - sums[self.offsets[:-1]]


def base_statistics(batch: Batch, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: words, code points in words, symbols, repeated lines and words in repeated 3-word windows."""
    symbols = np.isin(_BYTE, list(b"#*$%&|<>"))
    dup_lines, repeats, lines = [], [], []
    triple = hashes[:-2] + hashes[1:-1] * np.uint64(LETTER) + hashes[2:] * np.uint64(LETTER) * np.uint64(LETTER) if len(hashes) > 2 else hashes[:0]
    for i, text in enumerate(batch.texts):
        filled = [x for x in text.split(b"\n") if x.strip()]
        lines.append(len(filled))
        dup_lines.append(len(filled) - len(set(filled)))
        lo, n = batch.cuts[i], batch.n_words[i]
        if n < 4:
            repeats.append(0)
            continue
        _, inverse, counts = np.unique(triple[lo:lo + n - 2], return_inverse=True, return_counts=True)
        hit = np.append(counts[inverse] > 1, [False, False])
        repeats.append(int((hit | np.append(False, hit[:-1]) | np.append([False, False], hit[:-2])).sum()))
    return {"n_words": batch.n_words.astype(np.int64), "word_chars": batch.count(LEADING & ~SPACE), "n_symbols": batch.count(symbols),
            "n_dup_lines": np.array(dup_lines, np.int64), "n_repeat_words": np.array(repeats, np.int64), "n_lines": np.array(lines, np.int64)}


#: What the quality models see of a text.
FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "exclamations", "stops", "bars", "other_marks", "beyond_ascii",
            "dup_lines", "repeat_words", "distinct_words", "top_word", "line_words")


def text_features(batch: Batch, hashes: np.ndarray, base: dict[str, np.ndarray]) -> np.ndarray:
    """One row of ``FEATURES`` per text; a text without words has zeros but for what its marks give."""
    count = batch.count
    marks = lambda s: np.isin(_BYTE, list(s))
    upper, digits = (_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 48) & (_BYTE <= 57)
    words, chars = np.maximum(base["n_words"], 1), np.maximum(count(LEADING), 1)
    top, distinct = [], []
    for i in range(len(batch.texts)):
        own = np.unique(hashes[batch.cuts[i]:batch.cuts[i + 1]], return_counts=True)[1]
        distinct.append(len(own))
        top.append(own.max() if len(own) else 0)
    known = marks(b"!.,|#*$%&<>") | LETTERS | digits | SPACE
    return np.column_stack([
        np.log1p(base["n_words"]), base["word_chars"] / words, base["n_symbols"] / chars, count(upper) / chars, count(digits) / chars,
        count(marks(b"!")) / chars, count(marks(b".,")) / chars, count(marks(b"|")) / chars, count(~known) / chars,
        count((_BYTE >= 192)) / chars, base["n_dup_lines"] / np.maximum(base["n_lines"], 1), base["n_repeat_words"] / words,
        np.array(distinct) / words, np.array(top) / words, np.log1p(words / np.maximum(base["n_lines"], 1))]).astype(np.float64)


def described(texts: list) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base statistics and features of the texts."""
    batch = Batch(texts)
    hashes = word_hashes(batch.raw, batch.starts, batch.ends)[0]
    base = base_statistics(batch, hashes)
    return base, text_features(batch, hashes, base)

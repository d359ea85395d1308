"""Near-duplicate groups by SimHash and a Gray-order hierarchical index.

Fingerprints that differ in at most ``distance`` bits agree in at least
``blocks - distance`` of ``blocks`` bit blocks. Every distinct fingerprint is dealt
once per choice of such blocks to the bucket of its bits there, so two linked
fingerprints meet in a bucket. A bucket is sorted by Gray rank. Upper nodes over
runs of that order hold the bits which all their members share; pairs of nodes are
compared from the top: shared bits that differ add up, and a pair of whole groups
is dropped above ``distance``, linked at once where even the free bits cannot
exceed it, and skipped where both already belong to one component. Buckets of more
than ``bucket_rows`` fingerprints are dealt in pieces, each pair of pieces to a
task of its own, so no task holds a whole hot bucket and no link is lost.

Defined results: a null text has no words; a text without words has fingerprint
zero, linked like any other. Copies share a fingerprint and are one node. A row
with a null ``doc_id`` is fingerprinted and belongs to its group; the group's id is
the smallest id that is not null (null if there is none). Repeated rows stay.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentgrid.llm.common import per_document
from rentgrid.llm.components import component_roots
from rentgrid.session import shared_table

#: A bucket with more distinct fingerprints is dealt in pieces.
BUCKET_ROWS = 50_000


def fingerprint(text: str, shingle_words: int = 4, seed: int = 42) -> int:
    """The majority bits of the XXH64 hashes of a text's word shingles, repeats included."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()    # lower() and split() know ASCII only
    if not words:
        return 0
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:max(1, len(words) - shingle_words + 1)].tolist()
    hashes = np.array([digest(flat[a:b], seed) for a, b in zip(starts, ends[min(shingle_words, len(words)) - 1:].tolist())], ">u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, text: str = "text", shingle_words: int = 4) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every whole text as a signed 64-bit number."""
    def columns(texts):
        made = np.array([fingerprint(t, shingle_words) for t in texts], np.uint64)
        return {"fp": pa.array(made.view(np.int64), pa.int64())}

    return per_document(documents, ["doc_id"], text, "fp long", columns)


def gray_rank(fp: str) -> Column:
    """The position of a fingerprint in Gray-code order, moved so that signed numbers sort by it."""
    rank = F.col(fp)
    for step in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, step))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def block_masks(blocks: int, distance: int) -> list[int]:
    """One mask per choice of ``blocks - distance`` of the bit blocks, as signed numbers."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(parts[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class GrayIndex:
    """Upper nodes over fingerprints sorted by bucket and Gray rank, and the search for links in it."""

    def __init__(self, fps: np.ndarray, distance: int):
        self.fps, self.distance, n = fps, distance, len(fps)
        self.ands, self.ors = [fps], [fps]                    # bits that runs of 1, 2, 4, ... members share
        while 2 << (len(self.ands) - 1) <= n:
            half = 1 << (len(self.ands) - 1)
            for table, join in ((self.ands, np.bitwise_and), (self.ors, np.bitwise_or)):
                table.append(join(table[-1][:-half], table[-1][half:]))
        self.label = np.arange(n)

    def node(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shared pattern of the members ``lo..hi-1`` and the mask of the bits in which they agree."""
        every, some = np.empty(len(lo), np.uint64), np.empty(len(lo), np.uint64)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            at = level == k
            left, right = lo[at], hi[at] - (1 << k)
            every[at] = self.ands[k][left] & self.ands[k][right]
            some[at] = self.ors[k][left] | self.ors[k][right]
        return every, ~(every ^ some)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.label[u], self.label[v]
            open_ = a != b
            u, v, a, b = u[open_], v[open_], a[open_], b[open_]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                nearer = self.label[self.label]
                if (nearer == self.label).all():
                    break
                self.label = nearer

    def search(self, starts: np.ndarray, ends: np.ndarray, pairs: int = 1 << 16) -> np.ndarray:
        """Link the members of every bucket ``starts..ends-1``; returns the least linked position of each member."""
        n = len(self.fps)
        bucket = np.repeat(np.arange(len(starts)), ends - starts)
        near = np.flatnonzero((np.bitwise_count(self.fps[1:] ^ self.fps[:-1]) <= self.distance) & (bucket[1:] == bucket[:-1]))
        self.link(near, near + 1)
        stack = [np.stack([starts, ends, starts, ends], axis=1)]
        while stack:
            front = stack.pop()
            if len(front) > pairs:
                stack.append(front[:-pairs])
                front = front[-pairs:]
            changes = np.append(0, np.cumsum(self.label[1:] != self.label[:-1])) if n else np.zeros(0, np.int64)
            alo, ahi, blo, bhi = front.T
            one = ((changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo])
                   & (self.label[alo] == self.label[blo]))
            alo, ahi, blo, bhi = front[~one].T
            if not len(alo):
                continue
            a_bits, a_mask = self.node(alo, ahi)
            b_bits, b_mask = self.node(blo, bhi)
            both = a_mask & b_mask
            least = np.bitwise_count((a_bits ^ b_bits) & both).astype(np.int64)
            most = least + np.bitwise_count(~both)
            whole = (most <= self.distance)
            same = alo == blo
            inner = np.flatnonzero(whole & same)
            if len(inner):
                sizes = ahi[inner] - alo[inner] - 1
                ends_ = np.cumsum(sizes)
                run = np.repeat(alo[inner] - (ends_ - sizes), sizes) + np.arange(ends_[-1])
                self.link(run, run + 1)
            across = whole & ~same
            self.link(alo[across], blo[across])
            alo, ahi, blo, bhi = (x[~whole & (least <= self.distance)] for x in (alo, ahi, blo, bhi))
            same = (alo == blo) & (ahi == bhi)
            first = same | (ahi - alo >= bhi - blo)
            middle = np.where(first, (alo + ahi) // 2, (blo + bhi) // 2)
            parts = []
            for chosen, columns in (
                    (same, (alo, middle, alo, middle)), (same, (middle, ahi, middle, ahi)), (same, (alo, middle, middle, ahi)),
                    (~same & first, (alo, middle, blo, bhi)), (~same & first, (middle, ahi, blo, bhi)),
                    (~first, (alo, ahi, blo, middle)), (~first, (alo, ahi, middle, bhi))):
                parts.append(np.stack([c[chosen] for c in columns], axis=1))
            following = np.concatenate(parts)
            following = following[(following[:, 1] > following[:, 0]) & (following[:, 3] > following[:, 2])]
            alone = (following[:, 0] == following[:, 2]) & (following[:, 1] - following[:, 0] == 1)
            if len(following := following[~alone]):
                stack.append(following)
        return self.label


def bucket_links(distance: int, rows_at_once: int = 200_000):
    """A function for ``mapInArrow``: rows sorted by ``bucket`` and Gray rank to links ``(a, b)`` of fingerprints."""
    def links(buckets: np.ndarray, fps: np.ndarray):
        starts = np.append(0, np.flatnonzero(buckets[1:] != buckets[:-1]) + 1)
        ends = np.append(starts[1:], len(buckets))
        several = np.repeat(ends - starts > 1, ends - starts)
        fps, sizes = fps[several], (ends - starts)[ends - starts > 1]
        if not len(fps):
            return None
        ends = np.cumsum(sizes)
        root = GrayIndex(fps, distance).search(ends - sizes, ends)
        linked = root != np.arange(len(fps))
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (fps[linked], fps[root[linked]])],
                                          names=["a", "b"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            count += batch.num_rows
            if count < rows_at_once:
                continue
            buckets, fps = (np.concatenate(x) for x in zip(*held))
            last = len(buckets) - int((buckets[::-1] != buckets[-1]).argmax()) if buckets[0] != buckets[-1] else 0
            if last and (out := links(buckets[:last], fps[:last])) is not None:
                yield out
            held, count = [(buckets[last:], fps[last:])], len(buckets) - last
        if count:
            buckets, fps = (np.concatenate(x) for x in zip(*held))
            if (out := links(buckets, fps)) is not None:
                yield out

    return run


def fingerprint_links(nodes: DataFrame, distance: int = 4, blocks: int | None = None,
                      bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the distinct fingerprints ``fp`` within ``distance`` bits of each other.

    More blocks mean smaller buckets and more copies; by default their number follows from the number of rows.
    """
    if blocks is None:
        rows = nodes.count()
        blocks = distance + (2 if rows < 1 << 24 else 3 if rows < 1 << 30 else 4)
    masks = block_masks(blocks, distance)
    choices = F.array(*[F.struct(F.lit(i).cast("short").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits"))
                        for i, m in enumerate(masks)])
    dealt = nodes.select("fp", F.inline(choices))
    hot = shared_table(dealt.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
                       .select("choice", "bits", F.ceil(F.col("n") / (bucket_rows / 2)).cast("int").alias("pieces")), "hot")
    pieces = F.coalesce("pieces", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), pieces).cast("int")
    partners = F.sequence(F.lit(0), pieces - 1)
    cut = dealt.join(hot, ["choice", "bits"], "left").select(
        "fp", "choice", "bits", own.alias("own"), F.explode(partners).alias("other"))
    bucket = F.xxhash64("choice", "bits", F.least("own", "other"), F.greatest("own", "other"))
    placed = cut.select(bucket.alias("bucket"), "fp")
    return (placed.repartition("bucket").sortWithinPartitions("bucket", gray_rank("fp"))
            .mapInArrow(bucket_links(distance), "a long, b long"))


def near_duplicates(documents: DataFrame, text: str = "text", distance: int = 4, shingle_words: int = 4,
                    bucket_rows: int = BUCKET_ROWS, blocks: int | None = None) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``documents``."""
    marked = shared_table(fingerprints(documents, text, shingle_words), "fingerprints")
    nodes = shared_table(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = component_roots(fingerprint_links(nodes, distance, blocks, bucket_rows))
    placed = nodes.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = shared_table(placed, "placed")
    names = shared_table(placed.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    named = shared_table(placed.join(names, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def kept_documents(documents: DataFrame, **parameters) -> DataFrame:
    """One row of each near-duplicate group, the one with the smallest id; rows without an id stay as they are."""
    groups = near_duplicates(documents, **parameters)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = documents.where(F.col("doc_id").isNotNull()).join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(documents.columns).unionByName(documents.where(F.col("doc_id").isNull()))


def groups(documents: DataFrame) -> DataFrame:
    """The registered query."""
    return near_duplicates(documents).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample: the centred vectors are turned to their
principal axes, and then the rotation and the signs of the turned vectors are fitted
to one another in turn, which gives balanced bits that lose little. The signs under all rotations
are the code of a vector. Its bits, dealt in several orders, are cut into
substrings, and a table per substring holds the vectors by their bits there. How
many tables are needed follows from how often vectors at just the least similarity
agree in a substring, measured on the sample, so the recall aimed at is the same at every
size; substrings grow with the number of vectors, so that buckets do not.

Buckets hold codes alone. A vector that has another one within the Hamming distance
in a bucket is sent there once more with its components, and those vectors are compared in
double precision, block by block. A pair counts in the first table whose substring both
share, which their codes tell, so no row per pair is made. Buckets with many vectors
are dealt in pieces, each pair of pieces to a task of its own; nothing is capped.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are components of their own. Equal vectors are one node that
counts every copy. A shorter vector counts as followed by zeros. Rows without an id take part; a
component's id is its smallest id that is not null (null if there is none; an unlinked
row's own). Repeated rows stay and link with one another. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.llm.common import sent
from rentgrid.llm.components import component_roots
from rentgrid.llm.simhash import GrayIndex
from rentgrid.session import shared_table

#: Vectors the rotations are learned from, bits of a code, the share of close pairs that the tables aim to find.
SAMPLE, BITS, AIM = 10_000, 128, 0.995
#: The most vectors in a bucket that one task compares whole.
BUCKET_ROWS = 8_192


def unit(rows: list, width: int) -> np.ndarray:
    """Vectors of length one, in double precision."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def quantised(x: np.ndarray, bits: int, seed: int, steps: int = 40) -> np.ndarray:
    """A projection ``(components, bits)`` of centred ``x``: principal axes, then a rotation fitted to its own signs."""
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :bits]
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
    flat = x @ axes
    for _ in range(steps):
        left, _, right = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
        turn = (left @ right).T
    return axes @ turn


@dataclass
class Index:
    """What tasks need: the mean, the rotations, the bit positions of every table and the widest Hamming distance."""

    width: int
    mean: np.ndarray
    turns: np.ndarray
    positions: np.ndarray
    distance: int

    @property
    def masks(self) -> np.ndarray:
        """The bits of each table, as two words."""
        chosen = np.zeros((len(self.positions), BITS), np.uint8)
        np.put_along_axis(chosen, self.positions, 1, axis=1)
        return np.packbits(chosen, axis=1, bitorder="little").view(np.uint64)

    def bits(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.turns >= 0).astype(np.uint8)

    def codes(self, bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def keys(self, bits: np.ndarray) -> np.ndarray:
        """The substring of each table as a number."""
        weights = 1 << np.arange(self.positions.shape[1], dtype=np.int64)
        return np.stack([bits[:, p].astype(np.int64) @ weights for p in self.positions], axis=1) if len(bits) else np.zeros((0, len(self.positions)), np.int64)


def learned(sample: np.ndarray, rows: int, similarity: float, aim: float = AIM, seed: int = 11, most: int = 512) -> Index:
    """The index for ``rows`` vectors, from a sample of unit vectors.

    Vectors at exactly the least similarity from those of the sample tell how often a
    table separates them and how far their codes lie apart.
    """
    draw = np.random.default_rng(seed)
    width = sample.shape[1]
    mean = sample.mean(axis=0)
    centred = sample - mean
    turns = np.concatenate([quantised(centred, BITS, seed + i) for i in range(-(-BITS // min(width, BITS)))], axis=1)[:, :BITS]
    length = min(64, max(8, math.ceil(math.log2(max(rows, 2))) - 5))
    per_order = BITS // length
    index = Index(width, mean, turns, np.zeros((0, length), np.int64), 0)
    near = np.concatenate([sample] * -(-2000 // len(sample)))[:max(2000, min(len(sample), 4000))]
    aside = draw.normal(size=near.shape)
    aside -= (aside * near).sum(axis=1, keepdims=True) * near
    norm = np.linalg.norm(aside, axis=1, keepdims=True)
    moved = similarity * near + math.sqrt(1 - similarity ** 2) * aside / np.where(norm > 0, norm, 1)
    differ = index.bits(near) != index.bits(moved)
    index.distance = int(np.quantile(differ.sum(axis=1), 0.9999)) + 2
    missed, orders = np.ones(len(near), bool), []
    while len(orders) * per_order < most:
        order = draw.permutation(BITS)[:per_order * length].reshape(per_order, length)
        orders.append(order)
        for p in order:
            missed &= differ[:, p].any(axis=1)
        if missed.mean() <= 1 - aim:
            break
    index.positions = np.sort(np.concatenate(orders), axis=1)
    return index


def blocks_of(rows: int, size: int = 1024):
    return [(lo, min(lo + size, rows)) for lo in range(0, rows, size)]


def close_by_code(codes: np.ndarray, piece: np.ndarray, distance: int) -> np.ndarray:
    """Whether each vector of a bucket has another one within the distance; of two pieces, one of the other piece."""
    near = np.zeros(len(codes), bool)
    two = len(codes) and (piece != piece[0]).any()
    for lo, hi in blocks_of(len(codes)):
        for other in [s for s in blocks_of(len(codes)) if s[0] >= lo]:
            apart = np.bitwise_count(codes[lo:hi, None, 0] ^ codes[None, other[0]:other[1], 0]).astype(np.int16)
            apart += np.bitwise_count(codes[lo:hi, None, 1] ^ codes[None, other[0]:other[1], 1])
            met = apart <= distance
            if two:
                met &= piece[lo:hi, None] != piece[None, other[0]:other[1]]
            if other[0] == lo:
                np.fill_diagonal(met, False)
            near[lo:hi] |= met.any(axis=1)
            near[other[0]:other[1]] |= met.any(axis=0)
    return near


def close_by_cosine(x: np.ndarray, codes: np.ndarray, piece: np.ndarray, copies: np.ndarray, earlier: np.ndarray,
                    similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """``(links, root)`` of each vector: how many copies of others it links with, and the first vector linked to it.

    ``earlier`` are the masks of earlier tables: a pair that agrees under one of them
    counts there, but is linked here too.
    """
    links, groups = np.zeros(len(x), np.int64), GrayIndex(np.zeros(len(x), np.uint64), 0)
    two = len(x) and (piece != piece[0]).any()
    for lo, hi in blocks_of(len(x)):
        for at, to in [s for s in blocks_of(len(x)) if s[0] >= lo]:
            met = x[lo:hi] @ x[at:to].T >= similarity
            if two:
                met &= piece[lo:hi, None] != piece[None, at:to]
            if at == lo:
                met = np.triu(met, 1)
            i, j = np.nonzero(met)
            i, j = i + lo, j + at
            groups.link(i, j)
            differ = codes[i] ^ codes[j]
            for mask in earlier:
                open_ = ((differ & mask) != 0).any(axis=1)
                i, j, differ = i[open_], j[open_], differ[open_]
            links += np.bincount(i, copies[j], len(x)).astype(np.int64) + np.bincount(j, copies[i], len(x)).astype(np.int64)
    return links, groups.label


def by_cell(batches, compare, rows_at_once: int = 100_000, bytes_at_once: int = 32 << 20):
    """``compare`` of the rows of every cell (the first column, sorted), from batches that end anywhere."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows < rows_at_once and size < bytes_at_once:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cell = table.column(0).to_numpy()
        last = 0 if cell[0] == cell[-1] else len(cell) - int((cell[::-1] != cell[-1]).argmax())
        if last:
            yield from cells(table.slice(0, last), compare)
        rest = table.slice(last).combine_chunks()
        held, rows, size = rest.to_batches(), rest.num_rows, 0        # a cell is bounded, so the next batches end it
    if rows:
        yield from cells(pa.Table.from_batches(held).combine_chunks(), compare)


def cells(table: pa.Table, compare):
    cell = table.column(0).to_numpy()
    starts = np.append(0, np.flatnonzero(cell[1:] != cell[:-1]) + 1)
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)]):
        if hi - lo > 1 and (out := compare(table.slice(lo, hi - lo))) is not None:
            yield out


def usable(vector: str):
    """True for vectors that can be compared."""
    column = F.col(vector)
    whole = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(column.isNotNull() & whole & F.exists(column, lambda x: x != 0), F.lit(False))


def linked_nodes(nodes: DataFrame, similarity: float = 0.95, sample: int = SAMPLE, aim: float = AIM,
                 bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(counts, roots)`` of a table ``node, vector, copies`` of distinct vectors.

    ``counts (node, n)``: the copies of other nodes that each linked node links with;
    ``roots (a, b)``: linked nodes with the smallest node of their component.
    """
    spark = nodes.sparkSession
    rows, width = nodes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    share = min(1.0, sample / max(rows, 1))
    drawn = nodes.where(F.pmod(F.xxhash64(F.lit("itq"), "vector"), F.lit(1 << 30)) < int((1 << 30) * share)).select("vector").limit(2 * sample)
    picked = [r["vector"] for r in drawn.collect()] if rows else []
    if not picked:
        none = spark.createDataFrame([], "node long, n long")
        return none, spark.createDataFrame([], "a long, b long")
    index = learned(unit(picked, width), rows, similarity, aim)
    model = sent(spark, index)

    def code(batches):
        index = model()
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = index.bits(unit(batch.column("vector").to_pylist(), index.width))
            words = index.codes(bits).view(np.int64)
            keys = index.keys(bits)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(words[:, 0]), pa.array(words[:, 1]),
                                              pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))],
                                             names=["node", "low", "high", "keys"])

    coded = shared_table(nodes.select("node", "vector").mapInArrow(code, "node long, low long, high long, keys array<long>"), "codes")
    dealt = coded.select("node", "low", "high", F.posexplode("keys").alias("turn", "key"))
    hot = shared_table(dealt.groupBy("turn", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
                       .select("turn", "key", F.ceil(F.col("n") / (bucket_rows / 2)).cast("int").alias("pieces")), "hot-buckets")
    pieces = F.coalesce("pieces", F.lit(1))
    own = F.pmod(F.xxhash64("node", "turn"), pieces).cast("int")
    cut = dealt.join(hot, ["turn", "key"], "left").select("node", "low", "high", "turn", "key", own.alias("piece"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("other"))
    # 64 bits of a cell's name: two cells that share them are compared too, which finds no pair that is not close
    cell = F.xxhash64("turn", "key", F.least("piece", "other"), F.greatest("piece", "other"))
    placed = cut.select(cell.alias("cell"), "turn", "piece", "node", "low", "high")

    def survivors(batches):
        index = model()

        def compare(rows):
            codes = np.stack([rows.column("low").to_numpy(), rows.column("high").to_numpy()], axis=1).view(np.uint64)
            near = close_by_code(codes, rows.column("piece").to_numpy(), index.distance)
            return rows.filter(pa.array(near)).combine_chunks().to_batches()[0] if near.any() else None

        yield from by_cell(batches, compare)

    schema = "cell long, turn int, piece int, node long, low long, high long"
    met = shared_table(placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(survivors, schema), "met")
    filled = met.join(nodes.select("node", "vector", "copies"), "node").select("cell", "turn", "piece", "node", "low", "high", "vector", "copies")

    def confirmed(batches):
        index = model()
        masks = index.masks

        def compare(rows):
            codes = np.stack([rows.column("low").to_numpy(), rows.column("high").to_numpy()], axis=1).view(np.uint64)
            node, turn = rows.column("node").to_numpy(), rows.column("turn").to_numpy()
            links, root = close_by_cosine(unit(rows.column("vector").to_pylist(), index.width), codes, rows.column("piece").to_numpy(),
                                          rows.column("copies").to_numpy(), masks[:turn[0]], similarity)
            kept = (links > 0) | (root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(node[kept]), pa.array(links[kept]), pa.array(node[root][kept])],
                                              names=["node", "n", "root"]) if kept.any() else None

        yield from by_cell(batches, compare)

    found = shared_table(filled.repartition("cell").sortWithinPartitions("cell").mapInArrow(confirmed, "node long, n long, root long"), "vector-links")
    roots = component_roots(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    return found.groupBy("node").agg(F.sum("n").alias("n")), roots


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", similarity: float = 0.95, **parameters) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row of ``vectors``."""
    if not 0 < similarity <= 1:
        raise ValueError("the similarity lies between 0 and 1")
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    rows = shared_table(rows.withColumn("usable", usable("vector")), "vectors")
    nodes = (rows.where("usable").groupBy("vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
             .withColumn("node", F.monotonically_increasing_id()))
    nodes = shared_table(nodes, "vector-nodes")
    counts, roots = linked_nodes(nodes, similarity, **parameters)
    named = nodes.select("node", "first").join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select(
        "node", "first", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    known = shared_table(nodes.join(named.drop("first"), "node").join(least, "root").join(counts, "node", "left").select(
        "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "vector-groups")
    linked = rows.where("usable").select("id", "vector").join(known, "vector").select("id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id",
                                            F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def groups(embeddings: DataFrame) -> DataFrame:
    """The registered query."""
    return near_duplicates(embeddings)

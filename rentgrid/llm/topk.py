"""Exact top-k search by inner product, in three phases with a uniform threshold.

Vectors are turned into integers and dealt in shards; the queries in blocks. Every
(block, shard) pair is a task of bounded size. A vector is cut into ``SLICES``
slices, and a shard keeps one list of partial scores per slice and query.

1. Each shard gathers the heads of its score lists: the ``k`` best of every slice,
   with their whole scores. The k-th best over all shards is a score that k vectors
   do reach, so it is a safe cutoff.
2. The cutoffs go back with the queries. A vector whose whole score reaches the cutoff
   has a slice that reaches an equal share of it, whatever the signs; the entries above
   that uniform threshold are sufficient.
3. Their scores are resolved exactly, and each shard returns at most the ``k`` best of
   those that reach the cutoff, ties to the smaller id. The best ``k`` of these are the result.

Integer products are exact: in doubles while they stay under 2**53, in 64-bit or
unbounded integers beyond. Scores beyond 64 bits are returned as the nearest 64-bit number.

Defined results: a vector that is null, holds a null or a non-finite component, or has
a null id takes no part; a missing component counts as zero. Rows with the id of a
query are its own and not its candidates. Repeated rows are candidates of their own,
and every row asked for is a query of its own: an id asked for twice has two rankings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.session import shared_table

SLICES = 4
SHARD_ROWS = 8192
QUERY_ROWS = 8192
TILE = 64


def integer_vectors(embeddings: DataFrame, vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``vec_id, v``: ``floor(scale * x)`` of every component, for the vectors that take part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & sound).select(
        "vec_id", F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"))


def matrix(column: pa.ChunkedArray, width: int, kind: str) -> np.ndarray:
    """Vectors as rows of ``width`` components, in numbers whose products stay exact."""
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out.astype({"double": np.float64, "long": np.int64, "big": object}[kind])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def slices(width: int) -> list[slice]:
    edges = [round(width * i / SLICES) for i in range(SLICES + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def gathered(width: int, kind: str, k: int):
    """Phase 1 of a (block, shard): whole scores of the heads of all score lists."""
    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        numbers, q_ids, ids = queries["number"].to_numpy(), queries["query_id"].to_numpy(), shard["vec_id"].to_numpy()
        q, x = matrix(queries["q"], width, kind), matrix(shard["v"], width, kind)
        found, values = [], []
        for lo in range(0, len(q_ids), TILE):
            lists = [q[lo:lo + TILE, s] @ x[:, s].T for s in slices(width)]
            whole = sum(lists)
            for i, query in enumerate(q_ids[lo:lo + TILE]):
                others = np.flatnonzero(ids != query)
                heads = [others[np.argpartition(part[i, others], len(others) - k)[-k:]] if len(others) > k else others for part in lists]
                seen = np.unique(np.concatenate(heads))
                for p in seen[best(whole[i, seen], ids[seen], k)]:
                    found.append(numbers[lo + i])
                    values.append(_long(whole[i, p]))
        return pa.table({"number": pa.array(found, pa.int64()), "score": pa.array(values, pa.int64())})

    return run


def resolved(width: int, kind: str, k: int):
    """Phases 2 and 3 of a (block, shard): the entries above the uniform threshold, scored whole."""
    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        numbers, q_ids, ids = queries["number"].to_numpy(), queries["query_id"].to_numpy(), shard["vec_id"].to_numpy()
        cutoffs = queries["cutoff"].to_pylist()
        q, x = matrix(queries["q"], width, kind), matrix(shard["v"], width, kind)
        found, asked, partners, values = [], [], [], []
        for lo in range(0, len(q_ids), TILE):
            lists = [q[lo:lo + TILE, s] @ x[:, s].T for s in slices(width)]
            for i, query in enumerate(q_ids[lo:lo + TILE]):
                enough, cutoff = ids != query, cutoffs[lo + i]
                if cutoff is not None:
                    enough &= np.logical_or.reduce([part[i] * SLICES >= cutoff for part in lists])
                at = np.flatnonzero(enough)
                whole = sum(part[i, at] for part in lists)
                if cutoff is not None:
                    at, whole = at[whole >= cutoff], whole[whole >= cutoff]
                for p in best(whole, ids[at], k):
                    found.append(numbers[lo + i])
                    asked.append(query)
                    partners.append(ids[at[p]])
                    values.append(_long(whole[p]))
        return pa.table({name: pa.array(values_, pa.int64()) for name, values_ in
                         (("number", found), ("query_id", asked), ("vec_id", partners), ("score", values))})

    return run


def _long(score) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the ``k`` highest scores of each query among all other vectors.

    ``vectors`` and ``queries`` have ``vec_id`` and the integer vector ``v``.
    """
    number = F.monotonically_increasing_id().alias("number")
    vectors = shared_table(vectors.select("vec_id", "v", number), "vectors")
    queries = shared_table(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), number), "queries")
    sizes = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    asked = queries.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(F.array_max("q")), F.min(F.array_min("q"))).first()
    width = max(sizes[1] or 0, asked[1] or 0, 1)
    reach = lambda r: max(abs(int(r[2] or 0)), abs(int(r[3] or 0)))
    bound = reach(sizes) * reach(asked) * width * SLICES
    kind = "double" if bound < 1 << 53 else "long" if bound < 1 << 63 else "big"
    shards, blocks = max(1, -(-sizes[0] // shard_rows)), max(1, -(-asked[0] // query_rows))

    dealt = vectors.select("vec_id", "v", F.pmod(F.xxhash64("number"), F.lit(shards)).alias("shard"),
                           F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"))
    block = F.pmod(F.xxhash64(F.lit("block"), F.col("number")), F.lit(blocks)).alias("block")
    shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")).alias("shard")

    def paired(asked_: DataFrame, phase, schema: str) -> DataFrame:
        return asked_.groupBy("block", "shard").cogroup(dealt.groupBy("block", "shard")).applyInArrow(phase(width, kind, k), schema)

    heads = paired(queries.select("number", "query_id", "q", block, shard), gathered, "number long, score long")
    falling = Window.partitionBy("number").orderBy(F.desc("score"))
    cutoffs = shared_table(heads.withColumn("place", F.row_number().over(falling)).where(F.col("place") == k)
                           .select("number", F.col("score").alias("cutoff")), "cutoffs")
    known = queries.join(cutoffs, "number", "left")
    entries = paired(known.select("number", "query_id", "q", "cutoff", block, shard), resolved,
                     "number long, query_id long, vec_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return (entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def neighbours(embeddings: DataFrame) -> DataFrame:
    """The registered query."""
    vectors = integer_vectors(embeddings)
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))

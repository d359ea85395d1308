"""Near copies: documents whose sets of word shingles have a Jaccard similarity of at least 4/5.

Documents with equal shingle sets are one node. Nodes get a SimHash fingerprint of their shingles, and the
Gray-order index of ``simhash`` links those within a few bits; these links come first. Nodes at just 4/5 differ in
about ten bits, beyond any index of 64 bits, so what fingerprints leave apart is completed: nodes that share a
band of their MinHash signatures (40 bands of 5 hashes, a pair at just 4/5 is missed with a chance of 1.3e-7)
are compared with one node of their bucket, then, where they are not in one group yet, with another one, for a few rounds.
What is still open then is settled by prefixes: shingles are ordered by how many open nodes have them, rare
ones first, and alike nodes share one among their first fifth. So a group of true copies costs
about one comparison a document and band, whatever its size, and documents that share a passage or a template
but each have words of their own do not meet one by one.

Every candidate pair, however found, is compared shingle by shingle in a task, so nothing below 4/5 is linked. A text
is sent once for each document it is compared with, the text of that one once a task.

Defined results: words are split and lowered as in ``simhash``; a null text has no
words; texts without words are copies of one another; a text shorter than a shingle is
one shingle; texts of any length are taken whole. Groups are the connected pairs, and of a group the row with the smallest
id stays (then the smallest row hash). Rows without an id stay. Columns may have any name and type.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentgrid.llm.common import per_document, text_batches
from rentgrid.llm.components import component_roots
from rentgrid.llm.simhash import fingerprint_links
from rentgrid.llm.words import mixed
from rentgrid.session import drop_table, shared_table

#: Shingles and the least similarity, as a fraction.
WORDS, SIMILARITY = 5, (4, 5)
#: Bands of a signature and hashes of a band.
BANDS, BAND_HASHES = 40, 5
#: Rounds in which a bucket's nodes are compared with one of them.
ROUNDS = 3
#: Texts compared with one document in a task.
PIECE = 500
#: Bytes of text that a task holds in Python at a time.
HELD_BYTES = 2 << 20
#: Lists of row keys up to this length are broadcast, longer ones are joined by key.
SENT_ROWS = 500_000


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct XXH64 hashes of a text's word shingles, sorted."""
    import xxhash

    split = text.encode("utf-8", "surrogatepass").lower().split()    # lower() and split() know ASCII only
    if not split:
        return np.zeros(0, np.uint64)
    flat, digest = b" ".join(split), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:max(1, len(split) - words + 1)].tolist()
    return np.unique(np.array([digest(flat[a:b]) for a, b in zip(starts, ends[min(words, len(split)) - 1:].tolist())], np.uint64))


def majority_bits(hashes: np.ndarray, at_once: int = 4096) -> int:
    """The SimHash fingerprint of a set of hashes: the bits that over half of them have."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), at_once):
        counts += np.unpackbits(hashes[i:i + at_once].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(np.int64)[0])


def shingle_set(text: str, words: int = WORDS) -> frozenset:
    split = text.encode("utf-8", "surrogatepass").lower().split()
    return frozenset(b" ".join(split[i:i + words]) for i in range(max(1, len(split) - words + 1))) if split else frozenset()


def multipliers(n: int) -> np.ndarray:
    """Odd 64-bit factors, the same everywhere."""
    return np.random.default_rng(17).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, bands: int = BANDS, width: int = BAND_HASHES, at_once: int = 512) -> np.ndarray:
    """One 64-bit key per band of the MinHash signature of a set of hashes; the empty set has its own."""
    factors = multipliers(bands * width)
    least = np.full(bands * width, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), at_once):
        part = hashes[i:i + at_once, None] * factors
        np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0), out=least)
    rows = least.reshape(bands, width)
    key = np.zeros(bands, np.uint64)
    for column in range(width):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, column])
    return key


def row_key(columns: list[str], schema: T.StructType) -> Column:
    """128 bits of a row, whatever the types of its columns."""
    kinds = {f.name: f.dataType for f in schema.fields}
    own = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kinds[c].simpleString() or "variant" in kinds[c].simpleString() else F.col(f"`{c}`")
           for c in columns]
    return F.struct(F.xxhash64(*own).alias("p"), F.xxhash64(F.lit("second"), *own).alias("q"))


def listed(rows: DataFrame) -> DataFrame:
    """A table of keys, broadcast where it is short."""
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs ``(a, b)`` whose texts (``node, text``) reach the similarity, compared shingle by shingle.

    All ``b`` of an ``a`` stream past its shingles, in pieces of bounded size.
    """
    num, den = similarity
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("pieces"))
    dealt = shared_table(pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("pieces")).alias("piece")), "dealt-pairs")
    others = dealt.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "piece", "b", "text")
    heads = dealt.select("a", "piece").distinct().join(texts.select(F.col("node").alias("a"), "text"), "a").select(
        "a", "piece", F.lit(None).cast("long").alias("b"), "text")
    rows = heads.unionByName(others).repartition("a", "piece").sortWithinPartitions("a", "piece", F.col("b").asc_nulls_first())

    def run(batches):
        head = frozenset()
        for batch in text_batches(batches, "text", HELD_BYTES):
            left, right = [], []
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text"))):
                own = shingle_set(text or "", words)
                if b is None:
                    head = own
                    continue
                common = len(head & own)
                if den * common >= num * (len(head) + len(own) - common):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def fingerprint_pairs(nodes: DataFrame, alike: Callable[[str, str], Column]) -> DataFrame:
    """``(a, b)``: nodes (``node, size, fp``) that connect the groups of the fingerprint index, one pair or a few a node."""
    heads = shared_table(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("r")).select("fp", "r.node", "r.size"), "heads")
    second = heads.select("fp", F.col("node").alias("node2"), F.col("size").alias("size2"))
    same = nodes.select("fp", "node", "size").join(second, "fp").where("node <> node2")
    near = shared_table(fingerprint_links(heads.select("fp")).distinct(), "near-prints")
    across = near.join(heads.withColumnRenamed("fp", "a"), "a").join(second.withColumnRenamed("fp", "b"), "b")
    columns = ["node", "size", "node2", "size2"]
    return in_order(same.select(columns).unionByName(across.select(columns)).where(alike("size", "size2")))


def in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def prefix_places(texts: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """``node, size, bucket, place``: the shingles by which nodes (``node, text``) that are alike must meet.

    Shingles stand in the order of how many of the nodes have them, so those of one node alone come first; they fill places
    but are not returned. Two alike nodes share one of the first places, up to the part that may differ.
    """
    num, den = similarity

    def columns(batch):
        found = [shingle_hashes(t, words) for t in batch]
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return {"size": pa.array([len(h) for h in found], pa.int32()),
                "shingles": pa.ListArray.from_arrays(offsets, np.concatenate(found).view(np.int64))}

    sets = shared_table(per_document(texts, ["node"], "text", "size int, shingles array<long>", columns, HELD_BYTES), "open-sets")
    tall = sets.select("node", "size", F.explode("shingles").alias("bucket"))
    several = tall.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    common = tall.join(several, "bucket")
    own = Window.partitionBy("node")
    placed = common.withColumn("place", F.col("size") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("n", "bucket")) - 1)
    return placed.where(F.col("place") <= F.col("size") - F.ceil(num * F.col("size") / F.lit(den))).select("node", "size", "bucket", "place")


def near_copies(rows: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(marked, nodes, roots)`` of ``rows (doc_id, h, text)``.

    ``marked``: ``doc_id, h`` of every row; ``nodes``: ``node, first``, the least ``(doc_id, h)`` with an id of every
    distinct shingle set; ``roots``: ``a, b``, nodes with the smallest node of their group.
    """
    num, den = similarity

    def columns(texts):
        import xxhash

        pa.default_memory_pool().release_unused()              # what earlier tasks of this worker left
        found = [shingle_hashes(t, words) for t in texts]
        keys = np.concatenate([band_keys(h) for h in found]).view(np.int64)
        return {"shingles": pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in found], pa.binary()),
                "size": pa.array([len(h) for h in found], pa.int32()), "fp": pa.array([majority_bits(h) for h in found], pa.int64()),
                "bands": pa.FixedSizeListArray.from_arrays(pa.array(keys), BANDS).cast(pa.list_(pa.int64()))}

    marked = shared_table(per_document(rows, ["doc_id", "h"], "text", "shingles binary, size int, fp long, bands array<long>", columns, HELD_BYTES), "marked")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))).alias("first")
    one = [F.any_value(c).alias(c) for c in ("size", "fp", "bands")]
    nodes = shared_table(marked.groupBy("shingles").agg(*one, F.min("h").alias("h"), first)
                         .drop("shingles").withColumn("node", F.monotonically_increasing_id()), "nodes")
    spread = nodes.select("node", "size", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "node", "size")
    several = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    met = shared_table(spread.join(several, "bucket"), "met")

    def texts_of(wanted: DataFrame) -> DataFrame:
        keys = shared_table(nodes.select("node", F.col("h").alias("key")).join(wanted, "node", "left_semi"), "wanted")
        return shared_table(rows.join(listed(keys), rows["h"] == keys["key"]).select("node", "text").dropDuplicates(["node"]), "texts")

    def alike(a: str, b: str) -> Column:
        return den * F.least(a, b) >= num * F.greatest(a, b)

    links, done, roots = [], [], met.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)

    def compare(pairs: DataFrame) -> DataFrame:
        """The roots after the pairs that were not compared before."""
        for earlier in done:
            pairs = pairs.join(earlier, ["a", "b"], "left_anti")
        pairs = shared_table(pairs, "pairs")
        if pairs.first() is None:
            return roots
        done.append(pairs)
        texts = texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
        links.append(shared_table(confirmed(pairs, texts, words, similarity), "copies"))
        drop_table(texts)
        return component_roots(reduce(DataFrame.unionByName, links))

    def still_open(placed: DataFrame) -> DataFrame:
        """The rows of buckets with nodes of several groups, with their ``root``."""
        rooted = placed.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn(
            "root", F.coalesce("root", "node"))
        split = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
        return shared_table(rooted.join(split, "bucket"), "open")

    def second(table: DataFrame, kept: list[str]) -> DataFrame:
        return table.select("bucket", *[F.col(c).alias(f"{c}2") for c in kept])

    other = F.col("root") != F.col("root2")
    roots = compare(fingerprint_pairs(nodes, alike))
    open_ = still_open(met)
    for turn in range(rounds):
        if open_.first() is None:
            return marked, nodes.select("node", "first"), roots
        kept = ["node", "size", "root"]
        order = F.struct(F.xxhash64(F.lit(turn), "node").alias("o"), *kept)
        chosen = second(open_.groupBy("bucket").agg(F.min(order).alias("r")).select("bucket", "r.*"), kept)
        roots = compare(in_order(open_.join(chosen, "bucket").where(other & alike("size", "size2"))))
        open_ = still_open(met)
    if open_.first() is None:
        return marked, nodes.select("node", "first"), roots
    texts = texts_of(open_.select("node").distinct())
    prefixes = still_open(prefix_places(texts, words, similarity))
    drop_table(texts)
    left = F.least(F.col("size") - F.col("place"), F.col("size2") - F.col("place2"))       # shingles from the shared one on
    enough = (num + den) * left >= num * (F.col("size") + F.col("size2"))
    pairs = prefixes.join(second(prefixes, ["node", "size", "root", "place"]), "bucket").where(
        (F.col("node") < F.col("node2")) & other & alike("size", "size2") & enough)
    return marked, nodes.select("node", "first"), compare(in_order(pairs))


def kept_documents(documents: DataFrame, text: str = "text", **parameters) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id; rows without an id stay as they are."""
    columns = documents.columns
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id"), F.col(f"`{text}`").cast("string").alias("text"),
                            row_key(columns, documents.schema).alias("h"))
    marked, nodes, roots = near_copies(rows.select("doc_id", "h", "text"), **parameters)
    keyed = shared_table(marked.where("doc_id IS NOT NULL").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")), "keyed")
    grouped = nodes.where("first IS NOT NULL").join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    kept = shared_table(grouped.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("k")).select("k.doc_id", "k.h"), "kept")
    # few rows go and fewer are repeated whole, so texts need not move where these lists are short
    repeated = keyed.where("n > 1").select("doc_id", "h")
    gone = shared_table(keyed.select("doc_id", "h").join(kept, ["doc_id", "h"], "left_anti").union(repeated), "gone")
    out = rows.join(listed(gone), ["doc_id", "h"], "left_anti").select("row.*")             # a null id equals none, so it stays
    again = shared_table(repeated.join(kept, ["doc_id", "h"], "left_semi"), "again")
    if again.first() is None:
        return out
    once = rows.join(listed(again), ["doc_id", "h"], "left_semi").groupBy("doc_id", "h").agg(F.any_value("row").alias("row"))
    return out.unionByName(once.select("row.*"))

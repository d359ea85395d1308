"""Merkle manifest of a table: leaves, subroots, root and checked inclusion proofs, by sibling-shift self-joins.

Every row is a leaf of its group's tree; the roots of the groups are the leaves of
one more tree. A node knows its place in its level, so the places of its siblings
are computed (an exclusive-or in binary trees, slot offsets otherwise) and fetched by
an equi-join of the level with itself; the nodes in slot zero then emit the parents.
No run of nodes is gathered: a join key has one row on either side, whatever the
size of the group. On the way down each level hands its children the siblings they
need, and every row folds its own leaf up to the root.

Places come from one range-partitioned sort: a row's number in its partition plus
the rows of its group in earlier partitions. A group may hold any share of the rows.

Defined results: nulls are leaves of their own kind (``-``); rows without a group
form the first group; a row with a null id sorts first and is never tampered with;
rows with one id are ordered by their leaf, equal rows in any order (their results
are the same); texts of any length are hashed whole; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentgrid.session import shared_table

#: Columns of a leaf, in the order in which they are hashed.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def digest(content: Column) -> Column:
    """The sha256 of a text as lowercase hex."""
    return F.sha2(content.cast("binary"), 256)


def leaf_of(columns: Sequence[Column]) -> Column:
    """The digest of the columns, each with its length in bytes in front, ``-`` for null."""
    written = [c.cast("string") for c in columns]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in written]))


def placed(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0, by ``order`` within ``group``) and ``size`` of the group, as a table.

    ``rows`` are read twice by the range partitioning and should be a table.
    """
    known = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = known.repartitionByRange(group, *order, "__tie").sortWithinPartitions(group, *order, "__tie").drop("__tie")
    dealt = shared_table(dealt.withColumn("__row", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("__row", 33).alias("__part")
    runs = dealt.groupBy(group, part).agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("first"))
    before = F.sum("n").over(_earlier(group))
    shift = runs.select(group, "__part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("__shift"),
                        F.sum("n").over(_whole(group)).alias("size"))
    return (dealt.withColumn("__part", F.shiftright("__row", 33)).join(shift, [group, "__part"])
            .withColumn("place", F.col("__row") + F.col("__shift")).drop("__row", "__part", "__shift"))


def _earlier(group: str):
    from pyspark.sql import Window
    return Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)


def _whole(group: str):
    from pyspark.sql import Window
    return Window.partitionBy(group)


def siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes (tree, place, size, hash, ...)`` with ``left`` and ``right``: the joined digests of the siblings beside them."""
    slot = F.pmod("place", F.lit(arity))
    others = nodes.select("tree", F.col("place").alias("__beside"), F.col("hash").alias("__hash"))
    out = nodes
    for shift in range(1, arity):
        where = (F.col("place").bitwiseXOR(F.lit(1)) if arity == 2
                 else F.col("place") - slot + F.pmod(slot + shift, F.lit(arity)))
        out = (out.withColumn("__beside", where).join(others, ["tree", "__beside"], "left")
               .drop("__beside").withColumnRenamed("__hash", f"__s{shift}"))
    # the sibling at shift s stands before the node exactly where slot + s wraps around
    before = [F.when(slot + s >= arity, F.col(f"__s{s}")) for s in range(1, arity)]
    after = [F.when(slot + s < arity, F.col(f"__s{s}")) for s in range(1, arity)]
    return (out.withColumn("left", F.concat_ws("", *before)).withColumn("right", F.concat_ws("", *after))
            .drop(*[f"__s{s}" for s in range(1, arity)]))


def climb(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels of all trees, with siblings, and ``(tree, height, hash)`` of their roots.

    ``leaves`` hold ``tree``, ``place``, ``size``, ``hash`` and may hold more, which
    stays in the lowest level. A tree leaves the levels when one node is left of it.
    """
    levels, tops = [], []
    largest = leaves.agg(F.max("size")).first()[0] or 0
    nodes = leaves
    while largest:
        tops.append(nodes.where("size = 1").select("tree", F.lit(len(levels)).alias("height"), "hash"))
        if largest == 1:
            break
        level = shared_table(siblings(nodes.where("size > 1"), arity), "merkle-level")
        levels.append(level)
        up = level.where(F.pmod("place", F.lit(arity)) == 0)
        nodes = up.select("tree", F.expr(f"place div {arity}").alias("place"),
                          F.expr(f"(size + {arity - 1}) div {arity}").alias("size"),
                          digest(F.concat("hash", "right")).alias("hash"))
        largest = -(-largest // arity)
    roots = leaves.select("tree", F.lit(0).alias("height"), "hash").limit(0)
    for top in tops:
        roots = roots.unionByName(top)
    return levels, shared_table(roots, "merkle-roots")


def descend(levels: list[DataFrame], seeds: DataFrame, lone: DataFrame, arity: int, carried: Sequence[str]) -> DataFrame:
    """Every leaf with ``path``: the siblings of each step up to the root, the lowest first.

    ``seeds`` hold ``(tree, height, path, ...)``: what a tree's own root already has above
    it. ``lone`` are the leaves of trees with one leaf. ``carried`` columns of leaves stay.
    """
    extra = [c for c in seeds.columns if c not in ("tree", "height", "path")]
    parents = None
    for height in range(len(levels), 0, -1):
        at = seeds.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("above"), "path", *extra)
        parents = at if parents is None else parents.unionByName(at)
        level, kept = levels[height - 1], ["place"] if height > 1 else ["place", *carried]
        joined = level.withColumn("above", F.expr(f"place div {arity}")).join(parents, ["tree", "above"])
        path = F.concat(F.array(F.struct("left", "right")), "path").alias("path")
        parents = joined.select("tree", *[F.col(c).alias("above") if c == "place" and height > 1 else F.col(c) for c in kept],
                                path, *extra)
    at = lone.join(seeds.where("height = 0"), "tree").select("tree", "place", *carried, "path", *extra)
    return at if parents is None else parents.unionByName(at)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, leaf, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def manifest(documents: DataFrame, columns: Sequence[str] = LEAF, key: str = "doc_id", group: str = "source",
             arity: int = 3, presented: Column | None = None) -> DataFrame:
    """One row per row: ``key, leaf, subroot, root, path, seen, folded_root``.

    ``path`` holds the siblings to the left and right of each step. ``seen`` is the leaf of the
    row as ``presented`` (a column that stands for the last of ``columns``; by default the
    row itself), and ``folded_root`` what follows from it and the path.
    """
    if arity < 2:
        raise ValueError("a tree needs an arity of two or more")
    own = [F.col(f"`{c}`") for c in columns]
    seen = leaf_of([*own[:-1], presented]) if presented is not None else leaf_of(own)
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-"))   # null first, then by bytes
    leaves = shared_table(documents.select(tree.alias("tree"), F.col(f"`{key}`").alias("__key"), leaf_of(own).alias("hash"),
                                           seen.alias("seen")), "merkle-leaves")
    leaves = shared_table(placed(leaves, "tree", ["__key", "hash"]), "merkle-placed")
    levels, subroots = climb(leaves, arity)
    # the tree over the roots of the groups
    named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "height", "hash")
    upper = shared_table(placed(named, "tree", ["group"]), "merkle-groups")
    upper_levels, root = climb(upper, arity)
    none = F.array().cast("array<struct<left:string,right:string>>")
    over = descend(upper_levels, root.select("tree", "height", none.alias("path"), F.col("hash").alias("root")),
                   upper.where("size = 1"), arity, ["group", "hash"])
    heights = subroots.select(F.col("tree").alias("group"), "height")
    seeds = shared_table(over.join(heights, "group").select(F.col("group").alias("tree"), "height", "path",
                                                            F.col("hash").alias("subroot"), "root"), "merkle-seeds")
    rows = descend(levels, seeds, leaves.where("size = 1"), arity, ["__key", "hash", "seen"])
    return rows.select(F.col("__key").alias(key), F.col("hash").alias("leaf"), "subroot", "root", "path", "seen",
                       folded(F.col("seen"), F.col("path")).alias("folded_root"))


def checked(documents: DataFrame) -> DataFrame:
    """The registered query: every row's proof, held against a copy in which some rows lost their line ends."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = manifest(documents, presented=tampered)
    proof = F.aggregate("path", F.lit(""), lambda text, step: F.concat(text, step["left"], step["right"]))
    return rows.select("doc_id", "leaf", "subroot", "root", digest(proof).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))

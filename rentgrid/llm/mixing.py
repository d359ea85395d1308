"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to. A
flow network routes words from patterns to the sources' quotas: a pattern offers its
words once per repetition, each repetition dearer than the one before, so nothing is
repeated before everything fresh that helps has been taken. The flow fixes how often
a pattern is taken whole and how many words remain; for the rest documents are taken
in the order of a seeded hash until the words are reached, the last one in part.

Only totals per pattern and source reach the driver, so its memory grows with the
number of patterns and not with documents. The cut in the seeded order is found in
steps (buckets of places, one place, buckets of row hashes, one row), each from totals
of the step before; no window holds a whole source, or all rows of one id.

Defined results: a null text has size 0 and takes nothing. A null source is a source
of its own, the last. Rows that repeat an id (or have none) share its place in the
order and follow one another there by a hash of the whole row; of rows equal in every
column it is open which one is cut.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentgrid.llm.common import packed, unpacked
from rentgrid.llm.nearcopies import row_key
from rentgrid.session import shared_table

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Documents of a pattern that are ordered in one task.
BUCKET_ROWS = 10_000
HASH_RANGE = 1 << 32
#: The plan of a mix has a row per pattern; up to so many it is broadcast, beyond it is joined by key.
BROADCAST_PATTERNS = 10_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def pattern(members: Column) -> Column:
    """A text key of the set of sources, the same for every order of them."""
    return F.to_json(F.sort_array(F.array_distinct(members)))


def place(seed: str, key: str = "doc_id") -> Column:
    """The seeded place of a document, a number under ``HASH_RANGE``."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def target_words(sizes: dict, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, share: float = 1.0) -> dict:
    """Words per source: ``share`` of all words by weight, none above ``repeats`` times its size."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, targets = sum(sizes.values()) * share, list(order), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / whole > repeats * sizes[s]]
        if not above:
            targets |= {s: left * weight[s] / whole for s in open_}
            break
        for s in above:
            targets[s] = float(repeats * sizes[s])
        left -= sum(repeats * sizes[s] for s in above)
        open_ = [s for s in open_ if s not in above]
    return targets


class FlowNetwork:
    """Minimum-cost maximum flow by shortest augmenting paths with node potentials."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.end: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for end, r, c in ((b, room, cost), (a, 0, -cost)):
            self.arcs[a if end == b else b].append(len(self.end))
            self.end.append(end)
            self.room.append(r)
            self.cost.append(c)
        return len(self.end) - 2

    def route(self, start: int, stop: int) -> None:
        potential = [0] * len(self.arcs)
        while True:
            far, via = [None] * len(self.arcs), [-1] * len(self.arcs)
            far[start] = 0
            heap = [(0, start)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for e in self.arcs[a]:
                    b = self.end[e]
                    if self.room[e] and (far[b] is None or d + self.cost[e] + potential[a] - potential[b] < far[b]):
                        far[b], via[b] = d + self.cost[e] + potential[a] - potential[b], e
                        heapq.heappush(heap, (far[b], b))
            if far[stop] is None:
                return
            potential = [p + f if f is not None else p for p, f in zip(potential, far)]
            path, node = [], stop
            while node != start:
                path.append(via[node])
                node = self.end[via[node] ^ 1]
            moved = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= moved
                self.room[e ^ 1] += moved


def allotments(patterns: dict[str, int], quotas: dict, repeats: int = REPEATS) -> dict[str, int]:
    """Words to take from each pattern so that the sources' quotas are met with the fewest repetitions.

    ``patterns`` maps a pattern key (a JSON list of sources) to its words. The cost of a
    word's r-th repetition is ``r * r``.
    """
    keys, sources = sorted(patterns), list(quotas)
    number = {s: 1 + len(keys) + i for i, s in enumerate(sources)}
    net = FlowNetwork(2 + len(keys) + len(sources))
    stop = len(net.arcs) - 1
    offers = {}
    for i, key in enumerate(keys):
        offers[key] = [net.arc(0, 1 + i, patterns[key], r * r) for r in range(1, repeats + 1)]
        for s in json.loads(key):
            net.arc(1 + i, number[s], repeats * patterns[key], 0)
    for s in sources:
        net.arc(number[s], stop, quotas[s], 0)
    net.route(0, stop)
    return {key: sum(net.room[e ^ 1] for e in arcs) for key, arcs in offers.items()}


def mixed(documents: DataFrame, members: Column, text: str = "text", weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS,
          share: float = 1.0, seed: str = "mix", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``documents`` with ``__size``, ``__pattern`` and ``__taken``, the words that the mix takes of each row.

    ``members`` is the array of the sources of a row. Also adds ``__targets``, a map from
    source (as JSON) to its words in all rows and its target.
    """
    spark = documents.sparkSession
    marked = documents.withColumns({"__size": word_count(text), "__pattern": pattern(members), "__place": place(seed),
                                    "__tie": row_key(documents.columns, documents.schema)})
    sizes = shared_table(marked.select("doc_id", "__size", "__pattern", "__place", "__tie"), "sizes")
    rows = sizes.groupBy("__pattern").agg(F.sum("__size").alias("words"), F.count(F.lit(1)).alias("rows")).collect()
    words = {r["__pattern"]: r["words"] for r in rows}
    per_source: dict = {}
    for key, n in words.items():
        for s in json.loads(key):
            per_source[s] = per_source.get(s, 0) + n
    targets = target_words(per_source, weights, repeats, share)
    taken = allotments(words, {s: int(t + 0.5) for s, t in targets.items()}, repeats)

    targets_type = "array<struct<source:string,words:long,target:double>>"
    plan = [(r["__pattern"], max(1, -(-r["rows"] // bucket_rows)), *(divmod(taken[r["__pattern"]], r["words"]) if r["words"] else (0, 0)),
             [(s, per_source[s], targets[s]) for s in json.loads(r["__pattern"])]) for r in rows]
    sent = F.broadcast if len(plan) <= BROADCAST_PATTERNS else (lambda df: df)
    plans = spark.createDataFrame(plan, f"__pattern string, buckets long, times long, rest long, __targets {targets_type}")
    left = sizes.join(sent(plans.select("__pattern", "buckets", "rest")), "__pattern")
    left = reached(left, (F.col("__place") * F.col("buckets") / F.lit(float(HASH_RANGE))).cast("long"))
    left = reached(left, F.struct("__place", "doc_id"))
    left = reached(left, ((F.col("__tie.p") / F.lit(2.0 ** 64) + 0.5) * F.ceil(F.col("rows") / bucket_rows)).cast("long"))
    left = reached(left, F.col("__tie"))
    # a row per pattern: the whole plan, bounded by the number of patterns
    cuts = {r["__pattern"]: r for r in left.dropDuplicates(["__pattern"]).collect()}
    kind = documents.schema["doc_id"].dataType.simpleString()
    full = spark.createDataFrame(
        [(p, times, t, *((c["__place"], c["doc_id"], c["__tie"], c["rest"], c["rows"]) if (c := cuts.get(p)) else (-1, None, None, 0, 0)))
         for p, _, times, _, t in plan],
        f"__pattern string, __times long, __targets {targets_type}, __cut long, __cut_id {kind}, __cut_tie struct<p:long,q:long>, "
        f"__rest long, __copies long")
    joined = marked.join(sent(full), "__pattern", "left")
    same_place = F.col("__place") == F.col("__cut")
    same_id = same_place & F.col("doc_id").eqNullSafe(F.col("__cut_id"))
    at_cut = same_id & (F.col("__tie") == F.col("__cut_tie"))
    ahead = ((F.col("__place") < F.col("__cut")) | (same_id & (F.col("__tie") < F.col("__cut_tie")))
             | (same_place & F.col("__cut_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("__cut_id")))))
    whole = F.col("__times") * F.col("__size")
    more = F.when(at_cut, F.least("__size", "__rest")).when(ahead, F.col("__size")).otherwise(F.lit(0))
    result = [*[F.col(f"`{c}`") for c in documents.columns], F.col("__size"), F.col("__pattern"), F.col("__targets")]
    out = joined.withColumn("__taken", whole + more.cast("long"))
    if all(c["rows"] == 1 for c in cuts.values()):
        return out.select(*result, "__taken")
    # equal rows at a cut: one is kept with their number and made into as many rows again, the words given to one after another
    repeated = F.coalesce(at_cut & (F.col("__copies") > 1), F.lit(False))
    one = joined.where(repeated).groupBy("__pattern").agg(F.any_value(F.struct("*")).alias("__one")).select("__one.*")
    blocks = one.withColumn("__block", F.explode(F.expr(f"sequence(0L, (__copies - 1) div {bucket_rows})")))
    copies = blocks.withColumn("__copy", F.explode(F.sequence(
        F.col("__block") * bucket_rows, F.least(F.col("__copies"), (F.col("__block") + 1) * bucket_rows) - 1)))
    given = F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__rest") - F.col("__copy") * F.col("__size"))).cast("long")
    return out.where(~repeated).select(*result, "__taken").unionByName(copies.select(*result, (whole + given).alias("__taken")))


def reached(rows: DataFrame, step: Column) -> DataFrame:
    """Of each pattern the rows of the one ``step`` in which its ``rest`` runs out.

    ``rest`` becomes what is left when that step begins, ``rows`` the number of its rows.
    """
    marked = rows.withColumn("step", step)
    totals = marked.groupBy("__pattern", "rest", "step").agg(F.sum("__size").alias("words"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("__pattern").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(earlier), F.lit(0))
    hit = totals.withColumn("before", before).where((F.col("rest") > F.col("before")) & (F.col("rest") <= F.col("before") + F.col("words")))
    found = hit.select("__pattern", "step", (F.col("rest") - F.col("before")).alias("rest"), "rows")
    return marked.drop("rest", "rows").join(found, ["__pattern", "step"]).drop("step")


def shares(documents: DataFrame) -> DataFrame:
    """The registered query: every document belongs to its one source."""
    out = mixed(documents.select("doc_id", "text", "source"), F.array("source"))
    own = F.col("__targets")[0]
    return out.select("doc_id", F.col("__size").alias("size"), own["words"].alias("source_size"), own["target"].alias("target"),
                      F.col("__taken").alias("taken"))


def drawn(documents: DataFrame) -> DataFrame:
    """``documents`` as the mix takes them: a row for every time a document is taken, in whole or in part, none for the others."""
    out = mixed(packed(documents, "doc_id", "source"), F.array("source"))
    times = F.when(F.col("__size") > 0, F.ceil(F.col("__taken") / F.col("__size"))).otherwise(F.lit(0)).cast("int")
    rows = (out.withColumn("__times", times).where(F.col("__times") > 0)
            .withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times")))))
    return unpacked(rows, documents.columns, text=F.col("text"))

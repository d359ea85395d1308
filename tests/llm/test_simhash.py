import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from rentgrid.llm import components, simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """Plain Python: (doc_id, fingerprint, smallest reachable id) of every row."""
    prints = [plain_fingerprint(t) for _, t in rows]
    nodes = sorted(set(prints))
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if (a ^ b).bit_count() <= 4:
                root[find(b)] = find(a)
    first = {}
    for (doc_id, _), p in zip(rows, prints):
        if doc_id is not None:
            first[find(p)] = min(first.get(find(p), doc_id), doc_id)
    return [(d, f"{p:016x}", first.get(find(p))) for (d, _), p in zip(rows, prints)]


def near_copies(seed):
    draw = random.Random(seed)
    rows = []
    for g in range(30):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.choice([3, 30, 120]))]
        for _ in range(draw.randrange(1, 7)):
            w = list(base)
            for _ in range(draw.randrange(0, 3)):
                w[draw.randrange(len(w))] = f"v{draw.randrange(1000)}"
            rows.append((len(rows), " ".join(w).upper() if draw.random() < 0.2 else " ".join(w)))
    return rows


def test_groups_against_plain_python(spark, edge):
    rows = near_copies(3) + [(1000 + (r[0] or 0) if r[0] is not None else None, r[1]) for r in edge.select("doc_id", "text").collect()]
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_groups(rows)))


def dense(draw, n):
    base, found = draw.getrandbits(64), set()
    while len(found) < n:
        x = base
        for b in draw.sample(range(64), draw.randrange(0, 7)):
            x ^= 1 << b
        found.add(x)
    return sorted(found | {draw.getrandbits(64) for _ in range(n)})


def plain_components(nodes, distance):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                root[find(b)] = find(a)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), set()).add(n)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_hot_buckets_are_dealt_in_pieces_without_losing_links(spark):
    nodes = dense(random.Random(8), 250)
    table = spark.createDataFrame([(n - (1 << 64) if n >> 63 else n,) for n in nodes], "fp long")
    for bucket_rows, blocks in ((40, 6), (1000, 6), (40, 7)):
        roots = components.component_roots(simhash.fingerprint_links(table, 4, blocks, bucket_rows)).collect()
        groups = {}
        for a, b in roots:
            groups.setdefault(b, {b}).add(a)
        got = sorted(sorted(x % (1 << 64) for x in g) for g in groups.values())
        assert got == plain_components(nodes, 4), (bucket_rows, blocks)


def test_the_index_skips_nothing_at_any_distance():
    draw = random.Random(4)
    fps = np.array(dense(draw, 120), np.uint64)
    rank = fps.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    fps = fps[np.argsort(rank)]
    for distance in (0, 1, 4, 9):
        label = simhash.GrayIndex(fps, distance).search(np.array([0]), np.array([len(fps)]))
        groups = {}
        for f, r in zip(fps.tolist(), label.tolist()):
            groups.setdefault(r, []).append(f)
        assert sorted(sorted(g) for g in groups.values() if len(g) > 1) == plain_components(fps.tolist(), distance)


def test_long_chain_is_one_component(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = components.component_roots(links).collect()
    assert len(roots) == 300 and {r["b"] for r in roots} == {0}


def test_kept_documents(spark, edge, nothing):
    kept = simhash.kept_documents(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and ids.count(12) == 1 and ids.count(3) == 1
    assert 5 in ids and 6 not in ids and 7 not in ids            # no words: one group
    assert ids.count(None) == 2
    assert simhash.kept_documents(nothing).collect() == [] and simhash.groups(nothing).collect() == []

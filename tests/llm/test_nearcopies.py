import random

import numpy as np

from pyspark.sql import functions as F

from rentgrid.llm import nearcopies


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def kept(rows):
    """Plain Python, all pairs: the (doc_id, text) rows that stay."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if 5 * common >= 4 * (len(x) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def planted(seed, groups=25, copies=6, words=120):
    """Groups of copies with few and many changed words, around the similarity."""
    draw = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([3, 40, words]))]
        for _ in range(draw.randrange(1, copies + 1)):
            w = list(base)
            for _ in range(draw.randrange(0, 5)):
                w[draw.randrange(len(w))] = f"v{draw.randrange(10000)}"
            rows.append((len(rows), " ".join(w).upper() if draw.random() < 0.2 else " ".join(w)))
    draw.shuffle(rows)
    return rows


def ids(spark, rows, **parameters):
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted(r["doc_id"] for r in nearcopies.kept_documents(table, **parameters).where(F.col("doc_id").isNotNull()).collect())


def test_pipeline_stage_finds_planted_near_copies(spark):
    import corpus_pipeline

    rows = planted(1)
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in stage(spark, table, "").collect()) == kept(rows)


def test_every_pair_at_common_shingles(spark):
    """One line is in every text and one group is large; with rounds of one document and with all pairs at once."""
    line = " ".join(f"common{i}" for i in range(30))
    rows = [(d, f"{line} {t}") for d, t in planted(2, 15, 12, 100)]
    draw = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    for i in range(40):
        at = draw.randrange(80)                            # a chain: neighbours are near, the ends are not
        rows.append((1000 + i, " ".join(base[:at] + [f"n{i}"] * draw.randrange(1, 4) + base[at:])))
        rows.append((2000 + i, " ".join(base[i % 10 * 4:] + [f"t{j}" for j in range(i % 10 * 4)])))
    assert ids(spark, rows, rounds=0) == kept(rows) == ids(spark, rows, rounds=1) == ids(spark, rows)


def test_repeated_ids_keep_a_row_of_every_group(spark, edge):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (8, c), (None, a), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(str, map(tuple, nearcopies.kept_documents(table).collect())))
    assert got == sorted(map(str, [(3, a), (5, b), (8, c), (None, a), (None, None)]))
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    out = nearcopies.kept_documents(edge)
    assert out.columns == edge.columns
    assert sorted(r["doc_id"] for r in out.where("doc_id IS NOT NULL").collect()) == kept(rows)


def test_no_rows(spark, nothing):
    assert nearcopies.kept_documents(nothing).count() == 0


def test_bands_find_pairs_at_the_similarity_and_no_strangers():
    draw = random.Random(3)
    found = strangers = 0
    for i in range(300):
        shared, own = draw.sample(range(10**9), 160), draw.sample(range(10**9, 2 * 10**9), 60)
        def keys(numbers):
            hashes = np.array(sorted(n * 0x9E3779B97F4A7C15 % 2**64 for n in numbers), np.uint64)
            return nearcopies.band_keys(hashes, at_once=37)
        found += (keys(shared + own[:20]) == keys(shared + own[20:40])).any()             # 160 of 200: just alike
        strangers += (keys(shared[:20] + own) == keys(shared[:20] + [n + 3 * 10**9 for n in own])).any()
    assert found == 300 and strangers <= 6


def test_map_columns_and_clashing_names(spark):
    table = spark.createDataFrame([(1, "a b c d e f", {"k": "v"}, "x"), (2, "a b c d e f", {"k": "w"}, "y"), (3, "z", None, None)],
                                  "doc_id long, text string, h map<string,string>, row string")
    assert sorted((r["doc_id"], r["h"], r["row"]) for r in nearcopies.kept_documents(table).collect()) == [(1, {"k": "v"}, "x"), (3, None, None)]


def test_templates_with_own_words_do_not_meet_one_by_one(spark, monkeypatch):
    """Texts of one template that are not alike are told apart by their rare shingles, not compared pair by pair."""
    draw = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in draw.sample(range(150), 5):
            words[at] = f"v{i}x{at}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + d, t) for d, t in planted(4, 5)]
    seen, compared = [], nearcopies.confirmed

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return compared(pairs, *rest)

    monkeypatch.setattr(nearcopies, "confirmed", counted)
    assert ids(spark, rows, rounds=0) == kept(rows)
    assert sum(seen) < 10 * len(rows)                     # all pairs: 44,850


def test_fingerprints_come_first(spark, monkeypatch):
    """The stage's first links are those of the Gray-order index over SimHash fingerprints of the shingles."""
    hashes = nearcopies.shingle_hashes(" ".join(f"w{i}" for i in range(9000)))
    bits = [2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes) for b in range(64)]
    made = nearcopies.majority_bits(hashes, at_once=1000) % (1 << 64)
    assert sorted(bits) == sorted(bool(made >> b & 1) for b in range(64)) and nearcopies.majority_bits(np.zeros(0, np.uint64)) == 0
    calls, index = [], nearcopies.fingerprint_links
    monkeypatch.setattr(nearcopies, "fingerprint_links", lambda nodes, *rest: calls.append(nodes.count()) or index(nodes, *rest))
    rows = planted(6, 10)
    assert ids(spark, rows) == kept(rows) and calls and calls[0] > 1

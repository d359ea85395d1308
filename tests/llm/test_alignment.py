import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rentgrid.llm import alignment
from rentgrid.llm.bpe import byte_characters
from rentgrid.llm.queries import piece_model_path, tokenizer_path

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def spans(ids, strings):
    out, at = [], 0
    for i, s in zip(ids, strings):
        out.append((at, at + len(s), i))
        at += len(s)
    return out, b"".join(strings)


def tokens(text, libraries):
    """Both token sequences as (begin, end, id), by the tokenizers' own libraries."""
    first, second = libraries
    if not text:
        return [], []
    to_byte = byte_characters()
    ids = first.encode(" " + text, add_special_tokens=False).ids
    a, raw_a = spans(ids, [bytes(to_byte[c] for c in first.id_to_token(i)) for i in ids])
    ids = second.encode(text)
    names = [second.id_to_piece(i) for i in ids]
    b, raw_b = spans(ids, [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, names)])
    return (a, b) if raw_a == raw_b == (" " + text).encode() else ([], [])


def plain(rows, libraries):
    """Every row by comparing all spans, one pair at a time."""
    documents = []
    for doc_id, text in rows:
        a, b = tokens(text, libraries)
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in a} & {y[1] for y in b})
        groups, low = [], 0
        for high in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in t if low <= s and e <= high) for t in (a, b)))
            low = high
        documents.append((doc_id, len(a), len(b), len(cuts), links, ";".join(groups)))
    held = Counter(p for d in documents for p in set(d[4]))
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    return sorted(((i, n_a, n_b, n_g, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(g.encode()).hexdigest() if n_a else "") for i, n_a, n_b, n_g, links, g in documents), key=str)


def got(table):
    return sorted((tuple(r[c] for c in COLUMNS) for r in alignment.alignments(table, tokenizer_path(), piece_model_path()).collect()), key=str)


def test_documents_against_the_libraries(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 2500)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(rows) > 50
    assert got(docs.repartition(3)) == plain(rows, libraries)


def test_texts_that_are_hard_to_align(spark, libraries):
    rows = [(1, "<|endoftext|> is plain <s> </s> <unk> <0x41>"), (2, "▁ x"), (3, "é𝄞\x1c  　 \n\n"), (4, None), (5, ""), (6, " "),
            (7, "  two  spaces  "), (8, "a\u0000b"), (9, "日本語のテキスト"), (9, "日本語のテキスト"), (None, "same same"), (11, "same same"),
            (12, "x" * 700), (13, "\t\r\n"), (14, "ﬀ Å é")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("block", "pairs", "codes", "n_a", "n", "best", "pair", "__text2"):
        table = table.withColumn(name, F.lit("x"))
    made = got(table.repartition(4))
    assert made == plain(rows, libraries)
    assert [r[1:] for r in made if r[0] == 2] == [(0, 0, 0, 0, 0, 0, "")]        # the second tokenizer turns its mark into a space
    assert got(table.where("text IS NULL")) == plain([(4, None)], libraries)
    assert got(table.limit(0)) == []


def test_edge_rows(spark, edge, nothing, libraries):
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect() if len(r["text"] or "") < 10_000]
    assert got(edge.where("text IS NULL OR length(text) < 10000")) == plain(rows, libraries)
    assert got(nothing) == []


@pytest.mark.parametrize("lane", [1, 3, 256])
def test_lanes_do_not_change_the_merge(lane):
    draw = np.random.default_rng(5)
    n_bytes = [1, 40, 3000, 0, 7]

    def lengths(n):
        cuts = np.sort(draw.choice(np.arange(1, n), size=min(n - 1, n // 3), replace=False)) if n > 1 else np.empty(0, int)
        return np.diff(np.concatenate([[0], cuts, [n]])) if n else np.empty(0, int)

    a, b = [lengths(n) for n in n_bytes], [lengths(n) for n in n_bytes]
    made = alignment.merge(np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64), np.array([len(x) for x in a]), lane)
    links, cuts, at_a, at_b = set(), [], 0, 0
    for x, y in zip(a, b):
        ends_x, ends_y = np.cumsum(x), np.cumsum(y)
        links |= {(at_a + i, at_b + j) for i in range(len(x)) for j in range(len(y))
                  if ends_x[i] - x[i] < ends_y[j] and ends_y[j] - y[j] < ends_x[i]}
        cuts += [at_a + i for i in range(len(x)) if ends_x[i] in ends_y]
        at_a, at_b = at_a + len(x), at_b + len(y)
    found = list(zip(made.link_a.tolist(), made.link_b.tolist()))
    assert len(found) == len(set(found)) and set(found) == links
    assert made.cut_a.tolist() == cuts and len(made.cut_b) == len(cuts)


def test_groups_as_text_give_the_digest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000")
    rows = alignment.aligned(docs, tokenizer_path(), piece_model_path(), written=True).select(
        "n_groups", F.size(F.split("groups", ";")).alias("n"), "groups_sha256", F.sha2("groups", 256).alias("h")).where("n_groups > 0").collect()
    assert rows and all(r["n"] == r["n_groups"] and r["h"] == r["groups_sha256"] for r in rows)

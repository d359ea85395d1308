import hashlib
import importlib.util

import numpy as np
import pytest

from rentgrid.llm import mixing
from rentgrid.llm.queries import tokenizer_path
from test_nearcopies import kept as plain_kept
from test_substring import removed

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")


def test_every_stage_against_plain_python(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "simhash", "substring_dedup", "mixing", "bpe"]

    told = stages["language_id"](spark, docs, "").cache()
    assert told.columns == columns
    rows = [(r["doc_id"], r["text"]) for r in told.collect()]
    every = {r["doc_id"]: r["text"] for r in docs.collect()}
    lettered = [i for i, t in every.items() if any(map(str.isalpha, t or ""))]
    assert {i for i, _ in rows} <= set(lettered) and len(rows) >= 0.99 * len(lettered)

    single = stages["simhash"](spark, told, "").cache()
    assert single.columns == columns
    assert sorted(r["doc_id"] for r in single.collect()) == plain_kept(rows)

    cut = stages["substring_dedup"](spark, single, "").cache()
    assert cut.columns == columns
    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    got = {r["doc_id"]: " ".join(r["text"].encode().decode().split()) for r in cut.collect()}
    want = {d: " ".join(s.split()) for d, _, _, s in removed(rows, 50)}
    assert got == want

    mixed = stages["mixing"](spark, cut, "").cache()
    assert mixed.columns == columns
    sizes, longest, taken = {}, {}, {}
    for r in cut.collect():
        n = len(r["text"].encode().split())
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        longest[r["source"]] = max(longest.get(r["source"], 0), n)
    for r in mixed.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].encode().split())
    for s, target in mixing.target_words(sizes).items():
        assert abs(taken.get(s, 0) - target) <= longest[s] + 1

    library = Tokenizer.from_file(tokenizer_path())
    final = sorted(((r["doc_id"], r["ids_sha256"], r["n_tokens"]) for r in stages["bpe"](spark, mixed, "").collect()))
    want = []
    for r in mixed.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want.append((r["doc_id"], hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), len(ids)))
    assert final == sorted(want)


def test_run_gives_the_last_stage(spark, tmp_path):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id", "n_tokens", "decoded_sha256").collect()
    assert rows and all(r["n_tokens"] > 0 for r in rows)

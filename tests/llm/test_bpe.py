import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rentgrid.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Vocabulary(file.read())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_every_code_point_and_awkward_texts(library, vocabulary):
    texts = ["".join(chr(c) for c in range(a, a + 97) if not 0xD800 <= c < 0xE000) for a in range(0, 0x30000, 97)]
    texts += ["", "a" * 1001, "ab" * 700 + "!!!!!!!", "a<|endoftext|>b <|endoftext|>\n\n x", "  \n\n\t a'll don't 'S  ", "''s's 's\n's"]
    flat, counts = bpe.encode_block(texts, vocabulary, bpe.pretokenizer(vocabulary))
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends):
        ids, decoded = expected(library, text)
        assert flat[a:b].tolist() == ids, text
        assert bpe.readable(bpe.decode_ids(flat[a:b], vocabulary)) == decoded


def test_runs_of_one_symbol_merge_from_the_left(library, vocabulary):
    words = [b"a" * n for n in range(1, 40)] + [b"." * n for n in range(1, 40)]
    flat, counts = bpe.merge_words(words, vocabulary)
    ends = np.cumsum(counts)
    for word, a, b in zip(words, ends - counts, ends):
        assert flat[a:b].tolist() == library.encode(word.decode(), add_special_tokens=False).ids


def test_digests_of_whole_texts(edge, library):
    rows = bpe.digests(edge, PATH).collect()
    texts = edge.select("doc_id", "text").collect()
    want = []
    for doc_id, text in texts:
        ids, decoded = expected(library, text)
        want.append((str(doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in rows) == sorted(want)


def test_decode_returns_the_texts(edge):
    ids = bpe.encode(edge, PATH, ["doc_id", "score"])
    back = bpe.decode(ids, PATH, ["doc_id"])
    assert sorted(str(r["decoded"]) for r in back.collect()) == sorted(r[0] for r in edge.select(F.coalesce("text", F.lit(""))).collect())


def test_empty_table(nothing):
    assert bpe.digests(nothing, PATH).collect() == []


def test_other_tokenizers_are_refused():
    with open(PATH, encoding="utf-8") as file:
        content = file.read().replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true')
    with pytest.raises(ValueError):
        bpe.Vocabulary(content)

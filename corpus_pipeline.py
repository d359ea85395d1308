"""From raw documents to token ids: five stages, each a table that the next one reads.

1. ``language_id``: documents whose language cannot be told go.
2. ``simhash``: of documents whose five-word shingles are alike to 4/5 or more, one stays (fingerprints and their
   Gray-order index first, then what they leave apart, ``nearcopies``).
3. ``substring_dedup``: passages of 50 words or more that an earlier document has are cut out.
4. ``mixing``: documents are drawn to the sources' target weights, a row for every time one is taken.
5. ``bpe``: the ids of every drawn text, with the digests of its round trip.

A stage's output has to be written before the next stage is called, as ``run`` does: the tables it used
are dropped then. All stages but the last return the columns of ``documents``. Stages 1, 2 and 5 cannot
be written in SQL, so ``ORACLE_SQL`` is None; tests hold ``run`` against plain Python.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.llm import bpe, language, mixing, nearcopies, substring
from rentgrid.llm.queries import tokenizer_path
from rentgrid.session import drop_folders, shared_table, tables_made


#: Text of a block of the last stage: less than ``bpe`` takes alone, as Python keeps some memory of the stages before.
BLOCK_BYTES = 3 << 20


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.kept_documents(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.without_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.drawn(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    turned = bpe.encode(docs, tokenizer_path(), ["doc_id"], decoded=True, size=BLOCK_BYTES)
    return turned.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                         F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


#: Folders of the tables a stage wrote on its way; its output has been written when the next stage begins.
_LEFT: list[str] = []


def _tidy(stage):
    """The stage, after the tables of the stage before it have been dropped."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_folders(spark, _LEFT)
        _LEFT.clear()
        with tables_made() as made:
            out = stage(spark, docs, sf_dir)
        _LEFT.extend(made)
        return out
    return run_stage


STAGES = [(name, _tidy(stage)) for name, stage in (
          ("language_id", language_stage), ("simhash", simhash_stage), ("substring_dedup", substring_stage),
          ("mixing", mixing_stage), ("bpe", bpe_stage))]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus out of the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written and read again
as the next one's docs. All but the last return the columns of documents, whatever others docs has and however they are named;
n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, line_dedup, mixing, quality, signature_trees
from lodestone.llm.common import ease_executors, materialize, table
from lodestone.shipping import ship

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def begin(spark: SparkSession) -> None:
    """Before a stage: the package is there, and the memory of the stage before is free."""
    ship(spark)
    ease_executors(spark)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects.

    A null text is judged as an empty one; equal rows are judged alike, so all stay or go; a row
    without doc_id is judged as any other but never learned from; without labels of both kinds
    all documents stay or, where all labels say 0, go; an empty table stays empty.
    """
    begin(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.Settings())
    return quality.accepted(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier document has; a document that loses lines and has nothing but blanks left goes.

    Null and empty texts stay; rows equal in doc_id and text are one document; ties go to the
    least doc_id (null first), then the text's hash, then the place in the text.
    """
    begin(spark)
    return line_dedup.cleaned(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least doc_id (null last), then of the text's hash.

    Texts that are null or without words resemble nothing and all stay; of rows equal in doc_id
    and text one stays.
    """
    begin(spark)
    return signature_trees.representatives(docs, signature_trees.Join(words=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, three times at most.

    Documents without words are never taken; null is a source of its own, the last one; equal
    rows share what is taken of them; which of equal sizes are taken follows from a seeded hash.
    """
    begin(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, lossless; a null text has no ids, equal rows one row each."""
    begin(spark)
    return bpe.checked(docs, BYTE_RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Nothing of this can be said in SQL; tests/llm/test_pipeline.py holds it against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

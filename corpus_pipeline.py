"""A training corpus from ``documents``: each stage's output is written and is the next one's input.

Stages: documents without a recognisable language go; of equal texts and then of near copies one
document stays; sources are mixed to their target weights, a document taken twice being two rows; all
that is left is packed into sequences. The first four return the columns of ``documents``, the last
one the pieces and their places.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import logframe as lf
from logframe.llm.common import Scratch
from logframe.llm.exact_dedup import drop_duplicates
from logframe.llm.langid import reject_unknown
from logframe.llm.mixing import take
from logframe.llm.near_dedup import drop_near_duplicates
from logframe.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_unknown(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Language models, shingle sets and tokenizers can't be written in SQL; the tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole table."""
    docs = lf.configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for name, stage in STAGES:
        made = scratch.save(stage(spark, docs, sf_dir), name)
        if hasattr(docs, "_scratch_path"):
            scratch.drop(docs)
        docs = made
    return docs

"""A corpus of documents from raw rows to tokens: five stages, each on all that the one before kept.

Defined results of all stages: a null text is an empty one; texts are read whole, however
long; extra columns stay as they are, whatever their names; an empty table stays empty.
Ids are whole numbers and may be null or repeated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clauselake.llm import bpe, exact_dedup, langid, mixing, near_dedup
from clauselake.llm.shared import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, null and empty texts with them; the others get the language that the model of the labelled ones predicts.

    Repeated rows are each kept or not; of tied languages the first by code point is taken;
    without a labelled row the language stays as it is.
    """
    return langid.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; rows without an id stay only if none of the group has one. Of tied rows one stays."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words a shingle, 0.8 or more.

    The smallest id stays, with all rows that have it. Texts without a word are linked with nothing and stay.
    """
    return near_dedup.representatives(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's share by weight; a document that is read twice has two rows.

    A null source is a source of its own. Texts without a word have size 0 and are not taken.
    """
    return mixing.mixed(docs, share=1.5, max_epochs=2)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digest of what they decode to. Workers keep fewer pieces than on their own: executors are full from the stages before.

    Repeated rows are each returned, in any order.
    """
    vocabulary = bpe.Vocabulary(spark, f"file:{public_tokenizers.path('byte_bpe_50k.tiktoken')}", public_tokenizers.PATTERN, remembered=60_000)
    return bpe.round_trip(docs, vocabulary, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("mix_sources", mixture),
    ("bpe_tokens", tokens),
]

#: The language model of the first stage cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

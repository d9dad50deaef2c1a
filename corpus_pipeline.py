"""A pipeline from raw documents to token ids, stage by stage.

Every stage takes all that the one before kept. All but the last return the
columns of ``documents``; stages are written as Parquet between each other, so
a lost executor costs tasks and not the run.

Defined results: a null or empty text has no language and goes in the first
stage, so later stages see texts with letters only. Of rows alike in id and text
one stays, of near copies the one with the smallest id, null ids last, and on a
tie the one with the smaller hash of its text. A null source is a source of its
own, last in order. Very long texts pass every stage whole. Extra columns are
carried to the mix and left out of the token ids. An empty table gives empty
results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import byte_bpe, language_id, queries, similar_dedup, source_mix, suffix_dedup
from rasterloom.llm.common import new_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: texts without a letter go, and those in which no language has 30 % of the letters."""
    return language_id.accepted(docs, queries.language_model(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles with a Jaccard similarity of 0.8 or more, by SimHash with pigeonring filtering and an exact search for what that can't find."""
    return similar_dedup.keep_firsts(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that stand earlier in the corpus."""
    return suffix_dedup.remove_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, as often as the mix takes them."""
    return source_mix.mixed_documents(docs, queries.SCHEDULES)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit), and whether the ids decode to the text's bytes."""
    return byte_bpe.round_trip(docs, queries.RANKS, public_tokenizers.PATTERN, ["doc_id", "source"])


STAGES = [
    ("language_id", language),
    ("simhash_dedup", near_copies),
    ("suffix_dedup", passages),
    ("source_mix", mixture),
    ("byte_bpe", tokens),
]

#: SQL has neither the language model nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

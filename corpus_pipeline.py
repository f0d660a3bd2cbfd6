"""A corpus pipeline over `documents`: quality, language, near copies, repeated passages, packing.

Each stage takes all that the stage before kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlattice.llm._tables import bounded, keep
from finlattice.llm.jaccard import keep_one
from finlattice.llm.language import keep_identified
from finlattice.llm.packing import pack, pieces
from finlattice.llm.quality import QualityRules, keep_good
from finlattice.llm.repeats import without_repeats

#: Near copies here are five-word shingles at a similarity of 0.8.
WIDTH, PERCENT = 5, 80
#: Symbols per 100 words of a text that is kept.
MOST_SYMBOLS = 30


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; beside repetition, texts of symbols go."""
    bounded(spark)
    return keep_good(docs, QualityRules(most_symbols=MOST_SYMBOLS))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told and fits its model."""
    bounded(spark)
    return keep_identified(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    bounded(spark)
    return keep_one(docs, WIDTH, PERCENT)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated passages cut but for their first place; n_chars follows the text."""
    bounded(spark)
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences that the documents' tokens are packed into."""
    bounded(spark)
    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("suffix-array dedup", repeat_stage),
    ("best-fit packing", packing_stage),
]
#: The language, repeated-passage and packing stages are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = keep(docs, f"stage{number}")
    return docs

"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ._tables import load
from .bpe import encode_documents
from .collocations import collocations
from .html import extract
from .jaccard import join as jaccard_join
from .language import identify
from .licenses import scan
from .oracles import ORACLES
from .packing import ATTENTION, pack, pieces
from .quality import quality
from .repeats import summary as repeat_summary
from .sharding import document_shards
from .trie import prefix_trie, rebuilt
from .vectors import near_duplicates
from .warc import round_trip


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(load(spark, sf_dir, "documents"))


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "embeddings"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(load(spark, sf_dir, "pages"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(load(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_summary(load(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def packing_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing under limits of pieces and attention cost that bind, beside the tokens."""
    return pack(pieces(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048), ATTENTION)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(load(spark, sf_dir, "conversations")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_shards(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_vectors, op3_warc, op4_jaccard, op5_licenses, op6_repeats, op7_bpe, op8_language, op9_packing, op10_html, op11_trie, op12_collocations, op13_sharding, packing_attention)}


def oracle_sql() -> dict[str, str]:
    return ORACLES

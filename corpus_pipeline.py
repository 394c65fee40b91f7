"""From raw documents to token ids: each stage is written as Parquet and read again as the next one's documents.

STAGES, in order: language ID (documents without a language it can tell go, the others get the one it tells), exact dedup (one of each group of equal
texts stays), n-gram Jaccard join (one of each group of similar texts stays; five words, 0.8), mixing of sources
(a document is there as often as the mix takes it), byte-level BPE (ids, decoded again for the digest).

Every stage but the last returns the columns of documents. Nulls, empty texts, repeated rows and empty tables are
handled as the operators' docstrings say; each stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import bpe, exact, jaccard, langid, mixing
from citeloom.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified(docs.select(*COLUMNS), langid.train(docs))


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.dedup(docs.select(*COLUMNS))


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.dedup(docs.select(*COLUMNS), words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = bpe.round_trip(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)
    return rows.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_equal),
    ("ngram_jaccard_join", drop_similar),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Similarity joins and tokenisation can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

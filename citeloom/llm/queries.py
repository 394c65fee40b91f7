"""One query for each operator, over whole tables, with the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, bpe, chat, exact, jaccard, langid, lexical, minhash, mixing, substring, toxicity, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS, PATTERN)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents"), digest_all=True)


def held_out(divisor: int, remainder: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == remainder, F.lit(False))


def op5_ann_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, F.col("vec_id") % 20 == 0, 20)


def op6_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(5, 0))
    scorer = toxicity.train(docs.where(~held_out(5, 0)), labels)
    return toxicity.score(docs.withColumn("held_out", held_out(5, 0)), scorer).drop("text")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.select("doc_id", "text", "lang").where(~held_out(4, 2)))
    return langid.predict(docs.select("doc_id", held_out(4, 2).alias("held_out"), "text"), model).drop("text")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)


def op9_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = warc.Index.build(warc.write_archive(pages))
    return warc.read_records(index.lookup(warc.keys(pages)), payload=False)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chat(rows.unionByName(own)))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.Index(table(spark, sf_dir, "documents")).search(table(spark, sf_dir, "benchmark"), 10)


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=80)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": mixing.ORACLE, "op3_substring_dedup": substring.ORACLE, "op4_exact_dedup": exact.ORACLE, "op8_ngram_jaccard_join": jaccard.ORACLE, "op9_warc_capture_index": warc.ORACLE, "op10_chat_formatting": CHAT, "op11_lexical_search": lexical.ORACLE, "op12_minhash_near_dedup": minhash.ORACLE, "op13_filter_audit": audit.ORACLE}


CHAT = r"""
WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS said,
  sum(length(text) + length(regexp_replace(text, '[^\\\[<]', '', 'g'))
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 WHEN 'system' THEN 17 ELSE 14 + length(role) + length(regexp_replace(role, '[^\\\[<>]', '', 'g')) END) + 3 AS chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(said)::BIGINT AS loss_chars, sha256(said) AS loss_sha256, chars::BIGINT AS formatted_chars FROM g
"""

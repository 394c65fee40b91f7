"""Exact dedup by progressive refinement: group by length, then hash of a prefix, then hash of the whole.

What is compared is the text without the characters in BLANK. Its length and the hash of its start, PREFIX long,
are taken in one pass. Only rows whose length, and then whose (length, prefix hash), others share have their whole
text read and hashed with SHA-256, which counts as equality; a caller who wants every row's digest has it taken in the
first pass. Texts are never shuffled. Groups are aggregated before they are joined back, so a group of
copies, however large, is one row where it meets others; the join of rows to groups can be split by adaptive
execution, for nothing above it needs the rows of a key together.

Defined results: null text counts as empty, and all empty texts are equal. Of equal texts the one of most code points
stays, then the smallest doc_id (null last), and of rows that agree in both any one. Input columns named like a result are replaced. An empty table
gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Blocks, written

#: Deleted before texts are compared: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]"
PREFIX = 128
MADE = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: str):
    return F.translate(F.coalesce(F.col(text), F.lit("")), " \t\n\x0b\x0c\r", "")


def survivors(rows: DataFrame) -> DataFrame:
    """rows with _left: whether another row shares the length and then the prefix hash."""
    pairs = written(rows.groupBy("_len", "_head").agg(F.count("*").alias("_n")), "exact-heads")
    shared_length = pairs.groupBy("_len").agg(F.sum("_n").alias("_all")).where("_all > 1").select("_len")
    again = pairs.where("_n > 1").join(shared_length, "_len", "left_semi").select(F.col("_len").alias("_l"), F.col("_head").alias("_h"))
    again = written(again, "exact-again")
    rows = rows.join(again, (F.col("_len") == F.col("_l")) & (F.col("_head") == F.col("_h")), "left")
    return rows.withColumn("_left", F.col("_l").isNotNull()).drop("_l", "_h")


def decide(rows: DataFrame, key: str) -> DataFrame:
    """rows (_row, _chars, _left, text_sha256, key and others) with keep_id, group_size and kept."""
    best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("_row").alias("r")))
    whole = rows.where("_left").groupBy(F.col("text_sha256").alias("_sha")).agg(F.count("*").alias("_size"), best.alias("_best")).where("_size > 1")
    whole = written(whole, "exact-groups")  # a table of its own: adaptive execution can then split the rows' side of the join
    rows = rows.join(whole, (F.col("text_sha256") == F.col("_sha")) & F.col("_left"), "left")
    alone = F.col("_sha").isNull()
    kept = alone | (F.col("_row") == F.col("_best.r"))
    return rows.withColumns({"keep_id": F.when(alone, F.col(key)).otherwise(F.col("_best.k")), "group_size": F.coalesce(F.col("_size"), F.lit(1)).cast("long"), "kept": kept})


def squeezed(text: str | None) -> bytes:
    return text.encode().translate(None, b" \t\n\x0b\x0c\r") if text else b""


def decide_in(blocks: Blocks, rest: list[str], text: str, key: str) -> DataFrame:
    """decide() for a table in blocks, whose texts are never shuffled: hashes of whole texts are taken of survivors alone, where they lie. _row is struct<block, row>."""
    names = [*rest, "_row", "_chars", "_len", "_head"]
    place = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("row", T.IntegerType())])
    kinds = [place, T.IntegerType(), T.LongType(), T.LongType()]
    schema = T.StructType([*(blocks.schema[c] for c in rest), *(T.StructField(c, k) for c, k in zip(names[len(rest) :], kinds))])
    arrow = to_arrow_schema(schema)
    read, read_text = blocks.reader([*dict.fromkeys((*rest, text))]), blocks.reader([text])

    def heads(block: int):
        from xxhash import xxh3_64_intdigest

        at = 0
        for batch in read(block):
            texts = batch.column(text).to_pylist()
            own, n = list(map(squeezed, texts)), batch.num_rows
            where = pa.StructArray.from_arrays([pa.array([block] * n, pa.int32()), pa.array(range(at, at + n), pa.int32())], ["block", "row"])
            head = np.array([xxh3_64_intdigest(t[:PREFIX]) for t in own], np.uint64).view(np.int64)
            made = [where, pa.array([len(t or "") for t in texts], pa.int32()), pa.array(map(len, own), pa.int64()), pa.array(head)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in rest), *made], names)
            at += n

    def digests(block: int, given: pa.Table):
        from hashlib import sha256

        chosen = {r for rows in given.column("rows").to_pylist() for r in rows}
        at = 0
        for batch in read_text(block) if chosen else ():
            found = [i for i in range(at, at + batch.num_rows) if i in chosen]
            texts = batch.column(0).take(pa.array([i - at for i in found], pa.int64())).to_pylist()
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int32()), pa.array(found, pa.int32()), pa.array([sha256(squeezed(t)).hexdigest() for t in texts], pa.string())], ["_b", "_r", "text_sha256"])

    rows = written(survivors(written(blocks.map(heads, schema), "exact-rows")), "exact-left")
    left = rows.where("_left").groupBy("_row.block").agg(F.collect_list("_row.row").alias("rows"))  # a block's rows at most
    told = blocks.map_with(left, digests, "_b int, _r int, text_sha256 string")
    rows = rows.join(told, (F.col("_row.block") == F.col("_b")) & (F.col("_row.row") == F.col("_r")), "left").drop("_b", "_r")
    return decide(written(rows, "exact-hashes"), key)


def groups(df: DataFrame, text: str = "text", key: str = "doc_id", digest_all: bool = False) -> DataFrame:
    """Columns of df but text, with keep_id, group_size, kept and text_sha256.

    text_sha256 is null for rows that an earlier stage already told apart, unless digest_all: whole texts are then
    hashed as they are first read, and rows go on without them.
    """
    rest = [c for c in df.columns if c != text and c not in MADE]
    if not digest_all:
        return decide_in(Blocks(df.select(*rest, text), "exact"), rest, text, key).select(*rest, *MADE)
    norm = df.select(*rest, F.monotonically_increasing_id().alias("_row"), F.coalesce(F.length(text), F.lit(0)).alias("_chars"), normalised(text).alias("_norm"))
    made = {"_len": F.length("_norm"), "_head": F.xxhash64(F.substring(F.col("_norm"), 1, PREFIX)), "text_sha256": F.sha2(F.encode(F.col("_norm"), "UTF-8"), 256)}
    return decide(survivors(written(norm.withColumns(made).drop("_norm"), "exact-rows")), key).select(*rest, *MADE)


def dedup(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of df that stay, all its columns: one for each text."""
    blocks = Blocks(df, "exact")
    stay = decide_in(blocks, [key], text, key).where("kept")
    return blocks.take(stay.select("_row.block", "_row.row"))


ORACLE = r"""
WITH n AS (SELECT doc_id, coalesce(length(text), 0) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t, lang, source, n_chars FROM documents),
h AS (SELECT *, sha256(t) AS text_sha256 FROM n),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM h)
SELECT doc_id, lang, source, n_chars, keep_id, group_size, keep_id = doc_id AS kept, text_sha256 FROM k
"""

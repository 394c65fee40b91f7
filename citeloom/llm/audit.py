r"""Audit of how filters interact, by a product of incidence matrices.

Each document becomes a mask of five bits: which of the filters A to E it fails.

A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 * letters A-Z > 10 * code points; D: holds any of
``#$%&*|``; E: its text is identical to that of a smaller key, table-wide.

All that the 120 orders of five filters can tell depends on the mask alone. So documents are counted by part and mask,
three times: all, those labelled good and those labelled toxic. The histograms of a part are the rows of an integer
matrix of 32 columns. Its product with four 32 by 600 matrices of zeros and ones (mask by order and step: kept after it,
removed at it, failing but removed before, failing it alone) gives every outcome at once; the histograms of good and
toxic documents times the matrix of removals give what is lost of them, and removals summed over the steps of a filter
are its Shapley share, times 120.

Identical texts are told by SHA-256. A group of copies, however large, is one row of the table that says which key is
its smallest, and the rows of hot groups aren't shuffled for it (common.join_hot). The largest thing that meets in one
task is a part's 96 numbers; documents are counted where they lie before anything is shuffled.

Defined results: a null text counts as empty; it and the empty text are identical. An empty text has no words, so A fails and B, C,
D don't. A null key is larger than any other, and rows of one key (null keys too) are not each other's copies. A null part
counts as the empty string. A key with several labels is good, or toxic, if one of them says so; labels of null keys
are for none. Repeated rows count each. Other input columns are ignored, whatever their names. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, written

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Copies of a text from which its group counts as hot, at least; of n documents a thousand groups at most are.
HOT = 1000
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*OUTCOMES, "good_lost", "toxic_lost", "shapley"))


def incidence() -> dict[str, np.ndarray]:
    """For each outcome the matrix of masks by (order, step): 1 where a document of that mask has it."""
    masks = np.arange(MASKS)[:, None]
    bit = np.array([[1 << FILTERS.index(f) for f in order] for order in ORDERS])
    upto = np.cumsum(bit, 1)  # the filters applied so far are distinct bits
    here, before, after = bit.ravel(), (upto - bit).ravel(), upto.ravel()
    fails, gone = masks & here != 0, masks & before != 0
    found = (masks & after == 0, fails & ~gone, fails & gone, masks == here)
    return {name: m.astype(np.int64) for name, m in zip(OUTCOMES, found)}


def outcomes(histograms: np.ndarray) -> dict[str, np.ndarray]:
    """histograms (parts, 3, 32): all, good and toxic documents by mask -> each column of the result, (parts, 600)."""
    parts = len(histograms)
    m = incidence()
    rows = np.ascontiguousarray(histograms, np.int64).reshape(parts * 3, MASKS)
    product = {name: (rows @ m[name]).reshape(parts, 3, -1) for name in OUTCOMES}
    out = {name: product[name][:, 0] for name in OUTCOMES}
    out["good_lost"], out["toxic_lost"] = product["removed"][:, 1], product["removed"][:, 2]
    letter = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    same = (letter[:, None] == letter[None, :]).astype(np.int64)
    out["shapley"] = out["removed"] @ same
    return out


def conditions(text) -> list:
    """Whether a text, not null, fails A, B, C and D."""
    words = F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), lambda w: w != "")
    n = F.size(words)
    return [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text), text.rlike(r"[#$%&*|]")]


def histograms(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """part, mask and how many documents, good and toxic ones have it. labels(doc_id, quality, toxic)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    mask = sum(F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions(F.col("_t"))))
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(part), F.lit("")).alias("part"), whole.alias("_t"))
    rows = rows.select("key", "part", F.unhex(F.sha2(F.encode("_t", "UTF-8"), 256)).alias("digest"), mask.alias("mask"))
    rows = written(rows, "audit-masks")  # texts are read once
    copies = written(rows.groupBy(F.col("digest").alias("same")).agg(F.min("key").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "audit-copies")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    rows = join_hot(rows, "digest", copies, "same", "copies", HOT).withColumn("mask", F.col("mask") + F.when(again, F.lit(16)).otherwise(F.lit(0)))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(said, F.col("key") == F.col("of"), "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def audit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step, with the columns of RESULT."""
    counted = histograms(df, labels, text, key, part)
    parts = counted.groupBy("part").agg(*(F.collect_list(c).alias(c) for c in ("mask", "n", "good", "toxic")))  # 32 masks at most

    def product(batches):
        order, step = np.repeat(ORDERS, len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
        for b in batches:
            for a in range(0, b.num_rows, 64):
                some = b.slice(a, 64)
                stacked = np.zeros((some.num_rows, 3, MASKS), np.int64)
                for i, (masks, *counts) in enumerate(zip(*(some.column(c).to_pylist() for c in range(1, 5)))):
                    stacked[i][:, masks] = counts
                out = outcomes(stacked)
                names = [p for p in some.column(0).to_pylist() for _ in range(len(step))]
                cols = {"part": pa.array(names, pa.string()), "filter_order": pa.array(np.tile(order, some.num_rows)), "step": pa.array(np.tile(step, some.num_rows))}
                yield pa.RecordBatch.from_pydict(cols | {c: pa.array(x.ravel()) for c, x in out.items()})

    return parts.mapInArrow(product, RESULT)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), min(doc_id) OVER (PARTITION BY t) IS NOT NULL) AS e FROM d),
y AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
h AS (SELECT part, MAP {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS m, a::INT + b::INT + c::INT + d::INT + e::INT AS fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN y USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM l p, l q, l r, l s, l t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
k AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
z AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, n, good, toxic, fails, m[substr(filter_order, step, 1)] AS here,
  len(list_filter(string_split(substr(filter_order, 1, step - 1), ''), lambda c: c <> '' AND m[c])) > 0 AS gone FROM h, k),
s AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN here AND fails = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM z GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM s
"""

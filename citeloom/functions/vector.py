"""Vector functions as column expressions, and the search for the nearest of many vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is all zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


#: Queries in a block, rows in a slice at most, and rows or pairs that a task looks at together.
BLOCK, SLICE, STEP, PAIRS = 2048, 32_768, 2048, 65_536
#: Products of matrices differ from sums taken in order by far less; sizes beyond these may lose digits, so no product is relied on.
NEAR, SMALL, LARGE = 1e-9, 1e-100, 1e100


def _matrix(lists: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, filled up with zeros, and their lengths; nulls are zeros too."""
    lists = lists.combine_chunks()
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), width))
    out[np.arange(width) < n[:, None]] = pc.fill_null(pc.list_flatten(lists), 0.0).to_numpy(zero_copy_only=False)
    return out, n


def _exact(x: np.ndarray, q: np.ndarray, both: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Cosines of pairs, summed in order as dot() does."""
    total = np.add.accumulate(x * q, axis=1)[:, -1] + 0.0 if x.shape[1] else np.zeros(len(x))
    return np.where(both == 0, 0.0, np.where(alike, total / both, np.nan))


def _cell(rows: pa.Table, asked: pa.Table, key: str, vector: str, k: int, by: str | None):
    """Of one slice of rows the k best for each query of a block (and for each value of by): places of queries and rows, scores, and which of these are null."""
    width = max([0, *(pc.max(pc.list_value_length(t[vector])).as_py() or 0 for t in (rows, asked))])
    (x, n), (q, m) = _matrix(rows[vector], width), _matrix(asked[vector], width)
    sizes = [t["_size"].to_numpy() for t in (rows, asked)]
    told = [pc.is_valid(t["_size"]).to_numpy() for t in (rows, asked)]
    size, q_size = (np.where(t, s, 1.0) for s, t in zip(sizes, told))
    odd, q_odd = (t & (s != 0) & ~((s > SMALL) & (s < LARGE)) for s, t in zip((size, q_size), told))
    codes = pa.chunked_array([*rows[key].chunks, *asked[key].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
    own, q_own = codes[: len(n)], codes[len(n) :]
    group = np.zeros(len(n), int) if by is None else pc.fill_null(rows[by].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    ends = [0, *(np.flatnonzero(np.diff(group)) + 1), len(n)]
    out = []
    with np.errstate(all="ignore"):
        for start, stop in zip(ends, ends[1:]):
            found, least = [], np.full(len(m), -np.inf)
            for a in range(start, stop, STEP):
                b = min(a + STEP, stop)
                both = q_size[:, None] * size[a:b]
                about = np.where(both == 0, 0.0, (q @ x[a:b].T) / both)
                null = ~told[1][:, None] | ~told[0][a:b] | ((m[:, None] != n[a:b]) & (both != 0))
                about[q_odd[:, None] | odd[a:b] | np.isnan(about)] = np.inf
                about[null | (q_own[:, None] == own[a:b])] = -np.inf
                # what is infinite here isn't known, so it raises no bar
                if b - a >= k:
                    known = np.where(np.isposinf(about), -np.inf, about)
                    least = np.maximum(least, np.partition(known, -k, axis=1)[:, -k])
                i, j = np.nonzero((about >= (least - NEAR)[:, None]) & (q_own[:, None] != own[a:b]))
                for p in range(0, len(i), PAIRS):
                    i_, j_ = i[p : p + PAIRS], j[p : p + PAIRS]
                    score = _exact(x[a + j_], q[i_], both[i_, j_], m[i_] == n[a + j_])
                    found.append(_first(i_, a + j_, score, null[i_, j_], k))
            if found:
                out.append(_first(*map(np.concatenate, zip(*found)), k))
    return tuple(map(np.concatenate, zip(*out))) if out else None


def _first(i, j, score, null, k):
    """The k best rows of each query: the order that Spark gives to scores going down, then by the place of the row."""
    score = np.where(null, 0.0, score)
    nan = np.isnan(score)
    order = np.lexsort((j, np.where(nan, 0.0, -score), ~nan, null, i))
    i, j, score, null = i[order], j[order], score[order], null[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return tuple(c[place < k] for c in (i, j, score, null))


def nearest(rows: DataFrame, asked: DataFrame, key: str, vector: str, k: int, by: str | None = None) -> DataFrame:
    """query_id and score (cosine) with the columns of rows but vector: for each query the k best rows but itself, equal ones by key, of each value of `by` if there is one, of every slice of the rows. asked: the queries, columns as in rows. The best of all are the best of these.

    Rows and blocks of queries meet in a grid: a row goes once to each block of BLOCK queries, a block to each slice of
    the rows, so that neither side is broadcast or collected and a cell is an equal share of the work. In a cell a product of
    matrices tells which rows may be among the best; their scores are summed in order, as dot() does, and decide.
    """
    spark = rows.sparkSession
    blocks = max(1, -(-asked.count() // BLOCK))
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SLICE))
    size = F.sqrt(dot(F.col(vector), F.col(vector)))  # once for each row, not for each pair
    plain = F.col(vector) if rows.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
    share = lambda of: F.pmod(F.xxhash64(key), F.lit(of))
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)).cast("array<long>"))
    sized = lambda df: df.where(F.col(key).isNotNull()).withColumn("_size", size).withColumn(vector, plain)
    side = sized(rows).withColumn("_slice", share(slices)).withColumn("_block", every(blocks)).groupBy("_block", "_slice")
    # names of its own: sides of one table with the same names are taken for each other
    other = sized(asked).select(share(blocks).alias("_to"), every(slices).alias("_in"), F.col(key).alias("query_id"), F.col(vector).alias("_q"), F.col("_size").alias("_q_size")).groupBy("_to", "_in")
    kept = [f for f in rows.schema.fields if f.name != vector]
    schema = StructType([StructField("query_id", rows.schema[key].dataType), *kept, StructField("score", DoubleType())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([(c, "ascending") for c in ([by] if by else []) + [key]]).combine_chunks()
        right = pa.table({key: right["query_id"], vector: right["_q"], "_size": right["_q_size"]})
        found = _cell(left, right, key, vector, k, by) if len(left) and len(right) else None
        i, j, score, null = found or (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))
        columns = {"query_id": right[key].take(pa.array(i)), **{f.name: left[f.name].take(pa.array(j)) for f in kept}, "score": pa.array(score, mask=null)}
        return pa.table(columns)

    return side.cogroup(other).applyInArrow(best, schema)

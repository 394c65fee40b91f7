"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes. On a bounded sample the vectors' mean and principal axes are taken, and a rotation is learned that brings the
projections near the corners of the cube (alternating signs and an orthogonal Procrustes step). A vector's code holds
the signs of its rotated projections, 64 bits at most. The radius is learned there too: the stated share of the
sample queries' true neighbours lie within it.

Index. Rows are dealt to shards of bounded size. In each, codes are cut into substrings of one byte, and each substring
has its table: the shard's rows in the order of that byte, and where each of its 256 buckets begins. Codes within
Hamming distance r agree with the query in some substring up to a distance given by the pigeonhole principle (r // m
for the first r % m + 1 substrings, one less for the others), so the rows in the buckets that near hold every code
within r. Only these rows' whole codes are looked at, and only those within r are ranked by the vectors themselves, in
double precision. A query that has found fewer than k in a shard goes on to the nearest codes there, so no query ends
with fewer than there are.

Every row is indexed. Shards and groups of queries lie in the shared folder; each pair of them is a task's unit, which
reads both there and gives the k best of each query at most; these are merged by query. Vectors are shuffled once.

Defined results: rows whose id or vector is null, or whose vector is all zero, holds null or non-finite components or
has another length than most, take no part. Rows that share an id are rows of their own: each is a candidate of the
other, and each that is asked for has its own ranks. Ties in score go to the smaller id, then in any order that stays.
Empty tables give empty results; other input columns are dropped, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST, Blocks, Place, drawn, places, written

#: Bounds of the sample that codes are learned on, of a shard and of a group of queries, in rows. Small tables have
#: shards and groups for all cores, but of LEAST rows or more.
SAMPLE, SHARD, GROUP, LEAST = 20_000, 65_536, 8_192, 512
BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Codes:
    """Mean, projection and radius; fits in a closure (64 x 64 numbers)."""

    def __init__(self, sample: np.ndarray, k: int, share: float = 0.95, rounds: int = 40, seed: int = 11):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1] if sample.size else 1
        self.mean = sample.mean(0) if len(sample) else np.zeros(dim)
        x = sample - self.mean
        _, axes = np.linalg.eigh(x.T @ x if len(x) else np.eye(dim))
        self.bits = min(64, dim)
        axes = axes[:, ::-1][:, : self.bits]
        turn = np.linalg.qr(rng.standard_normal((self.bits, self.bits)))[0]
        z = x @ axes
        for _ in range(rounds if len(x) else 0):
            u, _, v = np.linalg.svd(np.where(z @ turn >= 0, 1.0, -1.0).T @ z)
            turn = (u @ v).T
        self.project = axes @ turn
        self.radius = self._learn_radius(sample, k, share) if len(sample) > 1 else self.bits
        self.substrings = -(-self.bits // 8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of bytes."""
        return np.packbits((x - self.mean) @ self.project >= 0, axis=1)

    def _learn_radius(self, x: np.ndarray, k: int, share: float) -> int:
        codes, some = self(x), slice(0, 256)
        scores = x[some] @ x.T
        scores[np.arange(len(scores)), np.arange(len(scores))] = -np.inf
        k = min(k, len(x) - 1)
        near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        far = BITS[codes[some][:, None, :] ^ codes[near]].sum(-1)
        return int(np.quantile(far, share, method="higher"))

    def allowed(self, j: int) -> int:
        """Distance within which substring j is probed."""
        whole, rest = divmod(self.radius, self.substrings)
        return whole if j <= rest else whole - 1


class Shard:
    """The index of a shard: its codes, and for each substring the table of buckets."""

    def __init__(self, codes: Codes, x: np.ndarray):
        self.codes, self.index = codes, codes(x)
        self.rows = [np.argsort(self.index[:, j], kind="stable").astype(np.int32) for j in range(codes.substrings)]
        self.begin = [np.searchsorted(self.index[r, j], np.arange(257)).tolist() for j, r in enumerate(self.rows)]
        values = np.arange(256, dtype=np.uint8)
        self.near = [[np.flatnonzero(BITS[values ^ v] <= codes.allowed(j)).tolist() for v in range(256)] for j in range(codes.substrings)]

    def probe(self, code: np.ndarray) -> np.ndarray:
        """The rows in the buckets near a query's code, in order: all within the radius are among them."""
        found = np.zeros(len(self.index), bool)
        for rows, begin, near, value in zip(self.rows, self.begin, self.near, code.tolist()):
            some = [rows[begin[v] : begin[v + 1]] for v in near[value]]
            if some:
                found[np.concatenate(some)] = True
        return np.flatnonzero(found)

    def best(self, k: int, ids: np.ndarray, x: np.ndarray, query: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best for a query, which is itself the row `own` (or none: -1)."""
        code = self.codes(query[None])[0]
        at = self.probe(code)
        at = at[BITS[self.index[at] ^ code].sum(1, dtype=np.int64) <= self.codes.radius]
        at = at[at != own]
        if len(at) < k:
            far = BITS[self.index ^ code].sum(1, dtype=np.int64)
            far[own : own + 1] = 255 if own >= 0 else far[own : own + 1]
            more = np.argsort(far, kind="stable")[: k + 1]
            at = np.union1d(at, more[more != own][:k])
        score = (x[at] * query).sum(1)
        if len(at) > 4 * k:
            keep = score >= np.partition(score, -k)[-k]
            at, score = at[keep], score[keep]
        top = np.lexsort((ids[at], -score))[:k]
        return at[top], score[top]


def usable(df: DataFrame, key: str, vector: str, asked) -> DataFrame:
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(key).isNotNull() & v.isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.select(F.col(key).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def search(df: DataFrame, asked, k: int = 20, key: str = "vec_id", vector: str = "embedding", share: float = 0.95) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row for which the condition `asked` holds, its k nearest rows of df by inner product, itself left out."""
    spark, cores = df.sparkSession, df.sparkSession.sparkContext.defaultParallelism
    rows = usable(df, key, vector, asked)
    lengths = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).orderBy(F.desc("n"), "dim").head(1)
    dim, n, n_asked = (lengths[0].dim, lengths[0].n, lengths[0].asked) if lengths else (1, 0, 0)
    rows = rows.where(F.size("vector") == dim)
    digest = F.md5(F.col("vec_id").cast("string"))
    sample = rows.where(drawn(digest, SAMPLE, F.lit(n))).orderBy(digest, "vector").limit(SAMPLE).select("vector").toArrow()
    codes = Codes(_matrix(sample.column("vector"), dim), k, share)
    parts = lambda rows, most: max(1, -(-rows // most), min(cores, rows // LEAST))
    shards = Blocks(rows.repartition(parts(n, SHARD)), "vectors", 64)
    read = shards.reader(["vec_id", "vector", "asked"])

    def queries(block: Place):
        at = 0
        for batch in read(block, 4096):
            own = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False))
            some = batch.select(["vec_id", "vector"]).take(pa.array(own))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block), pa.int32()), pa.array(own + at, pa.int32()), *some.columns], ["block", "row", "vec_id", "vector"])
            at += batch.num_rows

    asked_rows = shards.map(queries, "block int, row int, vec_id long, vector array<double>")
    groups = Blocks(asked_rows.repartition(parts(n_asked, GROUP)), "queries", 64)
    read_queries = groups.reader(["block", "row", "vec_id", "vector"])
    each_group = groups.places_in_tasks()
    # a unit is a shard and one of `wide` shares of the groups; units of a shard stand together, so that its index is built once
    wide = max(1, min(groups.count, -(-MOST // max(1, shards.count))))
    tasks = max(1, min(shards.count * wide, MOST))
    units = shards.table.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    units = units.repartitionById(tasks, ((F.col("block") * F.lit(wide).cast("long") + F.col("share")) * tasks / (shards.span * wide)).cast("int")).sortWithinPartitions("block", "share")

    def run(batches):
        last, index, ids, x = -1, None, None, None
        for shard, group in ((p, g) for b in batches for p, share in zip(places(b), b.column("share").to_pylist()) for g in each_group(share, wide)):
            if shard != last:
                table = pa.Table.from_batches(read(shard, 65_536))
                last, ids, x = shard, table.column("vec_id").to_numpy(), _matrix(table.column("vector"), dim)
                index = Shard(codes, x)
            for batch in read_queries(group, 1024):
                out = [[] for _ in range(6)]
                for block, row, query_id, query in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)), _matrix(batch.column(3), dim)):
                    at, score = index.best(k, ids, x, query, row if block == shard else -1)
                    for column, values in zip(out, (np.full(len(at), block), np.full(len(at), row), np.full(len(at), query_id), ids[at], at, score)):
                        column.append(values)
                cols = [np.concatenate(c) for c in out]
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds)), pa.array(np.full(len(cols[0]), shard), pa.int32())], ["block", "row", "query_id", "vec_id", "at", "score", "shard"])

    found = units.mapInArrow(run, "block int, row int, query_id long, vec_id long, at int, score double, shard int")
    order = Window.partitionBy("block", "row").orderBy(F.desc("score"), "vec_id", "shard", "at")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

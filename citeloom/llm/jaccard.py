"""N-gram Jaccard join with count-vector R-trees.

Sets. A text's set holds its distinct shingles of consecutive words (A-Z lower-cased); texts of equal sets form a
class, found first, so that copies, however many, are one from then on.

Which sets may meet. A pair of similarity s or more of sets of sizes n and m shares at least ceil(s * n) shingles, so
in any common order of shingles it shares one of the first n - ceil(s * n) + 1 of each: the prefix. The order is by how
many classes hold a shingle, counted over all texts (see substring.py for how blocks exchange hashes without moving
texts). A set whose prefix is full of shingles that no other has is out. The rest are joined into candidate groups by
the shared shingles of their prefixes.

Pairs. Within a group, tokens are hashed to GROUPS coordinates and each set is the point of its counts; of two sets at
most the sum of their points' coordinate minima is shared. An R-tree over the points (each node: the largest count in
each coordinate, the range of sizes) gives, for each set, those that this bound and the sizes leave. Every pair left is
verified by its shingles: one by one, or, where most sets of a unit are left with most others, by products of the
matrix of sets and shingles, whichever costs less. Links are counted for each class within the tasks and only a
forest that connects similar sets is written, so pairs are not, however many. A group of more than CHUNK sets is dealt
into chunks by size band and hash, and every two chunks of equal or neighbouring bands meet in a task of their own:
exact, and bounded. Each similar pair meets in one task alone.

Shingles are compared by 64-bit hashes, classes by 128 bits.

Defined results: null and empty texts have an empty set and are linked with nothing; a text of fewer words than a
shingle has its whole word sequence as one. A component's id is its smallest doc_id, nulls aside; null if all are null.
Repeated rows are equal sets and share a component. Empty tables give empty results. join() drops other input columns,
whatever their names; dedup() returns all of them as they are.
"""

from __future__ import annotations

import math
import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST, Blocks, WordHashes, join_hot, mix, parts_of, windows, written
from .graph import components
from .substring import P1, SENT, send

#: Coordinates of a point, sets in a chunk, children of a tree's node, shingles in a product of matrices.
GROUPS, CHUNK, FAN, WIDE = 64, 512, 16, 8192
#: What a pair costs that is verified by itself, and a million of multiplications, in microseconds: these choose between two ways of the same result.
PAIR, PRODUCT = 15.0, 40.0
ANSWER = "block int, start long, count int, df binary"
#: Rows of a class from which it counts as hot when rows get their class's component, at least; of a table of n rows, a thousand classes at most are.
HOT = 1000


def sets_of(texts: pa.Array, words: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, bounds = hashes(texts)
    full = mix(windows(h, words, P1) + np.uint64(words))
    out = []
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if z - a >= words:
            out.append(np.unique(full[a : z - words + 1]))
        elif z > a:
            out.append(mix(windows(h[a:z], z - a, P1) + np.uint64(z - a)))
        else:
            out.append(h[:0])
    return out


class CountTree:
    """A static R-tree over count vectors, packed by size and then by their largest differences."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = np.argsort(-points.astype(np.float32).var(0))[:2] if len(points) else []
        order = np.lexsort([*(points[:, g] for g in spread[::-1]), sizes]) if len(points) else np.zeros(0, int)
        self.order = order
        self.levels = [(points[order], sizes[order], sizes[order])]
        while len(self.levels[-1][0]) > FAN:
            top, low, high = self.levels[-1]
            at = np.arange(0, len(top), FAN)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Indices of points whose overlap with this one may reach what the similarity needs."""
        alive = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = (x[alive] for x in self.levels[depth])
            fits = (high * 100 >= percent * size) & (low * percent <= 100 * size)
            bound = np.minimum(top, point).sum(1)
            alive = alive[fits & (bound * (100 + percent) >= percent * (size + np.maximum(low, -(-percent * size // 100))))]
            if depth:
                alive = (alive[:, None] * FAN + np.arange(FAN)).ravel()
                alive = alive[alive < len(self.levels[depth - 1][0])]
        return self.order[alive]


def shared_by(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles the sets of each pair (i, j) share."""
    used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    flat = np.concatenate([sets[k] for k in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    found, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    wide = int((times > 1).sum())
    if len(i) * PAIR <= len(used) ** 2 * wide * PRODUCT / 1e6:
        out = np.zeros(len(i), np.int64)
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
            a, b = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
            out[k] = (b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum() if len(a) else 0
        return out
    place = np.cumsum(times > 1) - 1  # a shingle of one set alone is shared by none
    keep = (times > 1)[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(used), len(used)), np.float32)
    for a in range(0, wide, WIDE):
        x, z = np.searchsorted(column, (a, a + WIDE))
        rows = np.zeros((len(used), min(WIDE, wide - a)), np.float32)
        rows[owner[x:z], column[x:z] - a] = 1
        both += rows @ rows.T
    return np.rint(both[back[: len(i)], back[len(i) :]]).astype(np.int64)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the graph of the edges (i, j)."""
    low = np.arange(n)
    while len(i):
        least = np.minimum(low[i], low[j])
        before = low.copy()
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        np.minimum.at(low, before[i], least)
        np.minimum.at(low, before[j], least)
        low = low[low]
        if (low[i] == low[j]).all():
            break
    while (low[low] != low).any():
        low = low[low]
    at = np.flatnonzero(low != np.arange(n))
    return at, low[at]


def link(sizes: np.ndarray, sets: list[np.ndarray], sides: list, percent: int, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges that connect all sets whose similarity is high enough, and how many such others each set has; across: only between different sides."""
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    where = (np.concatenate(sets) >> np.uint64(20)).astype(np.int64) % GROUPS if len(owner) else owner
    points = np.bincount(owner * GROUPS + where, minlength=len(sets) * GROUPS).reshape(-1, GROUPS).astype(np.int32)
    first = np.array([s == sides[0] for s in sides]) if across else np.ones(len(sets), bool)
    pool = np.flatnonzero(first)
    tree = CountTree(points[pool], sizes[pool])
    left, right = [], []
    for i in np.flatnonzero(~first).tolist() if across else range(len(sets)):
        near = pool[tree.near(points[i], int(sizes[i]), percent)]
        near = near if across else near[near < i]
        left.append(np.full(len(near), i))
        right.append(near)
    i, j = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (left, right))
    if not len(i):
        return i, j, np.zeros(len(sets), np.int64)
    both = shared_by(sets, i, j)
    like = 100 * both >= percent * (sizes[i] + sizes[j] - both)
    i, j = i[like], j[like]
    return *forest(len(sets), i, j), np.bincount(np.concatenate([i, j]), minlength=len(sets))


def _frequencies(table: pa.Table) -> pa.Table:
    """For each hash sent, how many classes hold it: 0 for one, else 16 times the binary logarithm."""
    h, n = [], []
    for data, count in zip(table.column("data").to_pylist(), table.column("count").to_pylist()):
        h.append(np.frombuffer(data, np.uint32, count))
        n.append(np.frombuffer(data, np.uint16, count, 4 * count))
    h, n = np.concatenate(h), np.concatenate(n)
    _, back = np.unique(h, return_inverse=True)
    level = np.minimum(255, 16 * np.log2(np.bincount(back, n))).astype(np.uint8)[back]
    blocks, starts, counts, df, at = [], [], [], [], 0
    for block, start, count in zip(*(table.column(c).to_pylist() for c in ("block", "start", "count"))):
        own = level[at : at + count]
        at += count
        if own.any():
            blocks.append(block)
            starts.append(start)
            counts.append(count)
            df.append(zlib.compress(own.tobytes(), 1))
    return pa.table({"block": pa.array(blocks, pa.int32()), "start": pa.array(starts, pa.int64()), "count": pa.array(counts, pa.int32()), "df": pa.array(df, pa.binary())})


class Join:
    """The join of one table with itself; rows() gives each row's place, set size, class and component."""

    def __init__(self, df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80, block_mb: int = 16, part_mb: int = 24, chunk: int = CHUNK):
        self.spark, self.words, self.percent, self.chunk, self.part_mb = df.sparkSession, words, percent, chunk, part_mb
        self.text, self.key = text, key
        self.blocks = Blocks(df, "jaccard", block_mb)

    def classes(self) -> DataFrame:
        """block, row, doc_id, n, class of every row."""
        read, words = self.blocks.reader([self.key, self.text]), self.words

        def run(block: int):
            hashes, at = WordHashes(fold=True), 0
            for batch in read(block):
                sets = sets_of(batch.column(1), words, hashes)
                names = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                n = len(sets)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * n, pa.int32()), "row": pa.array(range(at, at + n), pa.int32()), "doc_id": batch.column(0).cast(pa.int64()), "n": pa.array(map(len, sets), pa.int64()), "class": pa.array(names, pa.binary())})
                at += n

        return self.blocks.map(run, "block int, row int, doc_id long, n long, class binary")

    def candidates(self, first_rows: DataFrame) -> DataFrame:
        """first_rows(block, rows): one row of each class -> class, n, prefix (shared shingles), shared (sorted hashes) of sets that may be similar to another."""
        read, words, percent = self.blocks.reader([self.text]), self.words, self.percent
        parts = parts_of(self.blocks.bytes, self.spark, self.part_mb)

        def sets_at(block: int, given: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            """The sets of the chosen rows, flat, and their sizes."""
            rows = np.array(sorted(r for some in given.column("rows").to_pylist() if some is not None for r in some), np.int64)
            hashes, at, sets = WordHashes(fold=True), 0, []
            for batch in read(block) if len(rows) else ():
                own = rows[np.searchsorted(rows, at) : np.searchsorted(rows, at + batch.num_rows)] - at
                at += batch.num_rows
                sets += sets_of(batch.column(0).take(pa.array(own)), words, hashes)
            return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.array(list(map(len, sets)), np.int64)

        def tell(block: int, given: pa.Table):
            flat, _ = sets_at(block, given)
            if len(flat):
                own, counts = np.unique(flat, return_counts=True)
                yield from send(block, own, parts, [own.astype(np.uint32), np.minimum(counts, 65535).astype(np.uint16)])

        def pick(block: int, given: pa.Table):
            flat, size = sets_at(block, given)
            if not len(flat):
                return
            order = np.argsort(flat)
            ascending = flat[order]
            group = np.cumsum(np.concatenate(([False], ascending[1:] != ascending[:-1])))
            level = np.zeros(int(group[-1]) + 1, np.uint8)
            for start, count, df in zip(*(given.column(c).to_pylist() for c in ("start", "count", "df"))):
                if df is not None:
                    level[start : start + count] = np.frombuffer(zlib.decompress(df), np.uint8)
            every = np.empty(len(flat), np.uint8)
            every[order] = level[group]
            del order, ascending, group
            ends = np.concatenate(([0], np.cumsum(size)))
            for a in range(0, len(size), 256):
                z = min(a + 256, len(size))
                s, n = flat[ends[a] : ends[z]], size[a:z]
                held = every[ends[a] : ends[z]]
                owner = np.repeat(np.arange(z - a), n)
                alone = np.bincount(owner[held == 0], minlength=z - a)
                room = n + (-percent * n // 100) + 1 - alone
                fit = (room > 0) & (alone < n)
                keep = fit[owner] & (held > 0)
                shared, held, owner = s[keep], held[keep], owner[keep]
                order = np.argsort((owner << 8 | held).astype(np.uint16), kind="stable")  # sets are in ascending order already
                count = np.bincount(owner, minlength=z - a)
                begin = np.concatenate(([0], np.cumsum(count)))
                inside = np.arange(len(order)) - np.repeat(begin[:-1], count) < np.repeat(room, count)
                prefix, taken = shared[order][inside].view(np.int64), np.bincount(owner[inside], minlength=z - a)
                which = np.flatnonzero(fit)
                names = [blake2b(flat[ends[a + k] : ends[a + k + 1]].tobytes(), digest_size=16).digest() for k in which]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(taken[which]))), pa.int32()), pa.array(prefix))
                held_by = [shared[begin[k] : begin[k + 1]].tobytes() for k in which]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(n[which], pa.int64()), lists, pa.array(held_by, pa.binary())], ["class", "n", "prefix", "shared"])

        sent = self.blocks.map_with(first_rows, tell, SENT)
        told = written(sent.repartitionById(min(parts, MOST), "part").groupBy("part").applyInArrow(_frequencies, ANSWER), "frequencies")
        marks = first_rows.withColumns({"start": F.lit(None).cast("long"), "count": F.lit(None).cast("int"), "df": F.lit(None).cast("binary")})
        marks = marks.unionByName(told.withColumn("rows", F.lit(None).cast("array<int>")))
        return written(self.blocks.map_with(marks, pick, "class binary, n long, prefix array<long>, shared binary"), "candidates")

    def links(self, candidates: DataFrame) -> DataFrame:
        """Edges a, b between classes that connect what is similar, and rows a = b with n, a class's links in one task; each similar pair meets in one task alone."""
        by_shingle = candidates.select("class", F.explode("prefix").alias("s"))
        low = by_shingle.groupBy(F.col("s").alias("t")).agg(F.min("class").alias("m"), F.count("*").alias("k")).where("k > 1")
        low = written(low, "shingles")  # a table of its own: adaptive execution can then split a shingle of many sets
        meet = by_shingle.join(low, F.col("s") == F.col("t")).select(F.col("class").alias("a"), F.col("m").alias("b")).distinct()
        groups = written(components(meet), "groups")
        step = math.log(100 / self.percent) + 1e-9 if self.percent < 100 else 1.0
        band = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")
        rows = candidates.join(groups, F.col("class") == F.col("node")).select(F.col("root").alias("g"), "class", "n", "shared", band.alias("band"))
        counts = candidates.select("class", band.alias("band")).join(groups, F.col("class") == F.col("node")).groupBy(F.col("root").alias("_g"), F.col("band").alias("_b")).agg(F.count("*").alias("k"))
        per = counts.groupBy("_g").agg(F.sum("k").alias("all"), F.map_from_entries(F.collect_list(F.struct("_b", F.ceil(F.col("k") / self.chunk).cast("int")))).alias("chunks"))  # some hundred bands at most
        rows = rows.join(per, F.col("g") == F.col("_g"))
        at = lambda d: F.coalesce(F.try_element_at("chunks", F.col("band") + d), F.lit(0))
        rows = rows.withColumn("h", F.pmod(F.xxhash64("class"), at(0)).cast("int"))
        unit = lambda kind, low, i, j: F.struct(F.lit(kind).alias("kind"), low.cast("int").alias("low"), i.cast("int").alias("i"), j.cast("int").alias("j"))
        upto = lambda d: F.when(at(d) > 0, F.sequence(F.lit(0), at(d) - 1)).otherwise(F.array().cast("array<int>"))
        many = F.concat(
            F.transform(upto(0), lambda j: unit(1, F.col("band"), F.least(F.col("h"), j), F.greatest(F.col("h"), j))),
            F.transform(upto(1), lambda j: unit(2, F.col("band"), F.col("h"), j)),
            F.transform(upto(-1), lambda j: unit(2, F.col("band") - 1, j, F.col("h"))),
        )
        few = F.array(unit(0, F.lit(0), F.lit(0), F.lit(0)))
        rows = rows.withColumn("unit", F.explode(F.when(F.col("all") <= self.chunk, few).otherwise(many)))
        rows = rows.select("g", "unit", "class", "n", "shared", F.struct("band", "h").alias("side"))
        percent = self.percent

        def run(t: pa.Table) -> pa.Table:
            u = t.column("unit")[0].as_py()
            across = u["kind"] == 2 or u["kind"] == 1 and u["i"] != u["j"]
            sides = [(s["band"], s["h"]) for s in t.column("side").to_pylist()]
            if across and u["kind"] == 1:
                sides = [s[1] for s in sides]
            sets = [np.frombuffer(s, np.uint64) for s in t.column("shared").to_pylist()]
            a, b, counts = link(t.column("n").to_numpy(), sets, sides, percent, across)
            own = np.flatnonzero(counts)
            names = t.column("class").combine_chunks()
            a, b, n = np.concatenate([a, own]), np.concatenate([b, own]), np.concatenate([np.zeros(len(a), np.int64), counts[own]])
            return pa.table({"a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "n": pa.array(n, pa.int64())})

        # without this the join's partitions by g alone would do for the groups, and all units of a group would meet in one task
        return rows.repartition("g", "unit").groupBy("g", "unit").applyInArrow(run, "a binary, b binary, n long")

    def rows(self) -> DataFrame:
        """block, row, doc_id, n, component (its smallest doc_id), root (one class of the component, null without words) and links (how many other classes its own is similar to) of every row."""
        all_rows = written(self.classes(), "classes")
        some = all_rows.where("n > 0")
        kinds = written(some.groupBy("class").agg(F.min("doc_id").alias("low"), F.min(F.struct("block", "row")).alias("at"), F.count("*").alias("copies")), "kinds")
        first = kinds.groupBy(F.col("at.block").alias("block")).agg(F.collect_list("at.row").alias("rows"))
        links = written(self.links(self.candidates(first)), "links")
        linked = components(links)
        whole = kinds.select("class", "low").join(linked, F.col("class") == F.col("node")).select("class", "low", "root")
        lowest = whole.groupBy(F.col("root").alias("_r")).agg(F.min("low").alias("_low"))
        whole = whole.join(lowest, F.col("root") == F.col("_r")).select(F.col("class").alias("_class"), F.col("_low"), F.col("root").alias("_root"))
        # a component may have rows of null ids alone, so only whether it is in whole tells whether a class is linked
        low = F.when(F.col("_root").isNull(), F.col("low")).otherwise(F.col("_low"))
        each = kinds.select(F.col("class").alias("_c"), "low", "copies").join(whole, F.col("_c") == F.col("_class"), "left").select("_c", "copies", low.alias("component"), F.coalesce("_root", "_c").alias("root"))
        counts = links.where("a = b").groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("links"))
        each = written(each.join(counts, F.col("_c") == F.col("_a"), "left").drop("_a"), "components")
        out = join_hot(all_rows, "class", each, "_c", "copies", HOT)
        return out.select("block", "row", "doc_id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component"), "root", F.coalesce("links", F.lit(0)).alias("links"))


def join(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80, **how) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row of df: how many other classes (texts of unlike sets) are similar to its own, each counted once however many copies it has; 0 without words."""
    rows = Join(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", "doc_id", words, percent, **how).rows()
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links"))


def dedup(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80, **how) -> DataFrame:
    """The rows of df, all columns, of which each component of similar texts keeps one: that of its smallest key (nulls last), the first in place if several share it. Texts without words stay."""
    j = Join(df, text, key, words, percent, **how)
    rows = j.rows()
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "block", "row"))
    stay = rows.where("n > 0").groupBy("root").agg(best.alias("at")).select("at.block", "at.row")
    return j.blocks.take(stay.unionByName(rows.where("n = 0").select("block", "row")))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
y AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (WITH RECURSIVE c(d, x) AS (SELECT doc_id, doc_id FROM s UNION SELECT c.d, y.b FROM c JOIN y ON c.x = y.a) SELECT d, min(x) AS component_id FROM c GROUP BY d),
k AS (SELECT doc_id, md5(array_to_string(list_sort(s), chr(10))) AS k FROM s),
l AS (SELECT y.a, count(DISTINCT k.k) FILTER (k.k <> o.k) AS n FROM y JOIN k ON y.b = k.doc_id JOIN k o ON y.a = o.doc_id GROUP BY y.a)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, coalesce(l.n, 0)::BIGINT AS n_links FROM s JOIN r ON s.doc_id = d LEFT JOIN l ON l.a = s.doc_id
"""

r"""Near duplicates by MinHash: an inverted join over the coordinates of signatures.

Sets are those of jaccard.py: a text's distinct shingles; texts of equal sets form a class and are one from then on. A
class has a signature of COORDINATES minima, one for each of as many hash functions. Two sets of similarity s agree in
a coordinate with probability s, so at 0.8 they agree in fewer than AGREE of 64 with a probability below 2e-8.

Inverted join. Every class is posted under each of its (coordinate, value) pairs. Pairs posted by one class alone can't
collide. A class with fewer than AGREE shared pairs is out; of the m shared pairs of another, in order of how many
classes post them, the first m - AGREE + 1 are its prefix: two classes that agree in AGREE coordinates share a pair of
both prefixes. So only posting lists of prefixes are merged. Within a list the collisions of a class with the others
are counted a stride of coordinates at a time, and those that can't reach AGREE any more are skipped.

Links. Components of what agrees often enough hold all similar pairs. The members' whole sets are then brought together
and every link taken is confirmed on them. In both steps a search goes from one member to all that aren't reached yet and
takes those it links to out, so a group of near copies takes a few looks at each, not one for every pair, and only the
tree of the search is written: fewer edges than members.

Large groups. A list, or a component, above CHUNK bytes is dealt into chunks by hash, each with the group's first
PIVOTS members, through which near copies are connected across chunks. Members that are then outside their group's largest
component meet every chunk: no pair in two components stays unlooked at, and the members of the largest one needn't meet again.

Defined results: null and empty texts have an empty set, are linked with nothing and are kept; a text of fewer words
than a shingle has its whole word sequence as one. A component's id is its smallest doc_id, nulls aside; null if all are
null. kept is doc_id = component_id; where doc_id is null, false in a component that has an id, true otherwise. Repeated rows
are equal sets and share a component (and kept, where they share their id); dedup() keeps one row of each component. Empty tables give empty results.
near() drops other input columns, whatever their names; dedup() returns all of them as they are. A link is lost only where signatures disagree, as said above.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Blocks, Place, WordHashes, join_hot, written
from .graph import components
from .jaccard import HOT, sets_of

#: Coordinates of a signature, and in how many of them two sets have to agree to be looked at. For a similarity below 0.8, agree() tells fewer.
COORDINATES, STRIDE = 64, 16
#: Bytes of signatures or sets that meet in a unit, at most, about; members of a group that go with each of its chunks.
CHUNK, PIVOTS = 8 << 20, 8


def agree(percent: int, miss: float = 2e-8) -> int:
    """The most coordinates of which two sets of this similarity agree in fewer with a probability of `miss` at most."""
    from math import comb

    p, below, t = percent / 100, 0.0, 0
    while t < COORDINATES and below + comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t) <= miss:
        below += comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
        t += 1
    return max(1, t)


_rng = np.random.default_rng(64)
FACTORS = _rng.integers(0, 1 << 63, COORDINATES, np.uint64) << np.uint64(1) | np.uint64(1)
ADDED = _rng.integers(0, 1 << 63, COORDINATES, np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDINATES minima (32 bits) for each set; sets aren't empty."""
    out = np.empty((len(sets), COORDINATES), np.uint32)
    if not len(sets):
        return out
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    with np.errstate(over="ignore"):
        for c in range(COORDINATES):
            out[:, c] = np.minimum.reduceat(((flat * FACTORS[c] + ADDED[c]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def thin(signature: np.ndarray) -> np.ndarray:
    """16 bits of each coordinate: enough to count collisions by (one in 65,536 is false, which costs a look)."""
    return (signature * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def colliding(signature: np.ndarray, of: int, among: np.ndarray, least: int) -> np.ndarray:
    """Those of `among` that agree with `of` in `least` coordinates, counted by strides; who can't get there is skipped."""
    own, found = signature[of], np.zeros(len(among), np.int64)
    for a in range(0, COORDINATES, STRIDE):
        found += (signature[among, a : a + STRIDE] == own[a : a + STRIDE]).sum(1)
        may = found + (COORDINATES - a - STRIDE) >= least
        if not may.all():
            among, found = among[may], found[may]
    return among


class Similar:
    """Confirms on whole sets which members a member is similar to."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent, self.size = sets, percent, np.array([len(s) for s in sets], np.int64)

    def __call__(self, of: int, among: np.ndarray) -> np.ndarray:
        n, m = self.size[of], self.size[among]
        among = among[100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)]
        shared, own = np.zeros(len(among), np.int64), self.sets[of]
        at = 0
        while at < len(among):
            z = at + max(1, int(np.searchsorted(np.cumsum(self.size[among[at:]]), 1 << 18)))
            flat = np.concatenate([self.sets[i] for i in among[at:z]])
            hit = own[np.minimum(np.searchsorted(own, flat), n - 1)] == flat
            shared[at:z] = np.add.reduceat(hit, np.concatenate(([0], np.cumsum(self.size[among[at:z]])[:-1])), dtype=np.int64)
            at = z
        return among[100 * shared >= self.percent * (n + self.size[among] - shared)]


def search(signature: np.ndarray, least: int, confirm=None, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of trees that span what is connected. known: members that share a number are connected already, and aren't compared."""
    n = len(signature)
    own, frontier, a, b = np.zeros(n, bool), [], [], []
    left = np.arange(n)
    group = np.arange(n) if known is None else known
    while len(left):
        if not frontier:
            frontier = [int(left[0])]
            own[frontier[0]] = True
        of = frontier.pop()
        left = left[~own[left]]
        met = left[group[left] == group[of]] if known is not None else left[:0]
        other = left[group[left] != group[of]] if known is not None else left
        near = colliding(signature, of, other, least)
        near = confirm(of, near) if confirm is not None and len(near) else near
        a += [of] * len(near)
        b += near.tolist()
        for some in (met, near):
            own[some] = True
            frontier += some.tolist()
        left = left[~own[left]]
    return np.array(a, np.int64), np.array(b, np.int64)


UNIT = ["g", "h", "node", "thin", "data", "known"]


def _edges(least: int, percent: int | None):
    """A function for units: their rows -> edges between nodes. Rows of several groups may share a unit; each (g, h) is searched by itself."""

    def run(table: pa.Table) -> pa.Table:
        g, h, node = (table.column(c).to_numpy() for c in ("g", "h", "node"))
        order = np.lexsort((node, h, g))
        g, h, node = g[order], h[order], node[order]
        edge = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (h[1:] != h[:-1]), [True])))
        signature = np.frombuffer(b"".join(table.column("thin").take(pa.array(order)).to_pylist()), np.uint16).reshape(-1, COORDINATES)
        data, known = table.column("data").take(pa.array(order)), table.column("known").take(pa.array(order)).to_numpy()
        first, second = [], []
        for x, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if z - x < 2:
                continue
            confirm = None if percent is None else Similar([np.frombuffer(s, np.uint64) for s in data.slice(x, z - x).to_pylist()], percent)
            a, b = search(signature[x:z], least, confirm, known[x:z] if (known[x:z] != node[x:z]).any() else None)
            first.append(node[x:z][a])
            second.append(node[x:z][b])
        a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (first, second))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def connect(rows: DataFrame, least: int, percent: int | None, chunk: int = CHUNK) -> DataFrame:
    """rows(g, node, thin, data), written: members of groups -> edges a, b that span what is similar within each group."""
    weight = F.octet_length("thin") + F.octet_length("data") + 16
    totals = rows.groupBy(F.col("g").alias("_g")).agg(F.count("*").alias("k"), F.sum(weight).alias("bytes"))
    totals = written(totals.where("k > 1").withColumn("chunks", F.ceil(F.col("bytes") / chunk).cast("int")), "minhash-groups")
    all_bytes, most = totals.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("chunks"), F.lit(1))).first()
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = max(shuffles, 2 * -(-all_bytes // chunk))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    rows = rows.join(totals, F.col("g") == F.col("_g")).withColumn("h", own)

    def searched(some: DataFrame) -> DataFrame:
        some = some.select(*UNIT, F.pmod(F.xxhash64("g", "h"), F.lit(units)).alias("unit"))
        return some.repartition("unit").groupBy("unit").applyInArrow(_edges(least, percent), "a long, b long")

    firsts = rows.withColumn("known", F.col("node"))
    if most == 1:
        return searched(firsts)
    # each chunk of a large group also has the group's first members
    rank = F.row_number().over(Window.partitionBy("g").orderBy("node"))
    pivots = rows.where("chunks > 1").withColumn("rank", rank).where(F.col("rank") <= PIVOTS)
    pivots = pivots.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("h <> to").withColumn("h", F.col("to"))
    found = written(searched(firsts.unionByName(pivots.withColumn("known", F.col("node")).select(firsts.columns))), "minhash-edges")
    # what is outside the largest component of a large group meets all of its chunks
    roots = written(components(found), "minhash-roots")
    large = rows.where("chunks > 1").join(roots.select(F.col("node").alias("_n"), "root"), F.col("node") == F.col("_n"), "left")
    large = written(large.select("g", "h", "chunks", "node", "thin", "data", F.coalesce("root", "node").alias("known")), "minhash-large")
    main = large.groupBy("g", "known").agg(F.count("*").alias("k")).groupBy(F.col("g").alias("_g")).agg(F.max(F.struct("k", "known"))["known"].alias("main"))
    outside = large.join(main, F.col("g") == F.col("_g")).where("known <> main").drop("_g", "main")
    places = outside.groupBy(F.col("g").alias("_g")).agg(F.collect_set("h").alias("from"))  # chunks of one group
    pair = lambda i, j: F.concat_ws(":", i.cast("string"), j.cast("string"))
    every = large.join(places, F.col("g") == F.col("_g")).withColumn("i", F.explode("from")).withColumn("pair", pair(F.col("i"), F.col("h")))
    those = outside.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("h <> j").withColumn("pair", pair(F.col("h"), F.col("j")))
    again = every.select("g", "pair", "node", "thin", "data", "known").unionByName(those.select("g", "pair", "node", "thin", "data", "known"))
    return found.unionByName(searched(again.withColumn("h", (F.crc32("pair") - F.lit(1 << 31)).cast("int"))))


class MinHash:
    """Near duplicates within a table; rows() gives each row's place, set size, node and component."""

    def __init__(self, df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80, block_mb: int = 16, chunk: int = CHUNK):
        self.words, self.percent, self.chunk, self.least = words, percent, chunk, agree(percent)
        self.blocks, self.text, self.key = Blocks(df, "minhash", block_mb), text, key

    def classes(self) -> DataFrame:
        """block, row, doc_id, n, class and signature of every row."""
        read, words = self.blocks.reader([self.key, self.text]), self.words

        def run(block: Place):
            hashes, at = WordHashes(fold=True), 0
            for batch in read(block):
                sets = sets_of(batch.column(1), words, hashes)
                full = [i for i, s in enumerate(sets) if len(s)]
                made = signatures([sets[i] for i in full])
                names, told = [None] * len(sets), [None] * len(sets)
                for i, s in zip(full, made):
                    names[i], told[i] = blake2b(sets[i].tobytes(), digest_size=16).digest(), s.tobytes()
                n = len(sets)
                cols = [pa.array([block] * n, pa.int32()), pa.array(range(at, at + n), pa.int32()), batch.column(0).cast(pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(names, pa.binary()), pa.array(told, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["block", "row", "doc_id", "n", "class", "signature"])
                at += n

        return self.blocks.map(run, "block int, row int, doc_id long, n long, class binary, signature binary")

    def lists(self, kinds: DataFrame) -> DataFrame:
        """kinds(node, signature) -> g (coordinate and value), node, thin, data (empty): posting lists of prefixes, of two members or more."""
        least = self.least

        def post(batches):
            for b in batches:
                for a in range(0, b.num_rows, 4096):
                    some = b.slice(a, 4096)
                    s = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
                    token = np.arange(COORDINATES, dtype=np.int64) << 32 | s.astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some.column(0).to_numpy(), COORDINATES)), pa.array(token.ravel())], ["node", "token"])

        posts = kinds.select("node", "signature").mapInArrow(post, "node long, token long")
        times = written(posts.groupBy(F.col("token").alias("t")).agg(F.count("*").alias("k")).where("k > 1"), "minhash-lists")
        shared = posts.join(times, F.col("token") == F.col("t")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "token"))).alias("own"))  # COORDINATES at most
        prefix = shared.where(F.size("own") >= least).select(F.col("node").alias("of"), F.slice("own", F.lit(1), F.size("own") - least + 1).alias("own"))

        def thinned(batches):
            for b in batches:
                s = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in thin(s)], pa.binary()), b.column(2)], ["node", "thin", "tokens"])

        tokens = F.transform("own", lambda x: x["token"])
        rows = kinds.select("node", "signature").join(prefix, F.col("node") == F.col("of")).select("node", "signature", tokens.alias("tokens"))
        rows = rows.mapInArrow(thinned, "node long, thin binary, tokens array<long>")
        return written(rows.select(F.explode("tokens").alias("g"), "node", "thin", F.lit(b"").alias("data")), "minhash-prefixes")

    def sets(self, members: DataFrame) -> DataFrame:
        """members(node, root) -> g (root), node, thin, data: whole sets, made anew from the texts where they lie."""
        read, words = self.blocks.reader([self.text]), self.words

        def run(block: Place, given: pa.Table):
            own = sorted((m["row"], m["root"]) for some in given.column("rows").to_pylist() for m in some)
            rows, roots = np.array([r for r, _ in own], np.int64), np.array([g for _, g in own], np.int64)
            hashes, at = WordHashes(fold=True), 0
            for batch in read(block) if len(rows) else ():
                x, z = np.searchsorted(rows, (at, at + batch.num_rows))
                if z > x:
                    sets = sets_of(batch.column(0).take(pa.array(rows[x:z] - at)), words, hashes)
                    cols = [pa.array(roots[x:z]), pa.array(rows[x:z] + (int(block) << 32)), pa.array([s.tobytes() for s in thin(signatures(sets))], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["g", "node", "thin", "data"])
                at += batch.num_rows

        place = F.struct(F.col("node").bitwiseAND((1 << 32) - 1).cast("int").alias("row"), "root")
        marks = members.groupBy(F.shiftright("node", 32).cast("int").alias("block")).agg(F.collect_list(place).alias("rows"))  # a block's rows at most
        return written(self.blocks.map_with(marks, run, "g long, node long, thin binary, data binary"), "minhash-sets")

    def rows(self) -> DataFrame:
        """block, row, doc_id, n, component (its smallest doc_id) and root (one node of it, null without words) of every row."""
        rows = written(self.classes(), "minhash-rows")
        node = F.min(F.shiftleft(F.col("block").cast("long"), 32).bitwiseOR(F.col("row").cast("long")))
        kinds = rows.where("n > 0").groupBy("class").agg(node.alias("node"), F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.first("signature").alias("signature"))
        kinds = written(kinds, "minhash-classes")
        near = components(connect(self.lists(kinds), self.least, None, self.chunk))
        links = connect(self.sets(near), self.least, self.percent, self.chunk)
        linked = written(components(links).select(F.col("node").alias("_n"), "root"), "minhash-linked")
        each = kinds.select(F.col("class").alias("_c"), "node", "low", "copies").join(linked, F.col("node") == F.col("_n"), "left")
        each = written(each.select("_c", "low", "copies", F.coalesce("root", "node").alias("root")), "minhash-roots")
        lowest = each.groupBy(F.col("root").alias("_r")).agg(F.min("low").alias("component"), F.count("*").alias("k")).where("k > 1").drop("k")
        each = each.join(lowest, F.col("root") == F.col("_r"), "left")
        # a component of several classes may have rows of null ids alone: its id is null then, and so is each member's low
        each = written(each.select("_c", "copies", "root", F.coalesce("component", "low").alias("component")), "minhash-components")
        out = join_hot(rows.drop("signature"), "class", each, "_c", "copies", HOT)
        return out.select("block", "row", "doc_id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component"), "root")


def near(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80, **how) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of df."""
    rows = MinHash(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", "doc_id", words, percent, **how).rows()
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def first_of(rows: DataFrame, at: Column) -> DataFrame:
    return rows.groupBy("root").agg(F.min(at).alias("at")).select("at.block", "at.row")


def dedup(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80, **how) -> DataFrame:
    """The rows of df, all columns, of which each component of similar texts keeps one: that of its smallest key (nulls last), the first in place if several share it. Texts without words stay."""
    m = MinHash(df, text, key, words, percent, **how)
    rows = written(m.rows(), "minhash-decided")
    stay = first_of(rows.where("n > 0"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "block", "row"))
    return m.blocks.take(stay.unionByName(rows.where("n = 0").select("block", "row")))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)),
y AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (WITH RECURSIVE c(d, x) AS (SELECT doc_id, doc_id FROM s UNION SELECT c.d, y.b FROM c JOIN y ON c.x = y.a) SELECT d, min(x) AS component_id FROM c GROUP BY d)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN r ON s.doc_id = d
"""

"""Shared folder, tables written to cut lineage, and block access for the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Partitions of a shuffle that deals blocks or ranges by their number, at most; beyond that several share one.
MOST = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode is one made up."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="citeloom-"))
        found = sc.getCheckpointDir()
    path = sc._jvm.org.apache.hadoop.fs.Path(str(found))  # a path without a scheme is one of the default file system
    return str(path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString())


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/citeloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table in the shared folder: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, key: str, table: DataFrame, other: str, count: str, least: int) -> DataFrame:
    """rows left join table on key = other, where table (one row a key, written) says in count how many rows have the key.

    Keys of more rows than a thousandth of all and than `least` number fewer than 1,000, however large the table: these
    are broadcast, so that their rows stay where they are and none meets in one task; the others are shuffled.
    """
    bound = max(least, int(table.agg(F.sum(count)).first()[0] or 0) // 1000)
    hot = table.where(F.col(count) > bound)
    names = F.broadcast(hot.select(F.col(other).alias("_hot")))  # fewer than 1,000 rows
    marked = rows.join(names, F.col(key) == F.col("_hot"), "left")
    some = marked.where("_hot IS NOT NULL").drop("_hot").join(F.broadcast(hot), F.col(key) == F.col(other), "left")
    rest = marked.where("_hot IS NULL").drop("_hot").join(table.where(F.col(count) <= bound), F.col(key) == F.col(other), "left")
    return rest.unionByName(some)


def drawn(digest, wanted: int, rows):
    """Whether a row may be among the `wanted` first of `rows` in the order of an MD5 digest (hex): passes four times as many, so that few rows are sorted or moved."""
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return place * rows <= 4.0 * wanted + 100


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI. Spark's names for S3 are read as pyarrow's own."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    for known in ("s3a://", "s3n://"):
        uri = "s3://" + uri[len(known) :] if uri.startswith(known) else uri
    return fs.FileSystem.from_uri(uri)


#: Bytes of rows that are read at once, about.
READ = 8 << 20


class Place(int):
    """A block's number, which knows where its rows lie: a run of rows of consecutive row groups of one file."""

    def __new__(cls, number: int, uri: str, first: int, last: int, skip: int, rows: int, size: int):
        own = super().__new__(cls, number)
        own.uri, own.groups, own.skip, own.rows, own.size = uri, range(first, last + 1), skip, rows, size
        return own


PLACE = "block int, _uri string, _first int, _last int, _skip long, _rows long, _size long"
NAMES = [c.split()[0] for c in PLACE.split(", ")]


def places(table: pa.Table | pa.RecordBatch):
    """The places that rows of the table of blocks tell."""
    for own in zip(*(table.column(c).to_pylist() for c in NAMES)):
        yield Place(*own)


def cut(groups: list[tuple[int, int]], target: int):
    """Rows and bytes of a file's row groups -> (first, last, skip, rows, bytes a row) of blocks of `target` bytes, about: small groups are joined, large ones split."""
    held: list[int] = []
    for k, (rows, size) in enumerate([*groups, (0, target)]):
        if held and (size >= target or sum(groups[i][1] for i in held) + size > target):
            n = sum(groups[i][0] for i in held)
            yield held[0], held[-1], 0, n, max(1, sum(groups[i][1] for i in held) // n)
            held = []
        if not rows:
            continue
        if size < target:
            held.append(k)
            continue
        each = -(-rows // min(rows, -(-size // target)))
        for start in range(0, rows, each):
            yield k, k, start, min(each, rows - start), max(1, size // rows)


class Blocks:
    """Rows kept in a table in the shared folder, read in blocks.

    A block is a run of rows of one file, of block_mb uncompressed (up to four times that in tables of many TB, so that
    their blocks stay below some millions). Row groups are closed by their compressed size, so one that holds more is
    read as several blocks, of as many rows each as hold that on the group's average; and rows are read a few MB at a
    time, however long they are. So a task that holds a block's hashes is bounded whatever the table's size and its
    texts' lengths (a block of rows much longer than their group's average aside). Blocks never change once written, so
    a rerun task sees the same rows in the same order; rows are named by (block, position).

    Where blocks lie is a table too (PLACE): its rows start the tasks, several blocks a task where there are many. The
    driver knows three totals of it and the executors the rows that reach them.
    """

    def __init__(self, df: DataFrame, name: str, block_mb: int = 16):
        spark = df.sparkSession
        path = scratch(spark, name)
        df.write.option("compression", "zstd").option("parquet.block.size", block_mb << 20).option("parquet.page.size.row.check.min", 4).option("parquet.page.size.row.check.max", 64).parquet(path)
        self.spark, self.schema, self.path = spark, df.schema, path
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")  # contents aren't read
        n, stored = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        target = min(4, max(1, (stored >> 41))) * (block_mb << 20)

        def footers(batches):
            for b in batches:
                for uri in b.column(0).to_pylist():
                    system, at = open_fs(uri)
                    with system.open_input_file(at) as f:
                        meta = pq.ParquetFile(f).metadata
                    groups = [(meta.row_group(k).num_rows, meta.row_group(k).total_byte_size) for k in range(meta.num_row_groups)]
                    found = list(cut(groups, target))
                    first, last, skip, rows, size = (list(c) for c in zip(*found)) if found else ([],) * 5
                    cols = [[int(uri.rsplit("/part-", 1)[1].split("-")[0])] * len(found), range(len(found)), [uri] * len(found), first, last, skip, rows, size]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["_part", "_k", *NAMES[1:]])

        told = files.repartition(max(1, min(n, 1024))).mapInArrow(footers, "_part int, _k int, " + PLACE.split(", ", 1)[1])
        told = written(told, f"{name}-blocks")
        # a file's number times the most blocks of a file, and the block's place in it: as good as dense
        wide, high, self.count, self.bytes = told.agg(F.coalesce(F.max("_k") + 1, F.lit(1)), F.coalesce(F.max("_part") + 1, F.lit(0)), F.count("*"), F.coalesce(F.sum(F.col("_rows") * F.col("_size")), F.lit(0))).first()
        self.span, self._wide, self._told = wide * high, wide, told
        self.table = told.select((F.col("_part") * wide + F.col("_k")).cast("int").alias("block"), *NAMES[1:])

    def reader(self, columns: list[str]):
        """A function for tasks: place of a block -> batches of its rows, in order."""

        def read(place: Place, batch: int = 256):
            skip, left = place.skip, place.rows
            system, at = open_fs(place.uri)
            with system.open_input_file(at) as f:
                for some in pq.ParquetFile(f).iter_batches(batch_size=max(1, min(batch, READ // place.size)), row_groups=list(place.groups), columns=columns):
                    if skip >= some.num_rows:
                        skip -= some.num_rows
                        continue
                    some = some.slice(skip, left)
                    skip, left = 0, left - some.num_rows
                    yield some
                    if not left:
                        return

        return read

    def places_in_tasks(self):
        """A function for tasks: (share, of how many) -> the places of every so many-th block, read from the table of blocks."""
        uris = self.spark.sparkContext.broadcast(sorted(self._told.inputFiles()))
        wide, columns = self._wide, ["_part", "_k", *NAMES[1:]]

        def each(share: int, shares: int):
            at = 0
            for uri in uris.value:
                system, path = open_fs(uri)
                with system.open_input_file(path) as f:
                    for b in pq.ParquetFile(f).iter_batches(batch_size=4096, columns=columns):
                        for part, k, *own in zip(*(c.to_pylist() for c in b.columns)):
                            if at % shares == share:
                                yield Place(part * wide + k, *own)
                            at += 1

        return each

    def frame(self) -> DataFrame:
        """The rows as a DataFrame."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def dealt(self) -> DataFrame:
        """The table of blocks, one block a partition, or several where there are more than MOST."""
        return self.table.repartitionById(max(1, min(self.span, MOST)), "block")

    def map(self, function, schema: str) -> DataFrame:
        """function(place) yields record batches, for every block."""

        def run(batches):
            for b in batches:
                for place in places(b):
                    yield from function(place)

        return self.dealt().mapInArrow(run, schema)

    def map_with(self, marks: DataFrame, function, schema: str) -> DataFrame:
        """function(place, table of the marks for it) yields record batches; marks has a column block. Every block runs, also without marks."""
        both = self.table.withColumn("_given", F.lit(False)).unionByName(marks.withColumn("_given", F.lit(True)), allowMissingColumns=True)

        def run(table: pa.Table) -> pa.Table:
            own, given = table.filter(pc.invert(table.column("_given"))), table.filter(table.column("_given"))
            out = [x for place in places(own) for x in function(place, given)]
            return pa.Table.from_batches(out) if out else None

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
        # the marks are few bytes, the work is in reading the blocks
        return both.repartitionById(max(1, min(self.span, MOST)), "block").groupBy("block").applyInArrow(_or_empty(run, empty), schema)

    def take(self, stay: DataFrame) -> DataFrame:
        """The rows of the table, whole, whose places stay(block, row) has."""
        read = self.reader(self.schema.names)

        def run(block: Place, given: pa.Table):
            rows = np.array(sorted(r for some in given.column("rows").to_pylist() for r in some), np.int64)
            at = 0
            for batch in read(block):
                own = rows[np.searchsorted(rows, at) : np.searchsorted(rows, at + batch.num_rows)] - at
                at += batch.num_rows
                yield batch.take(pa.array(own))

        return self.map_with(stay.groupBy("block").agg(F.collect_list("row").alias("rows")), run, self.schema.simpleString()[7:-1])


def _or_empty(run, empty):
    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        return empty if out is None else out.cast(empty.schema)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit multiply-and-shift hash (public domain constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(h: np.ndarray, n: int, factor: int) -> np.ndarray:
    """Hash of each n consecutive values, by doubling; before mixing. Windows run over the ends of texts: callers keep those inside."""
    if len(h) < n:
        return h[:0]
    power, done, width, total = h, None, 1, 0
    scale = np.uint64(factor)
    with np.errstate(over="ignore"):
        while True:
            if n & width:
                if done is None:
                    done, total = power, width
                else:
                    m = len(h) - total - width + 1
                    done = power[:m] * np.uint64(pow(int(factor), total, 1 << 64)) + done[width : width + m]
                    total += width
            if total == n:
                return done
            m = len(power) - width
            power = power[:m] * scale + power[width : width + m]
            scale = scale * scale
            width *= 2


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes and their n + 1 bounds; a null has none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


class WordHashes:
    """64-bit hashes of the words of a column of texts, computed over its bytes at once.

    A word's hash is the sum of a random number for each byte times a power of an odd base, modulo 2**64, taken as a
    difference of running sums and brought to the word's start by the inverse power; then mixed with the word's length.
    The numbers of unlike bytes differ in their lowest eight bits, so no exchange of bytes goes unseen. Hashes of
    different seeds are independent. Words are what [^\x20\x09-\x0D]+ finds, or runs of the bytes that `space` (256
    flags) doesn't mark; fold: A-Z count as a-z.
    """

    PIECE = 1 << 16

    def __init__(self, seed: int = 1, fold: bool = False, space: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 56, 256, np.uint64) << np.uint64(8) | np.arange(256, dtype=np.uint64)
        if fold:
            self.table[65:91] = self.table[97:123]
        self.space = np.zeros(256, bool) if space is None else space
        if space is None:
            self.space[[32, *range(9, 14)]] = True
        self.base = int(rng.integers(0, 1 << 61)) << 3 | 5
        self.power = self.inverse = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.power):
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.full(n, self.base, np.uint64))
                self.inverse = np.cumprod(np.full(n, pow(self.base, -1, 1 << 64), np.uint64))

    def _cut(self, raw: np.ndarray, ends: np.ndarray, z: int) -> int:
        """The first place from z on where no word runs over."""
        edge = int(ends[np.searchsorted(ends, z)]) if z < len(raw) else len(raw)
        while z < edge:
            found = np.flatnonzero(self.space[raw[z : min(edge, z + 4096)]])
            if len(found):
                return z + int(found[0])
            z += 4096
        return edge

    def __call__(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes, flat, and the n + 1 bounds of texts in them."""
        raw, ends = column_bytes(column)
        hashes, starts, a = [], [], 0
        edge = np.zeros(len(raw) + 1, bool)
        edge[ends] = True
        while a < len(raw):
            z = self._cut(raw, ends, a + self.PIECE)
            c = raw[a:z]
            blank = self.space.take(c)
            lead, trail = edge[a:z].copy(), edge[a + 1 : z + 1].copy()
            lead[0] = trail[-1] = True
            lead[1:] |= blank[:-1]
            trail[:-1] |= blank[1:]
            begin, stop = np.flatnonzero(lead & ~blank), np.flatnonzero(trail & ~blank) + 1
            self._powers(len(c))
            with np.errstate(over="ignore"):
                total = np.zeros(len(c) + 1, np.uint64)
                np.cumsum(self.table.take(c) * self.power[: len(c)], out=total[1:])
                h = (total[stop] - total[begin]) * self.inverse[begin]
                hashes.append(mix(h + (stop - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            starts.append(begin + a)
            a = z
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
        return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), ends).astype(np.int64)


def parts_of(bytes_: int, spark: SparkSession, part_mb: int) -> int:
    """Into how many ranges hashes are dealt: by the data's size, and no fewer than the session's shuffle partitions."""
    return int(min(1 << 18, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // (part_mb << 20)))))


def slices(sorted_hashes: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of each range of the upper 32 bits in an ascending array: parts + 1 positions."""
    edges = (np.arange(1, parts, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts) << np.uint64(32)
    return np.concatenate(([0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]))

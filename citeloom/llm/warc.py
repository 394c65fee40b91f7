"""WARC archives with a two-level capture index.

Archive. Pages lie in blocks in the shared folder. Their payloads' digests are taken where they lie, and which page
revisits which is told from ids and digests alone, so no payload is ever shuffled. A task for each block then writes
files of gzip members, one for each record after a warcinfo, into a folder that all machines share; names are new for
each attempt, and only files that the table of captures names count, so a repeated task leaves nothing that is read. Of
equal payloads of at least LEAST bytes the largest page_id is a response, the others revisit it without payload. Record
ids are unique (of the page and its place); the fields Page-ID and Refers-To-Page-ID, which the format's rule for
extensions allows, carry ids of pages.

Index. Captures are keyed by reversed host, path and query, then page_id, and sorted over range partitions, as many as
the captures need. Each partition writes one index file of gzip blocks of LINES lines, and beside it a sparse directory with the first key,
place and length of each block. Above these the driver holds one key for each index file. To look keys up, they are
dealt to index files by binary search of those; a task then binary-searches the file's directory, reads one block by
its range, and binary-searches its lines. Records are read by range too, sorted by file and offset, in tasks of like
numbers of bytes.

Defined results: null html is an empty payload; a payload of any length is one record; null url stands as an empty one; a null page_id never wins against
another, and if all of a group are null each is a response. Repeated rows are repeated captures: all rows with the
winning page_id are responses. Other input columns are dropped; an empty table gives an empty archive and result.
"""

from __future__ import annotations

import bisect
import re
import uuid
import zlib
from hashlib import sha1

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST, Blocks, join_hot, open_fs, scratch, written

#: Smaller payloads are always responses; lines in an index block; bytes after which an archive file is closed.
LEAST, LINES, ROLL = 1000, 1000, 256 << 20
#: Equal payloads from which a group counts as hot, at least.
HOT = 1000
DATE = "2020-01-01T00:00:00Z"
_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)")
CAPTURES = "key string, file string, start long, length long"


def url_key(url: str | None, page_id: int | None) -> str:
    """Host labels from last to first, ')', path and query; then the page_id, so that keys of a page sort as numbers."""
    url = _printable(url)
    m = _URL.match(url)
    host, rest = (m[1], m[2]) if m else ("", url.partition("#")[0])
    host = host.rpartition("@")[2].lower()
    labels = ",".join(reversed(host.split("."))) if host else ""
    return f"{labels}){rest or '/'} {'-' if page_id is None else format(page_id + (1 << 63), '020d')}"


def _printable(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url or "")


def record_id(page_id: int | None, block: int, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{block}/{row}')}>"


def _member(lines: list[str], block: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def warcinfo(name: str) -> bytes:
    return _member(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def record(page_id, url, payload: bytes, digest: str, own: str, to: tuple[int, str] | None = None) -> bytes:
    """One gzip member. own: its record id; to: page_id and record id of the response that it revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [f"WARC-Type: {'response' if to is None else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Target-URI: {_printable(url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Page-ID: {'null' if page_id is None else page_id}"]
    if to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {to[1]}", f"Refers-To-Page-ID: {to[0]}"]
    return _member(lines, http if to is not None else http + payload)


def fields(member: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and block of a record."""
    raw = zlib.decompress(member, 31)
    head, _, block = raw.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    return named, block[: int(named["Content-Length"])]


def parse(member: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of one gzip member; a response's payload is checked."""
    named, block = fields(member)
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page = None if named["Page-ID"] == "null" else int(named["Page-ID"])
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    if named["WARC-Type"] == "revisit":
        return page, length, digest, "revisit", int(named["Refers-To-Page-ID"]), None
    if len(payload) != length or sha1(payload).hexdigest() != digest:
        raise ValueError(f"damaged record of page {named['Page-ID']}")
    return page, length, digest, "response", None, payload


def write_archive(pages: DataFrame, least: int = LEAST, block_mb: int = 64) -> DataFrame:
    """pages(page_id, url, html) -> the table of captures (key, file, start, length) of the archive written."""
    spark = pages.sparkSession
    blocks = Blocks(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), "pages", block_mb)
    read_some, read_all = blocks.reader(["page_id", "html"]), blocks.reader(["page_id", "url", "html"])

    def digests(block: int):
        at = 0
        for batch in read_some(block, 64):
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            own = [(at + i, sha1(r).digest()) for i, r in enumerate(raw) if len(r) >= least]
            ids = batch.column(0).take(pa.array([i - at for i, _ in own], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(own), pa.int32()), pa.array([i for i, _ in own], pa.int32()), ids, pa.array([d for _, d in own], pa.binary())], ["block", "row", "page_id", "digest"])
            at += batch.num_rows

    large = written(blocks.map(digests, "block int, row int, page_id long, digest binary"), "payload-digests")
    place = F.max(F.struct("page_id", (-F.col("block")).alias("b"), (-F.col("row")).alias("r"))).alias("to")
    groups = large.groupBy(F.col("digest").alias("_d")).agg(place, F.count("*").alias("_n")).where("_n > 1 AND to.page_id IS NOT NULL")
    groups = written(groups, "payload-groups")
    revisits = join_hot(large, "digest", groups, "_d", "_n", HOT).where(F.col("to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("to.page_id")))
    marks = revisits.select("block", "row", F.col("to.page_id").alias("page"), (-F.col("to.b")).alias("b"), (-F.col("to.r")).alias("r"))
    folder = scratch(spark, "warc")

    def write(block: int, given: pa.Table):
        to = {row: (page, record_id(page, b, r)) for row, page, b, r in zip(*(given.column(c).to_pylist() for c in ("row", "page", "b", "r")))}
        system, path = open_fs(folder)
        system.create_dir(path, recursive=True)
        out, name, start, at = None, None, 0, 0
        try:
            for batch in read_all(block, 64):
                told = []
                for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                        head = warcinfo(name)
                        out.write(head)
                        start = len(head)
                    payload = (html or "").encode()
                    member = record(page_id, url, payload, sha1(payload).hexdigest(), record_id(page_id, block, at), to.get(at))
                    out.write(member)
                    told.append((url_key(url, page_id), f"{folder}/{name}", start, len(member)))
                    start, at = start + len(member), at + 1
                    if start >= ROLL:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*told)) if told else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "file", "start", "length"])
        finally:
            if out is not None:
                out.close()

    return written(blocks.map_with(marks, write, CAPTURES), "captures")


def parts_for(captures: DataFrame, rows: int, bytes_: int, least: int) -> int:
    """Range partitions for captures: `rows` of them and `bytes_` of records each at most, on average; for small tables as many as there are cores, of `least` rows or more."""
    n, size = captures.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return max(1, -(-n // rows), -(-size // bytes_), min(captures.sparkSession.sparkContext.defaultParallelism, n // least))


class Index:
    """Index files (first key and URI, one for each) and how to look keys up in them."""

    def __init__(self, spark: SparkSession, files: list[tuple[str, str]]):
        self.spark, self.firsts, self.files = spark, [f[0] for f in files], [f[1] for f in files]

    @staticmethod
    def build(captures: DataFrame, lines: int = LINES) -> Index:
        spark = captures.sparkSession
        folder = scratch(spark, "index")
        parts = parts_for(captures, 64 * lines, 1 << 62, lines)
        rows = captures.repartitionByRange(parts, "key", "file", "start").sortWithinPartitions("key", "file", "start")

        def write(batches):
            system, path = open_fs(folder)
            held: list[str] = []
            directory: list[tuple[str, int, int]] = []
            out = None
            name = f"part-{uuid.uuid4().hex}.idx.gz"
            at = 0

            def flush(some: list[str]) -> None:
                nonlocal out, at
                if out is None:
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                block = packer.compress("\n".join(some).encode()) + packer.flush()
                out.write(block)
                directory.append((some[0].split("\t")[0], at, len(block)))
                at += len(block)

            for batch in batches:
                held += [f"{k}\t{f}\t{s}\t{n}" for k, f, s, n in zip(*(batch.column(i).to_pylist() for i in range(4)))]
                while len(held) >= lines:
                    flush(held[:lines])
                    held = held[lines:]
            if held:
                flush(held)
            if out is None:
                return
            out.close()
            firsts, starts, sizes = zip(*directory)
            with system.open_output_stream(f"{path}/{name}.dir", compression=None) as f, pa.ipc.new_stream(f, pa.schema([("first", pa.string()), ("start", pa.int64()), ("length", pa.int64())])) as w:
                w.write(pa.record_batch([pa.array(firsts, pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], ["first", "start", "length"]))
            yield pa.RecordBatch.from_pydict({"first": pa.array([firsts[0]]), "uri": pa.array([f"{folder}/{name}"])})

        files = written(rows.mapInArrow(write, "first string, uri string"), "index-files")
        return Index(spark, sorted((r.first, r.uri) for r in files.collect()))  # one row for each index file

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """wanted(key) -> key, file, start, length of every capture with one of these keys."""
        top = self.spark.sparkContext.broadcast((self.firsts, self.files))
        firsts = self.firsts

        def deal(batches):
            firsts = top.value[0]
            for b in batches:
                keys = b.column(0).to_pylist()
                # a key equal to a file's first may end the file before it as well
                spans = [(max(0, bisect.bisect_left(firsts, k) - 1), bisect.bisect_right(firsts, k)) for k in keys]
                yield pa.RecordBatch.from_pydict({"part": pa.array([p for a, z in spans for p in range(a, z)], pa.int32()), "key": pa.array([k for k, (a, z) in zip(keys, spans) for _ in range(a, z)], pa.string())})

        def find(table: pa.Table) -> pa.Table:
            uri = top.value[1][table.column("part")[0].as_py()]
            system, path = open_fs(uri)
            with system.open_input_stream(f"{path}.dir", compression=None) as f:
                directory = pa.ipc.open_stream(f).read_all().to_pydict()
            out: list[list[str]] = []
            last, lines, keys = -1, [], []
            with system.open_input_file(path) as f:
                for key in sorted(table.column("key").to_pylist()):
                    block = max(0, bisect.bisect_left(directory["first"], key) - 1)
                    while block < len(directory["first"]) and directory["first"][block] <= key:
                        if block != last:
                            f.seek(directory["start"][block])
                            lines = zlib.decompress(f.read(directory["length"][block]), 31).decode().split("\n")
                            last, keys = block, [x.partition("\t")[0] for x in lines]
                        out += [x.split("\t") for x in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
                        block += 1
            cols = list(zip(*out)) or [()] * 4
            return pa.table({"key": pa.array(cols[0], pa.string()), "file": pa.array(cols[1], pa.string()), "start": pa.array([int(x) for x in cols[2]], pa.int64()), "length": pa.array([int(x) for x in cols[3]], pa.int64())})

        if not firsts:
            return self.spark.createDataFrame([], CAPTURES)
        dealt = wanted.select(F.col("key").cast("string")).where("key IS NOT NULL").distinct().mapInArrow(deal, "part int, key string")
        # a partition for each index file, since keys are few bytes but the blocks read for them aren't
        return dealt.repartitionById(min(len(firsts), MOST), "part").groupBy("part").applyInArrow(find, CAPTURES)


def keys(pages: DataFrame) -> DataFrame:
    """The index key of each row of pages(page_id, url)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array([url_key(u, p) for p, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.string())})

    return pages.select(F.col("page_id").cast("long"), "url").mapInArrow(run, "key string")


def read_records(captures: DataFrame, payload: bool = True) -> DataFrame:
    """The records that captures point to: page_id, payload_bytes, payload_digest, record_type, refers_to and, if wanted, payload (null for revisits)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 5 + payload]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        name, f = None, None
        for b in batches:
            rows = []
            for file, start, length in zip(*(b.column(c).to_pylist() for c in ("file", "start", "length"))):
                if file != name:
                    system, path = open_fs(file)
                    name, f = file, system.open_input_file(path)
                f.seek(start)
                rows.append(parse(f.read(length)))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[: len(names)], kinds)], names)

    rows = written(captures.select("file", "start", "length"), "pointers")
    rows = rows.repartitionByRange(parts_for(rows, 1 << 17, 64 << 20, 64), "file", "start").sortWithinPartitions("file", "start")
    return rows.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload)


ORACLE = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, octet_length(b) AS payload_bytes, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM g
"""

"""Substring dedup with difference-cover anchors.

Words of a text are hashed, and windows of ANCHOR words only at positions that are, modulo PERIOD, in COVER. Any two
positions have a shift below PERIOD that brings both onto the cover, so two equal windows of ANCHOR + PERIOD - 1 = 20
words share an aligned anchor. Anchors seen once in all texts are dropped; around each of the others the windows of 20
words that hold it are candidates (the match extended to its full length), and only those are hashed in full: 64 bits
made of one hash of each word, and 32 of an independent one. Of each the earliest (doc_id, start) is found, and a candidate that starts later loses its words.

Texts lie in blocks of bounded size in the shared folder; three passes read them. Between passes no text moves: a block
sends its distinct hashes, sorted and cut into ranges (32 bits an anchor), one row for each range; a range answers with
one bit for each hash. A passage that a third of all texts share is one hash of each block. There are never more rows
sent than distinct hashes, and ranges are dealt to as many partitions as there are. That 32 bits are compared first
can only make more candidates; two unlike windows count as equal with a chance of about 2**-96 a pair.

Defined results: a null text has no words; texts of fewer than 20 words lose none. A null doc_id comes after all others
and rows with it count as one document. In rows that share a doc_id equal windows of equal start are neither before the
other, so none is removed for the other's sake. Repeated rows: likewise. Empty tables give empty results. Other input
columns are dropped, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST, Blocks, WordHashes, mix, parts_of, slices, windows, written

#: A difference cover: differences of its members give every number modulo PERIOD.
PERIOD, COVER, ANCHOR = 13, (0, 1, 3, 9), 8
WINDOW = ANCHOR + PERIOD - 1
P1, P2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
LAST = np.iinfo(np.int64).max
_ON = np.zeros(PERIOD, bool)
_ON[list(COVER)] = True


class Texts:
    """The word hashes of a block: flat, with the bounds of each row and its doc_id. twice: also those of an independent function, in more."""

    def __init__(self, read, block: int, twice: bool = False):
        kinds = [WordHashes(1), WordHashes(2)][: 1 + twice]
        ids, ends, flat, at = [], [np.zeros(1, np.int64)], [[] for _ in kinds], 0
        for batch in read(block):
            ids.append(pc.fill_null(batch.column(0), LAST).to_numpy(zero_copy_only=False).astype(np.int64))
            for out, hashes in zip(flat, kinds):
                h, bounds = hashes(batch.column(1))
                out.append(h)
            ends.append(bounds[1:] + at)
            at += int(bounds[-1])
        joined = [np.concatenate(f) if f else np.zeros(0, np.uint64) for f in flat]
        self.words, self.more = joined[0], joined[-1]
        self.ids, ends = np.concatenate(ids) if ids else np.zeros(0, np.int64), np.concatenate(ends)
        self.begin, self.end = ends[:-1], ends[1:]
        self.row = np.repeat(np.arange(len(self.ids)), np.diff(ends))
        self.place = np.arange(len(self.words)) - self.begin[self.row]
        self.left = self.end[self.row] - np.arange(len(self.words))  # words from here to the row's end

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors of rows that have a window."""
        long = (self.end - self.begin >= WINDOW)[self.row]
        at = np.flatnonzero(_ON[self.place % PERIOD] & (self.left >= ANCHOR) & long)
        return at, mix(windows(self.words, ANCHOR, P1)[at]) if len(at) else np.zeros(0, np.uint64)

    def candidates(self, repeated_at: np.ndarray) -> np.ndarray:
        """Starts of the windows around anchors at these positions."""
        mark = np.zeros(len(self.words) + PERIOD + 1, np.int32)
        mark[repeated_at] = 1
        total = np.concatenate(([0], np.cumsum(mark)))
        n = len(self.words)
        inside = total[PERIOD : PERIOD + n] - total[:n] > 0
        return np.flatnonzero(inside & (self.left >= WINDOW))


def _unique(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and which of them occur more than once."""
    own, counts = np.unique(h, return_counts=True)
    return own, counts > 1


def _bits(table: pa.Table, n: int) -> np.ndarray:
    """Answers of all ranges (start, count, bits) as flags of a block's n distinct hashes."""
    out = np.zeros(n, bool)
    for start, count, bits in zip(*(table.column(c).to_pylist() for c in ("start", "count", "bits"))):
        out[start : start + count] = np.unpackbits(np.frombuffer(bits, np.uint8), count=count).astype(bool)
    return out


def send(block: int, keys: np.ndarray, parts: int, columns: list[np.ndarray]):
    """Rows (part, block, start, count, data) with the slices of columns that stand beside ascending keys."""
    at = slices(keys, parts)
    full = np.flatnonzero(np.diff(at))
    data = [b"".join(c[at[p] : at[p + 1]].tobytes() for c in columns) for p in full]
    yield pa.RecordBatch.from_pydict({"part": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), block), pa.int32()), "start": pa.array(at[full], pa.int64()), "count": pa.array(np.diff(at)[full], pa.int32()), "data": pa.array(data, pa.binary())})


SENT = "part int, block int, start long, count int, data binary"
ANSWER = "block int, start long, count int, bits binary"


def answer(table: pa.Table, flagged: np.ndarray) -> pa.Table:
    """Cuts flags of all rows' hashes, one after the other, into answers; blocks with none flagged get none."""
    blocks, starts, counts, bits = [], [], [], []
    at = 0
    for block, start, count in zip(*(table.column(c).to_pylist() for c in ("block", "start", "count"))):
        own = flagged[at : at + count]
        at += count
        if own.any():
            blocks.append(block)
            starts.append(start)
            counts.append(count)
            bits.append(np.packbits(own).tobytes())
    return pa.table({"block": pa.array(blocks, pa.int32()), "start": pa.array(starts, pa.int64()), "count": pa.array(counts, pa.int32()), "bits": pa.array(bits, pa.binary())})


def _in_several(table: pa.Table) -> pa.Table:
    h = np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint32)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    flagged = np.zeros(len(h), bool)
    flagged[order[1:][same]] = True
    flagged[order[:-1][same]] = True
    return answer(table, flagged)


#: What a block says of a distinct window: two hashes and the earliest place.
PARTS = (np.dtype(np.uint64), np.dtype(np.uint32), np.dtype(np.int64), np.dtype(np.int32))


def _later(table: pa.Table) -> pa.Table:
    """Flags windows of which another block has an earlier place."""
    cols = [[] for _ in PARTS]
    for data, count in zip(table.column("data").to_pylist(), table.column("count").to_pylist()):
        at = 0
        for c, kind in zip(cols, PARTS):
            c.append(np.frombuffer(data, kind, count, at))
            at += count * kind.itemsize
    a, b, key, start = map(np.concatenate, cols)
    order = np.lexsort((start, key, b, a))
    a, b, key, start = a[order], b[order], key[order], start[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    flagged = np.zeros(len(a), bool)
    flagged[order] = (key != key[first]) | (start != start[first])
    return answer(table, flagged)


class _Pass:
    """What the second and third pass share: the windows of a block that may be repeated, grouped."""

    def __init__(self, read, block: int, first: pa.Table):
        self.texts = t = Texts(read, block, twice=True)
        at, h = t.anchors()
        own, several = _unique(h)
        repeated = several | _bits(first, len(own))
        starts = t.candidates(at[repeated[np.searchsorted(own, h)]]) if len(own) else np.zeros(0, np.int64)
        a = mix(windows(t.words, WINDOW, P1)[starts]) if len(starts) else np.zeros(0, np.uint64)
        b = (mix(windows(t.more, WINDOW, P2)[starts]) >> np.uint64(32)).astype(np.uint32) if len(starts) else np.zeros(0, np.uint32)
        key, place = t.ids[t.row[starts]], t.place[starts].astype(np.int32)
        order = np.lexsort((place, key, b, a))
        self.starts, self.a, self.b, self.key, self.place = starts[order], a[order], b[order], key[order], place[order]
        new = np.concatenate(([True], (self.a[1:] != self.a[:-1]) | (self.b[1:] != self.b[:-1])))[: len(starts)]
        self.first = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1


def marks(df: DataFrame, text: str = "text", key: str = "doc_id", block_mb: int = 16, part_mb: int = 24):
    """The blocks, and for each pass what their hashes were answered."""
    blocks = Blocks(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "substring", block_mb)
    parts = parts_of(blocks.bytes, df.sparkSession, part_mb)
    read = blocks.reader(["doc_id", "text"])

    def anchors(block: int):
        own, _ = _unique(Texts(read, block).anchors()[1])
        yield from send(block, own, parts, [own.astype(np.uint32)])

    def windows_of(block: int, given: pa.Table):
        w = _Pass(read, block, given)
        f = w.first
        yield from send(block, w.a[f], parts, [w.a[f], w.b[f], w.key[f], w.place[f]])

    first = blocks.map(anchors, SENT).repartitionById(min(parts, MOST), "part").groupBy("part").applyInArrow(_in_several, ANSWER)
    first = written(first, "substring-anchors")
    second = blocks.map_with(first, windows_of, SENT).repartitionById(min(parts, MOST), "part").groupBy("part").applyInArrow(_later, ANSWER)
    return blocks, first.withColumn("second", F.lit(False)).unionByName(second.withColumn("second", F.lit(True)))


def remove(df: DataFrame, text: str = "text", key: str = "doc_id", texts: bool = True, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if wanted, kept: the words that stay, joined by single spaces."""
    blocks, told = marks(df, text, key, **how)
    read = blocks.reader(["doc_id", "text"])

    def cut(block: int, given: pa.Table):
        second = np.array(given.column("second").to_pylist(), bool)
        w = _Pass(read, block, given.filter(pa.array(~second)))
        later = _bits(given.filter(pa.array(second)), len(w.first))
        t = w.texts
        early = (w.key == w.key[w.first][w.group]) & (w.place == w.place[w.first][w.group]) if len(w.group) else np.zeros(0, bool)
        gone = w.starts[later[w.group] | ~early] if len(w.group) else w.starts
        change = np.bincount(gone, minlength=len(t.words) + WINDOW + 1).astype(np.int64)
        change[WINDOW:] -= np.bincount(gone, minlength=len(t.words) + WINDOW + 1)[: len(change) - WINDOW]
        stays = np.cumsum(change)[: len(t.words)] <= 0
        total = np.concatenate(([0], np.cumsum(~stays)))
        removed = total[t.end] - total[t.begin]
        row = 0
        for batch in read(block):
            kept, digest, n, out = [], [], [], []
            ids = batch.column(0)
            for x in batch.column(1).to_pylist():
                a, z = t.begin[row], t.end[row]
                words = x.encode().split() if x else []
                if removed[row]:
                    words = [words[i] for i in np.flatnonzero(stays[a:z]).tolist()]
                joined = b" ".join(words)
                digest.append(sha256(joined).hexdigest())
                n.append(int(z - a))
                out.append(int(removed[row]))
                if texts:
                    kept.append(joined.decode())
                row += 1
            cols = {"doc_id": ids, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(out, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            yield pa.RecordBatch.from_pydict(cols | ({"kept": pa.array(kept, pa.string())} if texts else {}))

    return blocks.map_with(told, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM w WHERE len(w) >= 20),
h AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM p),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM h),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM f WHERE k > 1),
r AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM g GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN r.n IS NULL THEN w.w ELSE list_filter(w.w, lambda x, i: NOT list_contains(r.gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r ON w.doc_id = r.doc_id
"""

r"""Ranked lexical search by windowed bucket scoring.

Index. Texts are read once, where they lie, into segments of SEGMENT bytes or MOST_DOCS documents. A segment numbers
its documents by ascending id and holds, for each of its terms, the numbers of the documents with it and how often
each has it, beside ids and lengths. It is one row of a table in the shared folder; no text is shuffled. Every term of every document is in the
index, so one index serves any number of searches.

Search. A query is the set of its terms. Of the index, tasks first count how many documents hold each query term (the
only thing aggregated over all segments, with the totals of documents and terms). Then each block of segments meets the
queries, some thousand at a time. A segment's postings are traversed in windows of WINDOW document numbers: a query's
terms, one after the other, add what they are worth to an array of that many 64-bit sums, which stays in the cache, and
or their bits into a bitset of the window; the sums whose bit is set are harvested into the query's heap of the k best,
if they beat its worst. Heaps of blocks are merged by a window over (query, score), which Spark limits to k rows before
it shuffles. The work is the length of the query terms' postings, in blocks of queries; nothing grows with a term's or query's popularity but that.

Score, as the contract has it, in 64-bit integers: terms are what TERM finds with A-Z lower-cased; N documents hold one,
L is the sum of their lengths n in terms, df documents hold the term, w = floor(1000 ln((2N + 2) / (2 df + 1))),
m = 10 + 90 n N div L, and a term that stands tf times in a document adds w * (10**9 tf div (1000 tf + 8 m)).

Terms are compared by 64-bit hashes. Defined results: a null or empty text has no terms; it is no document here and, as a
query, finds nothing. Rows that share an item_id (null too) are one query with the terms of all of them. Each row of
the documents counts as one, repeated ones too, and may be found; ties go by ascending doc_id, nulls last, and repeated rows of one id take ranks
beside each other. Scores that aren't above 0 aren't found. Empty tables give empty results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Blocks, Place, WordHashes, column_bytes, written

#: Terms: maximal runs of ASCII letters and digits and of everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEGMENT, MOST_DOCS, WINDOW = 16 << 20, 1 << 16, 4096
#: Queries whose heaps a task holds at once.
QUERIES = 4096
LAST = np.iinfo(np.int64).max
SEGMENTS = "docs long, words long, ids binary, nulls long, lengths binary, terms binary, holders binary, numbers binary, times binary"


def term_hashes() -> WordHashes:
    space = np.ones(256, bool)
    space[128:] = False
    for a, z in ((48, 58), (65, 91), (97, 123)):
        space[a:z] = False
    return WordHashes(3, fold=True, space=space)


def small(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs."""
    top = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)).tobytes()


def large(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(data) // n if n else 1])


class Segment:
    """What texts of some documents become: their ids, lengths and postings."""

    def __init__(self):
        self.ids, self.lengths, self.flat, self.bytes, self.count = [], [], [], 0, 0

    def add(self, ids: np.ndarray, h: np.ndarray, bounds: np.ndarray, bytes_: int) -> None:
        n = np.diff(bounds)
        self.ids.append(ids[n > 0])
        self.lengths.append(n[n > 0])
        self.flat.append(h)
        self.bytes += bytes_
        self.count += int((n > 0).sum())

    def row(self) -> pa.RecordBatch:
        ids, lengths, h = (np.concatenate(x) for x in (self.ids, self.lengths, self.flat))
        order = np.argsort(ids, kind="stable")
        number = np.empty(len(ids), np.int64)
        number[order] = np.arange(len(ids))
        number = np.repeat(number, lengths)
        by_term = np.argsort(h)
        h = h[by_term]
        new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        pairs = np.sort((np.cumsum(new) - 1) * MOST_DOCS + number[by_term])
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate((first, [len(pairs)])))
        holders = np.bincount(pairs[first] // MOST_DOCS, minlength=int(new.sum()))
        ids = ids[order]
        values = [len(ids), len(h), ids.tobytes(), int((ids == LAST).sum()), small(lengths[order]), h[new].tobytes(), small(holders), small(pairs[first] % MOST_DOCS), small(times)]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in SEGMENTS.split(", ")])


class Postings:
    """A segment as it is read for a search."""

    def __init__(self, row: dict, documents: int, terms: int):
        self.count = row["docs"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.nulls = row["nulls"]  # the last ones
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.begin = np.concatenate(([0], np.cumsum(large(row["holders"], len(self.terms)).astype(np.int64))))
        n = int(self.begin[-1])
        self.numbers = large(row["numbers"], n).astype(np.int32)
        tf = large(row["times"], n).astype(np.int64)
        m = norm(large(row["lengths"], self.count).astype(np.int64), documents, terms)
        self.worth = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.numbers])

    def of(self, terms: np.ndarray) -> np.ndarray:
        """Places of the terms, -1 where the segment has none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)


def norm(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents of n terms; where 90 n N wouldn't fit 64 bits, by larger integers."""
    if len(n) and 90 * int(n.max()) * documents >= 1 << 63:
        return np.array([10 + 90 * int(x) * documents // terms for x in n], np.int64)
    return 10 + 90 * n * documents // max(1, terms)


class Heap:
    """The k best (score, smaller id first) that a query has met. Entries: (score, -id or less for null, id)."""

    __slots__ = ("k", "best")

    def __init__(self, k: int):
        self.k, self.best = k, []

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores above 0 of ascending ids (LAST: null)."""
        if len(self.best) == self.k:
            beat = scores >= self.best[0][0]
            scores, ids = scores[beat], ids[beat]
        if len(scores) > self.k:
            beat = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[beat], ids[beat]
            # of equal scores the first ones do; k above the least and k of it at most
            least = np.flatnonzero(scores == scores.min())[self.k :]
            scores, ids = np.delete(scores, least), np.delete(ids, least)
        for s, i in zip(scores.tolist(), ids.tolist()):
            if len(self.best) < self.k:
                heappush(self.best, (s, -i))
            elif (s, -i) > self.best[0]:
                heapreplace(self.best, (s, -i))


def traverse(postings: Postings, queries: list[tuple[np.ndarray, np.ndarray]], heaps: list[Heap]) -> None:
    """queries: (places of terms that the segment has, their weights). Scores the segment's documents, window by window, into the heaps."""
    sums = np.zeros(WINDOW, np.int64)
    used = np.unique(np.concatenate([q[0] for q in queries])) if queries else []
    for start in range(0, postings.count, WINDOW):
        slices = {}
        for t in used.tolist() if len(used) else ():
            a, z = postings.begin[t], postings.begin[t + 1]
            if postings.count > WINDOW:
                a, z = a + np.searchsorted(postings.numbers[a:z], (start, start + WINDOW))
            if z > a:
                at = postings.numbers[a:z] - start
                bits = np.zeros(WINDOW, bool)
                bits[at] = True
                slices[t] = at, postings.worth[a:z], np.packbits(bits)
        for (terms, weights), heap in zip(queries, heaps):
            occupied = np.zeros(WINDOW // 8, np.uint8)
            for t, w in zip(terms.tolist(), weights.tolist()):
                if t in slices and w:
                    at, worth, bits = slices[t]
                    sums[at] += w * worth  # a document stands once in a term's postings
                    occupied |= bits
            found = np.flatnonzero(np.unpackbits(occupied))
            if len(found):
                scores = sums[found]
                sums[found] = 0
                above = scores > 0
                heap.offer(scores[above], postings.ids[found[above] + start])


class Index:
    """Segments of a table of documents, to be searched any number of times."""

    def __init__(self, df: DataFrame, text: str = "text", key: str = "doc_id", segment: int = SEGMENT, block_mb: int = 16):
        def build(batches):
            hashes, held = term_hashes(), Segment()
            for b in batches:
                a = 0
                while a < b.num_rows:
                    some = b.slice(a, 64)
                    a += 64
                    ids = pc.fill_null(some.column(0), LAST).to_numpy(zero_copy_only=False)
                    h, bounds = hashes(some.column(1))
                    held.add(ids, h, bounds, len(column_bytes(some.column(1))[0]))
                    if held.bytes >= segment or held.count > MOST_DOCS - 64:
                        yield held.row()
                        held = Segment()
            if held.count:
                yield held.row()

        rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
        self.spark = df.sparkSession
        self.blocks = Blocks(rows.mapInArrow(build, SEGMENTS), "lexical", block_mb)
        self.documents, self.terms = self.blocks.frame().agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()

    def holders(self, terms: DataFrame) -> DataFrame:
        """terms(term), distinct -> term, df: how many documents of the index hold it; those that none holds aren't told."""
        vocabulary = Blocks(terms.select("term").repartition(1 + terms.count() // 1_000_000), "vocabulary", 16)
        each, read_terms = vocabulary.places_in_tasks(), vocabulary.reader(["term"])
        read = self.blocks.reader(["terms", "holders"])

        def run(place: Place):
            for part in each(0, 1):
                wanted = np.unique(np.concatenate([b.column(0).to_numpy() for b in read_terms(part, 1 << 16)]).view(np.uint64))
                total = np.zeros(len(wanted), np.int64)
                for b in read(place):
                    for own, holders in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                        own = np.frombuffer(own, np.uint64)
                        at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                        total += np.where(own[at] == wanted, large(holders, len(own))[at], 0).astype(np.int64)
                some = total > 0
                yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(total[some])], ["term", "df"])

        return self.blocks.map(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))

    def search(self, queries: DataFrame, k: int = 10, text: str = "text", key: str = "item_id") -> DataFrame:
        """item_id, rank (from 1), doc_id and score of the k best documents of each query."""
        asked = written(queries.select(F.col(key).alias("item_id"), F.col(text).alias("text")).mapInArrow(terms_of, queries.select(F.col(key).alias("item_id")).schema.add("term", "long")).distinct(), "query-terms")
        known = self.holders(asked.select("term").distinct())
        weight = F.floor(1000 * F.log((2.0 * self.documents + 2) / (2 * F.col("df") + 1))).cast("long")
        weighed = asked.join(known.select(F.col("term").alias("t"), weight.alias("w")), F.col("term") == F.col("t"))
        items = weighed.groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("own"))  # the terms of one query
        items = items.select("item_id", F.col("own.term").alias("terms"), F.col("own.w").alias("weights"))
        items = Blocks(items.repartition(1 + asked.count() // 1_000_000), "queries", 16)
        each, read_items = items.places_in_tasks(), items.reader(["item_id", "terms", "weights"])
        read = self.blocks.reader([c.split()[0] for c in SEGMENTS.split(", ")])
        documents, terms = self.documents, self.terms
        kind = items.schema["item_id"]

        def batches_of_items():
            for place in each(0, 1):
                for b in read_items(place, QUERIES):
                    yield b.column(0), [(np.array(t, np.int64).view(np.uint64), np.array(w, np.int64)) for t, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]

        def run(place: Place):
            for names, asked in batches_of_items():
                heaps = [Heap(k) for _ in asked]
                for b in read(place, 1):
                    for row in b.to_pylist():
                        postings = Postings(row, documents, terms)
                        own = []
                        for t, w in asked:
                            at = postings.of(t)
                            own.append((at[at >= 0], w[at >= 0]))
                        traverse(postings, own, heaps)
                many = [len(h.best) for h in heaps]
                found = [x for h in heaps for x in h.best]
                ids = pa.array([None if i == -LAST else -i for _, i in found], pa.int64())
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(len(many)), many))), ids, pa.array([s for s, _ in found], pa.int64())], ["item_id", "doc_id", "score"])

        found = self.blocks.map(run, f"item_id {kind.dataType.simpleString()}, doc_id long, score long")
        best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def terms_of(batches):
    """(item, text) -> (item, hash of a term) for each occurrence."""
    hashes = term_hashes()
    for b in batches:
        h, bounds = hashes(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(bounds)))), pa.array(h.view(np.int64))], ["item_id", "term"])



ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, len(w)::BIGINT AS n, w FROM t WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * max(c.docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * c.docs) // c.words))))::BIGINT AS score FROM q JOIN f USING (term) JOIN p USING (term), c GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

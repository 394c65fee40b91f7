"""Training-data operators: against brute force on small tables, and on nulls, empty texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from citeloom.llm import ann, bpe, chat, exact, graph, jaccard, langid, mixing, substring, toxicity, warc
from citeloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
have = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, len(t) if t else None) for i, t, l, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [(1, None, None, None), (2, "", "en", "b"), (3, " \t\n\x0b\x0c\r ", "en", "b"), (4, "a b", "en", "a"), (4, "a b", "en", "a"), (None, "ab", "de", None), (None, None, None, None), (5, long, "de", "a"), (6, long, "de", "b"), (7, "é 日本 😀 \x1c x", "fr", "ü"), (8, "A  b", "en", "a")]
    return docs(spark, rows)


def encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@have
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    want = sorted(map(key, con.execute(f"SELECT {', '.join(cols)} FROM ({oracle_sql()[name]})").fetchall()), key=str)
    assert sorted(map(key, df.select(*cols).collect()), key=str) == want


def test_bpe_is_tiktoken(spark, odd):
    e, c = encoding(), bpe.codec(RANKS, P.PATTERN)
    rng = random.Random(1)
    texts = ["", "x" * 3000, "'s'T 're\x85 \x1c\n\n y  ", "​▁Ā <|endoftext|>", *("".join(chr(rng.choice([rng.randrange(9, 127), rng.randrange(160, 800), rng.randrange(0x4E00, 0x4F00), 0x1F600])) for _ in range(60)) for _ in range(200))]
    for t in texts:
        assert c.encode(t) == e.encode_ordinary(t) and c.decode(c.encode(t)) == t.encode()
    got = bpe.decode(bpe.encode(odd.withColumn("ids", F.lit("clash")), RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert len(got) == odd.count()
    for r in got:
        assert list(r.ids) == e.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    again = {(r.doc_id, r.n_chars): r for r in bpe.round_trip(odd.select("doc_id", "n_chars", "text"), RANKS, P.PATTERN).collect()}
    for r in got:
        assert again[r.doc_id, r.n_chars].ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
    whole = bpe.round_trip(odd.withColumn("ids", F.lit("clash")), RANKS, P.PATTERN, keep_ids=True).collect()
    assert sorted((list(r.ids), r.n_tokens) for r in whole) == sorted((list(r.ids), len(r.ids)) for r in got)
    assert bpe.round_trip(odd.limit(0), RANKS, P.PATTERN, keep_ids=True).count() == 0
    assert bpe.encode(odd.limit(0), RANKS, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.serialise({b"a": 0, b"b": 2})


def test_mixing_targets_and_bounds(spark, odd):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([1, 3, 50, 400]), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == 3000 and all(r.taken <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-6 * total
    for v in by.values():
        assert v[0].target <= 2 * v[0].source_size + 1e-9 and abs(sum(r.taken for r in v) - v[0].target) <= 2 * 400 + 0.05 * v[0].target
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(7)).collect()}
    assert mixing.emit(df).count() == sum(r.copies for r in got)
    shared = docs(spark, [(i % 5 or None, "w " * rng.choice([1, 3, 50]), "en", "hot" if i % 3 else "s") for i in range(600)])
    took = mixing.emit(shared).select(F.sum(F.size(F.split("text", " ")) - 1)).first()[0]
    assert abs(took - 1.5 * sum(len(r.text.split()) for r in shared.collect())) <= 4 * 50
    for v in by.values():  # what systematic sampling grants: in each class of sizes the copies are off by less than two
        spread = {}
        for r in v:
            spread[r["size"]] = max(spread.get(r["size"], 0), 2 * r["size"])
        assert abs(sum(r.taken for r in v) - v[0].target) <= sum(spread.values())
    out = mixing.mix(odd.withColumn("size", F.lit("clash")))
    assert out.count() == 11 and out.where("size IS NULL OR target IS NULL OR taken IS NULL").count() == 0
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.emit(odd.limit(0)).count() == 0


def water_filling(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sorted(sizes))}
    left, open_, out = budget * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] <= level * weight[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [[500, 200, 100], [1000] * 6, [100, 200, 100, 500, 20, 10], [50, 400, 200, 500]])
def test_mixing_of_tied_sources(spark, sizes):
    sizes = {f"s{k}": n for k, n in enumerate(sizes)}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(water_filling(sizes)) and sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))
    df = docs(spark, [(i, "w " * 10, "en", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n // 10))])
    assert abs(mixing.emit(df).count() * 10 - 1.5 * sum(sizes.values())) <= 10 * len(sizes)


def test_exact_dedup(spark, odd):
    got = exact.groups(odd.withColumn("kept", F.lit("clash")), digest_all=True).collect()
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    texts = [r.text for r in odd.collect()]
    assert sorted(r.text_sha256 for r in got) == sorted(hashlib.sha256(norm(t).encode()).hexdigest() for t in texts)
    assert sum(r.kept for r in got) == len({norm(t) for t in texts}) == exact.dedup(odd).count()
    empty = [r for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in empty} == {3} and {r.group_size for r in empty} == {4}
    some = exact.groups(odd.withColumn("kept", F.lit("clash"))).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in some) == Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got)
    assert all(r.group_size == 1 for r in some if r.text_sha256 is None) and exact.groups(odd.limit(0)).columns == exact.groups(odd).columns
    assert {r.keep_id for r in got if r.doc_id == 4} == {4} and exact.dedup(odd).columns == odd.columns
    assert exact.groups(odd.limit(0)).count() == 0 and exact.dedup(odd.limit(0)).count() == 0


def brute_substring(rows):
    seen, gone = {}, {}
    at = sorted((i if i is not None else 1 << 62, s, tuple(w[s : s + 20]), k) for k, (i, w) in enumerate(rows) for s in range(len(w) - 19))
    for i, s, win, k in at:
        first = seen.setdefault(win, (i, s))
        if first != (i, s):
            gone.setdefault(k, set()).update(range(s, s + 20))
    return [(i, len(w), len(gone.get(k, ())), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone.get(k, ())).encode()).hexdigest()) for k, (i, w) in enumerate(rows)]


def test_substring_dedup_brute_force(spark, odd):
    rng = random.Random(3)
    passage = [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(200)]
    rows = []
    for i in range(120):
        w = [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(170)
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[a : a + rng.randrange(15, 60)]
        if i % 10 == 0:
            w += ["same"] * rng.randrange(45)
        rows.append((rng.randrange(100) if i % 9 else None, w))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = substring.remove(df.repartition(5), block_mb=1)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str) == sorted(brute_substring(rows), key=str)
    want = brute_substring([(r.doc_id, r.text.encode().split() and [x.decode() for x in r.text.encode().split()] if r.text else []) for r in odd.collect()])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove(odd).collect()), key=str) == sorted(want, key=str)
    assert substring.remove(odd.limit(0)).count() == 0


def brute_jaccard(rows, n, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((key, len(sets[i]), (min(ids) if ids else None) if sets[i] else key))
    return out


@pytest.mark.parametrize("chunk", [8, 512])
def test_jaccard_brute_force(spark, odd, chunk):
    rng = random.Random(4)
    base = [f"v{rng.randrange(400)}" for _ in range(90)]
    rows = []
    for i in range(150):
        w = list(base) if i % 2 else [f"v{rng.randrange(400)}" for _ in range(rng.randrange(1, 40))]
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**5)}"
        rows.append((i, " ".join(w)))
    rows += [(None, rows[1][1]), (999, rows[1][1].upper()), (1000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.join(df.repartition(4), words=4, percent=85, chunk=chunk).drop("n_links")
    want = brute_jaccard(rows, 4, 85)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert jaccard.dedup(df, words=4, percent=85, chunk=chunk).count() == len({c for _, n, c in want if n}) + sum(n == 0 for _, n, _ in want)


def test_jaccard_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, jaccard.join(odd).drop("n_links").collect()), key=str) == sorted(brute_jaccard(rows, 5, 80), key=str)
    kept = jaccard.dedup(odd)
    assert kept.columns == odd.columns and kept.where("text LIKE 'w%'").count() == 1
    clash = jaccard.join(odd.withColumns({c: F.lit("clash") for c in ("class", "n", "component", "root", "block", "row")}))
    assert sorted(map(tuple, clash.drop("n_links").collect()), key=str) == sorted(brute_jaccard(rows, 5, 80), key=str)
    kept = jaccard.dedup(odd.withColumns({c: F.lit("clash") for c in ("class", "n", "component", "root", "rows")}))
    assert kept.count() == jaccard.dedup(odd).count() and {r["class"] for r in kept.collect()} == {"clash"}
    assert jaccard.join(odd.limit(0)).count() == 0 and jaccard.dedup(odd.limit(0)).count() == 0


def test_jaccard_dedup_keeps_unlinked_rows_of_null_or_shared_ids(spark):
    text = lambda k, *more: " ".join([f"{k}{i}" for i in range(40)] + list(more))
    rows = [(None, text("a")), (None, text("b")), (None, text("b", "z")), (7, text("c")), (7, text("d")), (7, text("d", "z")), (8, text("e")), (None, text("e", "z"))]
    kept = jaccard.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[1], rows[3], rows[4], rows[6]], key=str)


@pytest.mark.parametrize("chunk", [8, 512])
def test_jaccard_counts_every_link(spark, odd, chunk):
    rng = random.Random(11)
    base = [f"v{i}" for i in range(90)]
    rows = [(i, " ".join([*base[: 90 - i % 4], f"x{i}", *(f"y{rng.randrange(10**5)}" for _ in range(i % 9))])) for i in range(40)]
    rows += [(40, rows[0][1]), (None, rows[1][1].upper()), (41, "a b"), (42, None)]
    sets = [frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if (w := (t or "").lower().split()) else frozenset() for _, t in rows]
    like = lambda a, b: a != b and 100 * len(a & b) >= 85 * len(a | b)
    want = [(d, sum(like(s, o) for o in set(sets) if o) if s else 0) for (d, _), s in zip(rows, sets)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.join(df, words=4, percent=85, chunk=chunk)
    assert sorted(((r.doc_id, r.n_links) for r in got.collect()), key=str) == sorted(want, key=str)
    assert max(n for _, n in want) > 20 and sorted(map(tuple, got.drop("n_links").collect()), key=str) == sorted(brute_jaccard(rows, 4, 85), key=str)


def test_blocks_of_long_texts_are_bounded(spark):
    from citeloom.llm.common import Blocks, places

    rng = random.Random(17)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(500_000)) if i % 3 else "short") for i in range(45)]  # 2 MB each
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    blocks = Blocks(df, "long", 4)
    read, seen = blocks.reader(["doc_id", "text"]), []
    assert blocks.count >= 10
    for block in places(blocks.table.orderBy("block").toArrow()):
        some = list(read(block))
        assert sum(b.nbytes for b in some) <= 12 << 20 and all(b.nbytes <= 10 << 20 or b.num_rows == 1 for b in some)
        seen += [i for b in some for i in b.column(0).to_pylist()]
    assert seen == list(range(45))
    got = {r.doc_id: r for r in substring.remove(df, texts=False, block_mb=4).collect()}
    assert got[1].n_words == 500_000 and got[1].n_removed < 500_000 and {got[i].n_words for i in range(0, 45, 3)} == {1}
    kept = jaccard.dedup(df, block_mb=4)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [0, *(i for i in range(45) if i % 3)]


def test_blocks_are_told_by_rows(spark):
    """No list of blocks on the driver: the object holds totals, and every block comes from a row of its table."""
    from citeloom.llm.common import Blocks, Place, cut, places

    df = spark.range(0, 40_000, 1, 7).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    blocks = Blocks(df, "many", 1)
    assert not any(isinstance(v, (list, tuple, dict)) and len(v) > 8 for v in vars(blocks).values())
    assert blocks.table.count() == blocks.count >= 7 and blocks.span < 3 * blocks.count
    read = blocks.reader(["id"])
    got = blocks.map(lambda place: iter([b for b in read(place)]), "id long")
    assert sorted(r.id for r in got.collect()) == list(range(40_000))
    every = blocks.places_in_tasks()
    assert sorted(p for share in range(3) for p in every(share, 3)) == sorted(places(blocks.table.toArrow()))
    assert isinstance(next(every(0, 1)), Place) and Blocks(df.limit(0), "none").count == 0
    assert [c[:4] for c in cut([(10, 100), (10, 100), (0, 0), (10, 500), (5, 30)], 250)] == [(0, 1, 0, 20), (3, 3, 0, 5), (3, 3, 5, 5), (4, 4, 0, 5)] and list(cut([], 9)) == []


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for a, b in edges if a != b for n in (a, b)}


def test_shared_counts_and_forest():
    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 250)).astype(np.uint64)) for _ in range(60)]
    i, j = np.array([(a, b) for a in range(60) for b in range(a)]).T
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    for price in (0.0, 1e9):  # one by one, and by products
        before, jaccard.PAIR = jaccard.PAIR, price
        assert jaccard.shared_by(sets, i, j).tolist() == want
        jaccard.PAIR = before
    edges = rng.integers(0, 200, (120, 2))
    up = list(range(200))
    for a, b in edges.tolist():
        a, b = min(up[a], up[b]), max(up[a], up[b])
        up = [a if x == b else x for x in up]
    a, b = jaccard.forest(200, *edges.T)
    assert dict(zip(a.tolist(), b.tolist())) == {k: r for k, r in enumerate(up) if k != r}


def test_tree_bound_loses_nothing():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 80, rng.integers(1, 60)).astype(np.uint64) << np.uint64(20)) for _ in range(120)]
    sizes = np.array(list(map(len, sets)))
    points = np.array([np.bincount((s >> np.uint64(20)).astype(int) % 64, minlength=64) for s in sets], np.uint16)
    tree = jaccard.CountTree(points, sizes)
    for i, s in enumerate(sets):
        near = set(tree.near(points[i].astype(np.int32), len(s), 70).tolist())
        for j, o in enumerate(sets):
            both = len(np.intersect1d(s, o))
            assert 100 * both < 70 * (len(s) + len(o) - both) or j in near


def brute_nearest(ids, x, q, k):
    """Rows nearest to row q, itself left out, ties to the smaller id."""
    s = x @ x[q]
    return sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], ids[i]))[:k]


def test_ann_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, None), (3001, [0.0] * 32), (3002, [float("nan")] * 32), (3003, [1.0, None] * 16), (3004, [1.0] * 5), (None, x[0].tolist()), (3006, [float("inf")] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("rank", "score", "block", "row", "asked")})
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(range(0, 3000, 20)) and all(len(v) == 20 and [r["rank"] for r in v] == list(range(1, 21)) for v in got.values())
    y, hits = x.astype(float), 0
    for q, v in got.items():
        hits += len({r.vec_id for r in v} & set(brute_nearest(range(3000), y, q, 20)))
        assert all(abs(r.score - y[r.vec_id] @ y[q]) < 1e-9 for r in v)
        assert [(-r.score, r.vec_id) for r in v] == sorted((-r.score, r.vec_id) for r in v)
    assert hits >= 0.9 * 20 * len(got)
    assert ann.search(df.where("vec_id < 5"), F.lit(True), 20).count() == 20
    assert ann.search(df.limit(0), F.lit(True), 20).count() == 0 and ann.search(df, F.lit(None).cast("boolean"), 20).count() == 0


def test_ann_shared_ids_and_ties(spark):
    rng = np.random.default_rng(13)
    x = rng.integers(-2, 3, (30, 6)).astype(float) + 0.5
    ids = [0, 0, *range(1, 29)]
    x[20:30] = x[20]  # equal scores about rank 20
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(df, F.col("vec_id") % 20 == 0, 20, share=1.0).collect()]
    near = {q: brute_nearest(ids, x, q, 29) for q in range(30) if ids[q] % 20 == 0}
    # every candidate is within reach here, so ranks are those of brute force; both rows of id 0 ask, and each finds the other
    want = [(ids[q], k + 1, ids[i], round(float(x[i] @ x[q]), 9)) for q, some in near.items() for k, i in enumerate(some[:20])]
    codes = ann.Codes(x, 20, 1.0)
    codes.radius = codes.bits
    shard = ann.Shard(codes, x)
    assert [list(zip(np.array(ids)[at].tolist(), s.round(9).tolist())) for q in near for at, s in [shard.best(20, np.array(ids), x, x[q], q)]] == [[(i, s) for a, _, i, s in want[20 * n : 20 * n + 20]] for n in range(len(near))]
    assert Counter(q for q, *_ in got) == {0: 40, 20: 20} and 0 in {i for q, _, i, _ in got if q == 0}


def test_ann_probes_buckets_and_misses_none_within_the_radius():
    rng = np.random.default_rng(14)
    centres = rng.standard_normal((200, 64))
    x = centres[rng.integers(0, 200, 6000)] + 0.05 * rng.standard_normal((6000, 64))
    codes = ann.Codes(x[:2000], 5)
    shard, touched = ann.Shard(codes, x), 0
    for q in range(0, 6000, 100):
        code = codes(x[q : q + 1])[0]
        found = shard.probe(code)
        within = np.flatnonzero(ann.BITS[shard.index ^ code].sum(1, dtype=int) <= codes.radius)
        assert set(within) <= set(found)
        touched += len(found)
    assert touched < 0.3 * 60 * 6000  # where vectors have structure, most rows are never looked at


def test_language_id(spark, odd):
    words = {"en": "the and with this river stone", "de": "und der nicht mit stein fluss", "es": "que los con para piedra río"}
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(words[l].split()) for _ in range(30)), l, "s") for i in range(150) for l in [rng.choice(sorted(words))]]
    df = docs(spark, rows)
    model = langid.train(df.where("doc_id < 100"))
    got = langid.predict(df.withColumn("score", F.lit("clash")), model).where("doc_id >= 100").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    out = {(r.doc_id, r.text): r.lang_pred for r in langid.predict(odd, model).collect()}
    assert out[1, None] == out[2, ""] == "und" and out[4, "a b"] != "und" and out[7, "é 日本 😀 \x1c x"] != "und"
    mixed = docs(spark, [(1, "the river and the stone with this", "de", "s"), (2, "der fluss und der stein nicht mit", None, "s"), (3, "7 8 9 !!", "en", "s"), (4, "\u0416\u0416\u0416 0123 \u0414\u0414\u0414 9876 \u042f\u042f", "en", "s"), (5, None, "en", "s")])
    kept = langid.identified(mixed, model)
    assert kept.columns == mixed.columns and {r.doc_id: r.lang for r in kept.collect()} == {1: "en", 2: "de"}
    none = langid.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(odd.limit(0), model).count() == 0


def test_language_scores_are_those_of_an_explicit_kernel():
    rng = random.Random(15)
    words = {"en": "the and with this river stone", "de": "und der nicht mit stein fluss", "es": "que los con para piedra rio"}
    texts = [(" ".join(rng.choice(words[l].split()) for _ in range(rng.randrange(3, 9))), l) for l in ("en", "de", "es") * 8]
    packed = np.packbits(langid.marks([t for t, _ in texts]).astype(bool), axis=1)
    model = langid.Model.fit(packed, [l for _, l in texts])
    found = [set(np.flatnonzero(r)) for r in langid.marks([t for t, _ in texts])]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    k = np.array([[kernel(a, b) for b in found] for a in found])  # every text is a landmark
    values, axes = np.linalg.eigh(k)
    good = values > 1e-6 * values[-1]
    z = k @ (axes[:, good] / np.sqrt(values[good]))
    asked = ["the river with stone", "der stein", "para los", "zzz"]
    own = [set(np.flatnonzero(r)) for r in langid.marks(asked)]
    mine = np.array([[kernel(a, b) for b in found] for a in own]) @ (axes[:, good] / np.sqrt(values[good]))
    for c, name in enumerate(model.names):
        goal = np.array([l == name for _, l in texts], float)
        fitted = np.linalg.solve(z.T @ z + langid.RIDGE * np.eye(z.shape[1]), z.T @ goal)
        assert np.allclose(model.scores(asked)[:, c], mine @ fitted, atol=2e-3)


def test_toxicity_risk_and_its_gradient():
    rng = np.random.default_rng(16)
    loss = lambda z, y: float(np.log1p(np.exp(-y * z)))
    for scale in (0.1, 3.0):  # the second drives the negatives' part below 0
        p, u, prior = rng.integers(0, 2, (7, 5)).astype(float), rng.integers(0, 2, (11, 5)).astype(float), 0.4
        w = scale * rng.standard_normal(5) - (8 * (scale > 1))
        u = p[:4] if scale > 1 else u
        w = np.abs(w) if scale > 1 else w

        def parts(w, p=p, u=u, prior=prior):
            pos = prior * sum(loss(sum(a * b for a, b in zip(x, w)), 1) for x in p) / len(p)
            neg = sum(loss(sum(a * b for a, b in zip(x, w)), -1) for x in u) / len(u) - prior * sum(loss(sum(a * b for a, b in zip(x, w)), -1) for x in p) / len(p)
            return pos, neg

        got, negative, step = toxicity.risk(w, p, u, prior)
        assert got == pytest.approx(parts(w)[0] + max(0, parts(w)[1])) and negative == pytest.approx(parts(w)[1])
        slope = lambda f: [(f(w + 1e-6 * e) - f(w - 1e-6 * e)) / 2e-6 for e in np.eye(5)]
        want = slope(lambda v: sum(parts(v))) if negative >= 0 else [-x for x in slope(lambda v: parts(v)[1])]
        assert step == pytest.approx(want, abs=1e-5)
    p, u = np.ones((4, 3)), np.zeros((4, 3))
    got, negative, step = toxicity.risk(np.array([2.0, 1.0, 0.5]), p, u, 0.9)
    assert negative < 0 and got == pytest.approx(0.9 * np.log1p(np.exp(-3.5))) and (step > 0).all()


def test_toxicity(spark, odd):
    rng = random.Random(9)
    vocab, bad = [f"word{i}" for i in range(200)], ["scum", "moron", "vequa"]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(vocab) for _ in range(40)]
        toxic = i % 8 == 0
        if toxic:
            w[5], w[20] = rng.choice(bad), rng.choice(bad)
        rows.append((i, " ".join(w), "en", "s"))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    df = docs(spark, rows)
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    scorer = toxicity.train(df.where("doc_id < 700"), lab.where("doc_id < 700 OR doc_id IS NULL"))
    got = toxicity.score(df.withColumn("score", F.lit("clash")), scorer).where("doc_id >= 700").collect()
    assert sum(r.predicted == (r.doc_id % 8 == 0) for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == 0 for r in toxicity.score(odd, scorer).collect())
    nothing = toxicity.train(df, lab.limit(0))
    assert {r.predicted for r in toxicity.score(df, nothing).collect()} == {0} and toxicity.score(odd.limit(0), scorer).count() == 0


def test_warc_round_trip_and_lookup(spark):
    big = "x" * 2000
    rows = [(1, "http://A.example.com/p?q=1#f", big), (2, "https://b.example.com/", big), (3, None, "small"), (4, "http://a.example.com/p", "small"), (None, "not a url\r\nEvil: 1", big), (5, "", None), (2, "https://b.example.com/", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    captures = warc.write_archive(pages)
    index = warc.Index.build(captures, lines=2)
    assert len(index.files) >= 3
    kept, revisited = {}, []
    for r in captures.collect():
        system, path = warc.open_fs(r.file)
        with system.open_input_file(path) as f:
            assert zlib.decompressobj(31).decompress(f.read()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
            f.seek(r.start)
            named, block = warc.fields(f.read(r.length))
        assert named["WARC-Record-ID"] not in kept and {"WARC-Type", "WARC-Date", "WARC-Target-URI", "Content-Type", "WARC-Payload-Digest"} <= set(named) and len(block) == int(named["Content-Length"])
        kept[named["WARC-Record-ID"]] = named
        revisited += [named] if named["WARC-Type"] == "revisit" else []
    for named in revisited:  # a revisit refers to a response of the same payload
        to = kept[named["WARC-Refers-To"]]
        assert to["WARC-Type"] == "response" and to["WARC-Payload-Digest"] == named["WARC-Payload-Digest"] and to["Page-ID"] == named["Refers-To-Page-ID"]
    got = warc.read_records(index.lookup(warc.keys(pages))).collect()
    key = lambda r: (str(r[0]), r[1], r[2], r[3], r[4])
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    want = [(1, 2000, sha(big), "revisit", 2), (2, 2000, sha(big), "response", None), (2, 2000, sha(big), "response", None), (3, 5, sha("small"), "response", None), (4, 5, sha("small"), "response", None), (5, 0, sha(""), "response", None), (None, 2000, sha(big), "revisit", 2)]
    assert sorted(map(str, map(key, got))) == sorted(map(str, map(key, want)))
    one = spark.createDataFrame([(warc.url_key("http://a.example.com/p", 4),), ("zzz",), (None,)], "key string")
    assert [r.page_id for r in warc.read_records(index.lookup(one)).collect()] == [4]
    assert warc.url_key("http://A.example.com/p?q=1#f", 1).startswith("com,example,a)/p?q=1 ")
    nulls = spark.createDataFrame([(None, "u", big), (None, "u", big), (None, "u", "y" * 3_000_000)], "page_id long, url string, html string")
    odd = [tuple(r) for r in warc.read_records(warc.Index.build(warc.write_archive(nulls)).lookup(warc.keys(nulls)), payload=False).collect()]
    assert sorted(r[1] for r in odd) == [2000, 2000, 3_000_000] and {r[3] for r in odd} == {"response"}
    many = spark.range(500).selectExpr("id AS page_id", "concat('http://h', id % 7, '.example.org/', id) AS url", "repeat(cast(id % 60 AS string), 800) AS html")
    index = warc.Index.build(warc.write_archive(many), lines=20)
    found = {r.page_id: r for r in warc.read_records(index.lookup(warc.keys(many))).collect()}
    last = {}
    for i in range(500):
        last[i % 60] = i
    assert len(index.files) >= 4 and all(found[i].refers_to == (last[i % 60] if i != last[i % 60] and len(str(i % 60)) * 800 >= 1000 else None) for i in range(500))
    empty = warc.Index.build(warc.write_archive(pages.limit(0)))
    assert warc.read_records(empty.lookup(warc.keys(pages))).count() == 0


def test_chat_is_reversible(spark):
    rows = [(1, 0, "user", "</s>[INST] \\[x\\ <<SYS>>"), (1, 1, "assistant", "é\\"), (1, 1, "assistant", None), (2, 0, None, None), (2, 1, "to>ol[", "a<b"), (None, 0, "assistant", "\\n[ANS] "), (3, 5, "assistant", "z"), (3, 2, "system", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    made = chat.format_chat(df)
    said = {r.conv_id: (chat.parse(r.formatted.encode()), [chat.unescape(r.formatted.encode()[m.start : m.stop]).decode() for m in r["mask"]]) for r in made.collect()}
    assert said[1][0] == [("user", rows[0][3]), ("assistant", ""), ("assistant", "é\\")] and said[1][1] == ["", "é\\"]
    assert said[2][0] == [("", ""), ("to>ol[", "a<b")] and said[None][1] == ["\\n[ANS] "] and said[3][0] == [("system", ""), ("assistant", "z")]
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert back[1].loss_chars == 2 and back[2].loss_chars == 0 and back[1].n_turns == 3
    assert chat.format_chat(df.limit(0)).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:  # a conversation that runs over many batches, between others
        turns = [(c, t, "assistant" if t % 2 else "user", f"[{c}] turn {t}" * 40) for c, n in ((1, 5), (2, 700), (3, 3)) for t in range(n)]
        long = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
        for r in chat.format_chat(long).collect():
            own = [x for x in turns if x[0] == r.conv_id]
            assert chat.parse(r.formatted.encode()) == [(x[2], x[3]) for x in own]
            assert [chat.unescape(r.formatted.encode()[m.start : m.stop]).decode() for m in r["mask"]] == [x[3] for x in own if x[2] == "assistant"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(ValueError):
        chat.parse(b"<s>stray")


@have
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    told = {r.doc_id: r for r in langid.predict(spark.read.parquet(f"{SF}/documents.parquet"), langid.train(spark.read.parquet(f"{SF}/documents.parquet"))).collect()}
    rows = [r for r in rows if told[r.doc_id].lang_pred != "und" and told[r.doc_id].score >= langid.LEAST_SCORE]
    best = {}
    for r in sorted(rows, key=lambda r: (-len(r.text), r.doc_id)):
        best.setdefault("".join(c for c in r.text if c not in " \t\n\x0b\x0c\r"), r)
    rows = sorted(best.values(), key=lambda r: r.doc_id)
    comps = brute_jaccard([(r.doc_id, r.text) for r in rows], 5, 80)
    stay = {d for d, n, c in comps if d == c}
    e, text = encoding(), {r.doc_id: r.text for r in rows}
    assert {r.doc_id for r in out} <= stay
    for r in out:
        assert r.lang == told[r.doc_id].lang_pred and list(r.ids) == e.encode_ordinary(text[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    kept = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin(list(stay)))
    assert {r.doc_id: r.copies for r in mixing.mix(kept).where("copies > 0").collect()} == {d: [r.doc_id for r in out].count(d) for d in {r.doc_id for r in out}}


def test_pipeline_stages_take_odd_and_empty_tables(spark, odd):
    import corpus_pipeline

    for rows in (odd, odd.limit(0)):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, "")
            if name != "byte_bpe":
                assert now.columns == odd.columns
        ids = sorted(map(tuple, now.select("doc_id", "n_tokens").collect()), key=str)
        assert bool(ids) == bool(rows.count()) and {i for i, _ in ids} <= {4, 5, 7, None}


@have
def test_held_out_rows(spark):
    got = {r.doc_id: r.held_out for r in queries()["op7_language_id"](spark, SF).collect()}
    assert got == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in got}

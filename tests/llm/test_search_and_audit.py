"""Ranked lexical search, MinHash near duplicates and the filter audit, against plain loops and on odd tables."""

import random
import re
from collections import Counter
from itertools import permutations
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import audit, lexical, minhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [(1, None, None, None), (2, "", "en", "b"), (3, " \t\n\x0b\x0c\r ", "en", "b"), (4, "a b", "en", "a"), (4, "a b", "en", "a"), (None, "ab", "de", None), (None, None, None, None), (5, long, "de", "a"), (6, long, "de", "b"), (7, "é 日本 😀 \x1c x", "fr", "ü"), (8, "A  b", "en", "a")]
    return spark.createDataFrame([(i, t, l, s, len(t) if t else None) for i, t, l, s in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_search(rows, items, k):
    terms = lambda t: re.findall(lexical.TERM, lower(t))
    held = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // length
            s = sum(floor(1000 * log((2.0 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            scores += [(-s, i is None, i or 0, i)] if s > 0 else []
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("how", [{}, {"segment": 2000, "block_mb": 1}])
def test_lexical_search_brute_force(spark, monkeypatch, how):
    rng = random.Random(3)
    vocabulary = [f"t{i}" for i in range(60)] + ["Été", "日本", "x.y", "A_b", "the"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = [(rng.randrange(400) if i % 9 else None, " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 3, 12, 40])))) for i in range(500)] + [(9, None), (10, "--- ,,")]
    items = [(i % 37, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 4, 9])))) for i in range(40)] + [(None, "t1 T2"), (77, None), (78, "nowhere")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.Index(df, **how).search(asked, 7)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(rows, items, 7)


def test_lexical_windows_and_large_numbers(spark, monkeypatch):
    """Segments of several windows, a query that all documents answer alike, and sums that don't fit 64 bits."""
    rows = [(i * 5 % 10_007, "same words here" + " rare" * (i in (77, 9000))) for i in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = lexical.Index(df).search(spark.createDataFrame([(1, "rare"), (2, "here rare")], "item_id int, text string")).collect()
    want = sorted(rows[i][0] for i in (77, 9000))
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.item_id == 1] == want
    second = [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.item_id == 2]
    assert second[:2] == want and len(second) == 2  # what every document holds weighs nothing here
    assert lexical.norm(np.array([3, 10**9]), 10**12, 10**14).tolist() == [10 + 90 * 3 * 10**12 // 10**14, 10 + 90 * 10**21 // 10**14]
    heap = lexical.Heap(3)
    for ids in ([5, 6, 7, 8, 9], [1, 2, 3], [4]):
        heap.offer(np.full(len(ids), 10), np.array(ids))
    heap.offer(np.array([11]), np.array([99]))
    assert sorted(heap.best, reverse=True) == [(11, -99), (10, -1), (10, -2)]


def test_lexical_odd_tables(spark, odd):
    items = spark.createDataFrame([(1, "W5 a"), (2, None), (3, "é")], "item_id long, text string")
    got = lexical.Index(odd).search(items)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(rows, [(1, "W5 a"), (2, None), (3, "é")], 10)
    index = lexical.Index(odd.limit(0))
    assert index.search(items).count() == 0 and lexical.Index(odd).search(items.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, "needle " + "hay stack " * 600_000)], "doc_id long, text string")
    assert [tuple(r) for r in lexical.Index(huge.unionByName(odd.select("doc_id", "text"))).search(spark.createDataFrame([(1, "needle")], "item_id long, text string")).select("rank", "doc_id").collect()] == [(1, 1)]


def brute_near(rows, n, percent):
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    low = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    return [(d, len(sets[i]), low[root(i)] if sets[i] else d, d == (low[root(i)] if sets[i] else d)) for i, (d, _) in enumerate(rows)]


def near_rows(rng, groups=12):
    rows, i = [], 0
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([3, 30, 200]) if g else 200)]
        for _ in range(60 if g == 0 else rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
            rows.append((i, (" " if i % 2 else "\n").join(w).upper() if i % 5 == 0 else " ".join(w)))
            i += 1
    return rows + [(None, rows[0][1]), (3, rows[5][1]), (i, None), (i + 1, " \t"), (i + 2, "one two"), (i + 3, "One  two")]


@pytest.mark.parametrize("chunk", [minhash.CHUNK, 40_000])
def test_minhash_brute_force(spark, chunk):
    rows = near_rows(random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).repartition(3)
    got = minhash.near(df, words=4, percent=80, chunk=chunk)
    want = brute_near(rows, 4, 80)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert max(Counter(c for _, n, c, _ in want if n).values()) > 30
    kept = minhash.dedup(df, words=4, percent=80, chunk=chunk)
    assert kept.columns == df.columns and kept.count() == len({c for _, n, c, _ in want if n}) + sum(not n for _, n, _, _ in want)


def test_minhash_search_skips_no_one():
    """Trees of the search span the same components as all pairs do, also where some are known to be connected."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 16, (9, minhash.COORDINATES), np.uint16)
    signature = base[rng.integers(0, 9, 120)]
    change = rng.random(signature.shape) < rng.random((120, 1)) * 0.6
    signature = np.where(change, rng.integers(0, 1 << 16, signature.shape, np.uint16), signature)
    agree = (signature[:, None] == signature[None]).sum(2) >= 32

    def components(pairs):
        up = list(range(120))
        for a, b in pairs:
            a, b = sorted((up[a], up[b]))
            up = [a if x == b else x for x in up]
        return up

    want = components(zip(*np.nonzero(agree)))
    a, b = minhash.search(signature, 32)
    assert components(zip(a, b)) == want and len(a) < 120 and agree[a, b].all()
    for i in range(0, 120, 7):
        assert minhash.colliding(signature, i, np.arange(120), 32).tolist() == np.flatnonzero(agree[i]).tolist()
    known = np.where(np.arange(120) % 3 == 0, np.array(want), np.arange(120) + 1000)
    a, b = minhash.search(signature, 32, None, known)
    given = [(x, y) for x in range(120) for y in range(x) if known[x] == known[y]]
    assert components([*zip(a, b), *given]) == want and not any(known[x] == known[y] for x, y in zip(a, b))
    assert minhash.agree(80) == 32 and minhash.agree(90) > 40


def test_minhash_odd_tables(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, minhash.near(odd, words=4).collect()), key=str) == sorted(brute_near(rows, 4, 80), key=str)
    assert minhash.near(odd.limit(0)).count() == 0 and minhash.dedup(odd.limit(0)).count() == 0
    apart = spark.createDataFrame([(None, "a b c d e f"), (None, "u v w x y z"), (7, "k l m n o p"), (7, "q r s t u v")], "doc_id long, text string")
    assert minhash.dedup(apart).count() == 4


def brute_audit(rows, labels):
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    said = {}
    for d, q, x in labels:
        g, b = said.get(d, (False, False))
        said[d] = (g or q == 1, b or x == 1)
    parts = {}
    for d, t, p in rows:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = t in first and (d is None or d > first[t])
        parts.setdefault(p or "", []).append((fails, *(said.get(d, (False, False)) if d is not None else (False, False))))
    out = []
    for p, docs in parts.items():
        share = Counter()
        mine = []
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                f, before = order[step - 1], order[: step - 1]
                gone = [any(x[b] for b in before) for x, _, _ in docs]
                removed = [x[f] and not g for (x, _, _), g in zip(docs, gone)]
                share[f] += sum(removed)
                kept = sum(not any(x[b] for b in order[:step]) for x, _, _ in docs)
                mine.append((p, order, step, kept, sum(removed), sum(x[f] and g for (x, _, _), g in zip(docs, gone)), sum(x[f] and sum(x.values()) == 1 for x, _, _ in docs), sum(r and q for r, (_, q, _) in zip(removed, docs)), sum(r and b for r, (_, _, b) in zip(removed, docs)), f))
        out += [(*m[:9], share[m[9]]) for m in mine]
    return sorted(out)


def test_audit_brute_force(spark, odd):
    rng = random.Random(6)
    rows = [(rng.randrange(80) if i % 11 else None, rng.choice(["", None, "a b $", "A B C", " ".join(f"w{k}" for k in range(120)), " ".join(f"w{k % 50}" for k in range(120)), "É" * 9 + "A", "x|y " * 130, "\x1c a"]), rng.choice(["en", "de", "", None])) for i in range(200)]
    labels = [(rng.choice([rng.randrange(80), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("part", F.lit("clash"))
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit("clash"))
    got = audit.audit(df, said)
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)
    assert sorted(map(tuple, audit.audit(odd, said).collect())) == brute_audit([(r.doc_id, r.text, r.lang) for r in odd.collect()], labels)
    assert audit.audit(odd.limit(0), said).count() == 0 and audit.audit(odd, said.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
    assert {k: m.shape for k, m in audit.incidence().items()} == dict.fromkeys(audit.OUTCOMES, (32, 600))

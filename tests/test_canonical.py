"""Canonical JSON and its hashes, against a plain recursion over parsed values."""

import json
import math
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from citeloom.functions import canonical as C
from citeloom.functions import text as T


def js_number(x):
    """How JavaScript prints a finite double: the shortest digits that read back as the same."""
    if x == 0:
        return "0"
    mantissa, exponent = f"{abs(x):.17e}".split("e")
    for k in range(1, 18):
        if float(f"{abs(x):.{k - 1}e}") == abs(x):
            mantissa, exponent = f"{abs(x):.{k - 1}e}".split("e")
            break
    digits, n = mantissa.replace(".", "").rstrip("0"), int(exponent) + 1
    k = len(digits)
    if k <= n <= 21:
        out = digits + "0" * (n - k)
    elif 0 < n <= 21:
        out = digits[:n] + "." + digits[n:]
    elif -6 < n <= 0:
        out = "0." + "0" * -n + digits
    else:
        out = digits[0] + ("." + digits[1:] if k > 1 else "") + "e" + ("+" if n > 0 else "-") + str(abs(n - 1))
    return ("-" if x < 0 else "") + out


def plain(v):
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{plain(v[k])}" for k in sorted(v, key=lambda s: s.encode("utf-16-be"))) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return js_number(float(v)) if math.isfinite(float(v)) else "null"
    return json.dumps(v, ensure_ascii=False)


def plain_hash(s):
    a, b = 0x811C9DC5, 0x45D9F3B
    units = s.encode("utf-16-le")
    for i in range(len(units) // 2):
        u = units[2 * i] | units[2 * i + 1] << 8
        a = (a ^ u) * 0x01000193 % (1 << 32)
        b = (b ^ (u + i)) * 0x27D4EB2D % (1 << 32)
    return f"{a:08x}{b:08x}"


def anything(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    if kind == 0:
        return rng.choice([None, True, False])
    if kind in (1, 2):
        return rng.choice([0, -0.0, 7, -12, 1e21, 1e20, 1.5e-7, 0.000001, 100, 1.10, 12345678901, -3.25, 1e-10, 123456789012345680000, 0.1, 5e300, round(rng.uniform(-1e6, 1e6), rng.randrange(8))])
    if kind in (3, 4, 5):
        return "".join(rng.choice(['"', "\\", "\n", "\x0b", "\x1f", "é", "日", "😀", "ﬀ", "a", "1", "-", "{", " ", "\x7f", "/", "\\u001F"]) for _ in range(rng.randrange(9)))
    if kind == 6:
        return [anything(rng, depth - 1) for _ in range(rng.randrange(5))]
    return {"".join(rng.choice(["b", "a", "é", "😀", "ﬀ", "1", '"', "B", "\n"]) for _ in range(rng.randrange(4))): anything(rng, depth - 1) for _ in range(rng.randrange(6))}


def test_canonical_text_and_hash_of_any_value(spark):
    rng = random.Random(9)
    values = [anything(rng, 5) for _ in range(400)] + [[], {}, [[]], {"a": {}}, "", {"k": [None, {"z": 1, "y": [2.50, {"q": "x"}]}]}]
    deep = 1
    for i in range(60):
        deep = {"d": deep} if i % 2 else [deep]
    values.append(deep)
    rows = [(i, json.dumps(v, ensure_ascii=bool(i % 2), indent=i % 3 or None)) for i, v in enumerate(values)] + [(-1, "{no"), (-2, None), (-3, '{"a": 1e400, "b": 1.50E+2}'), (-4, '["' + "long \\\\ text " * 20000 + '"]')]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: (r.c, r.h) for r in df.select("i", C.canonical_json(F.col("t")).alias("c"), C.value_hash(F.col("t")).alias("h")).collect()}
    for i, v in enumerate(values):
        assert got[i] == (plain(json.loads(rows[i][1])), plain_hash(plain(v))), rows[i]
    assert got[-1] == got[-2] == (None, None) and len(got[-4][0]) == 20000 * 13 + 4
    # a struct's absent fields aren't part of it, however it is written
    pair = spark.sql("SELECT to_json(named_struct('b', 2.50D, 'a', cast(null AS string), 'c', named_struct('y', array(1, 2), 'x', 'é'))) AS t")
    assert pair.select(C.canonical_json(F.col("t"))).first()[0] == '{"b":2.5,"c":{"x":"é","y":[1,2]}}'


def test_nulls_of_objects_go_and_those_of_lists_stay(spark):
    rng = random.Random(3)

    def bare(v):
        if isinstance(v, dict):
            return {k: bare(x) for k, x in v.items() if x is not None}
        return [bare(x) for x in v] if isinstance(v, list) else v

    values = [anything(rng, 5) for _ in range(200)] + [{"a": None}, {"a": None, "b": None}, {"z": {"y": None}, "a": [None, {"b": None}]}, {'x":null,': 'y":null,"'}, None]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, t string").select("i", C.without_nulls(F.col("t")).alias("t")).collect()}
    assert all((json.loads(got[i]) if got[i] is not None else None) == bare(v) for i, v in enumerate(values))


def test_stored_rows_are_read_and_written(spark):
    from citeloom.sources import rows as R

    stored = spark.createDataFrame([("1", '{"tableId":"t","rowIndex":2}', '{"page":3}', '[{"page":1,"x":0.5}]', '{"k":"v"}'), ("2", None, "", "no", None)], "id string, table_location string, location string, bbox string, metadata string")
    one, two = R.decoded(stored, R.SPANS).orderBy("id").collect()
    assert one.table_location.tableId == "t" and one.table_location.rowIndex == 2 and one.location.page == 3 and one.bbox[0].x == 0.5 and one.metadata == {"k": "v"}
    assert (two.table_location, two.location, two.bbox, two.metadata) == (None, None, None, {})
    again = R.encoded(R.decoded(stored, R.SPANS), R.SPANS).orderBy("id").collect()
    assert json.loads(again[0].table_location) == {"tableId": "t", "rowIndex": 2} and again[0].metadata == '{"k":"v"}' and (again[1].location, again[1].metadata) == (None, "{}")
    chunks = spark.createDataFrame([("1", '["a","b"]', None), ("2", "", "x")], "id string, source_span_ids string, metadata string")
    assert [r.source_span_ids for r in R.decoded(chunks, R.CHUNKS).orderBy("id").collect()] == [["a", "b"], []]


def test_hashes_of_many_texts_at_once(spark):
    texts = [None, "", "a", "é\U0001f600z", "x" * 5000, *("t" * (i % 7) + chr(0x4E00 + i) * (i % 11) for i in range(60))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = [r.h for r in rows.select("i", T.stable_hash(F.col("t")).alias("h")).orderBy("i").collect()]
    assert C.stable_hashes(pa.array(texts)).to_pylist() == want
    long = [f'{{"k":{i},"t":"{"word " * 200}"}}' for i in range(2000)]
    given = spark.createDataFrame([(t,) for t in long], "t string").coalesce(1)
    df = C.with_value_hash(given, F.col("t"), "h")
    assert df.first().h == given.select(C.value_hash(F.col("t")).alias("h")).first().h
    df.count()
    began = time.time()
    assert len({r.h for r in df.collect()}) == 2000 and time.time() - began < 4

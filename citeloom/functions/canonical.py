"""The canonical text of any JSON value, whatever its shape: keys in the order of their UTF-16 units, no spaces, numbers and escapes as JavaScript writes them.

A value of unknown shape is parsed into a variant, which holds an object's fields in that order at any depth; what is
written from it differs from the canonical text only in numbers and in escapes of control characters, and these are
mended token by token. So there is no recursion and no limit on depth.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import text as T

#: Strings, numbers and all between them. Possessive, so that long strings don't grow the matcher's stack.
_TOKEN = r'"(?:[^"\\]++|\\.)*+"|-?\d++(?:\.\d++)?+(?:[eE][+-]?\d++)?+|[^"\d-]++|-'
_ESCAPE = r"\\u[0-9A-Fa-f]{4}|\\.|[^\\]++"


def _string(token: Column) -> Column:
    """A string's token with escapes in small hexadecimal digits."""
    small = F.array_join(F.transform(F.regexp_extract_all(token, F.lit(_ESCAPE), F.lit(0)), lambda p: F.when(F.startswith(p, F.lit("\\u")), F.lower(p)).otherwise(p)), "")
    return F.when(F.contains(token, F.lit("\\u")), small).otherwise(token)


def _parts(number: Column) -> Column:
    """sign, digits (without zeros around them) and where the point stands, counted from before the first digit."""
    def split(t: Column) -> Column:
        whole = F.regexp_extract(t, r"^-?(\d+)", 1)
        rest = F.regexp_extract(t, r"\.(\d+)", 1)
        shift = F.coalesce(F.nullif(F.regexp_extract(t, r"[eE]([+-]?\d+)", 1), F.lit("")).cast("int"), F.lit(0))
        every = F.concat(whole, rest)
        bare = F.regexp_replace(every, "^0+", "")
        return F.struct(F.when(F.startswith(t, F.lit("-")), "-").otherwise("").alias("sign"), F.regexp_replace(bare, r"0+\z", "").alias("digits"), (F.length(whole) + shift - (F.length(every) - F.length(bare))).alias("point"))

    return T.let(number, split)


def _laid_out(p: Column) -> Column:
    """A number's digits as JavaScript lays them out."""
    digits, point, sign = p["digits"], p["point"], p["sign"]
    n = F.length(digits)
    zeros = lambda k: F.repeat(F.lit("0"), k)
    exponent = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), F.lit("e"), F.when(point > 0, "+").otherwise("-"), F.abs(point - 1).cast("string"))
    plain = F.when((n <= point) & (point <= 21), F.concat(digits, zeros(point - n))).when((point > 0) & (point <= 21), F.concat(F.left(digits, point), F.lit("."), F.substr(digits, point + 1))).when((point > -6) & (point <= 0), F.concat(F.lit("0."), zeros(-point), digits)).otherwise(exponent)
    return F.when(n == 0, "0").otherwise(F.concat(sign, plain))


def number(text: Column) -> Column:
    """A JSON number as JavaScript prints the double it stands for. Up to 15 digits they are the number's own; beyond, those of the double."""
    def whole(p: Column) -> Column:
        double = T.let(text.cast("double"), lambda d: F.when(F.abs(d) == float("inf"), F.lit("null")).otherwise(T.let(_parts(d.cast("string")), _laid_out)))
        return F.when((F.length(p["digits"]) <= 15) & F.abs(p["point"]).between(0, 300), _laid_out(p)).otherwise(double)

    return T.let(_parts(text), whole)


def canonical_json(text: Column) -> Column:
    """The canonical text of JSON; null if it isn't JSON or null. Of a struct: canonical_json(F.to_json(struct)), where fields that are null aren't there."""
    tokens = F.regexp_extract_all(F.to_json(F.try_parse_json(text)), F.lit(_TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit('"')), _string(t)).when(t.rlike(r"^-?\d"), number(t)).otherwise(t)), "")


#: Rows of which a place is taken at once; fewer are gone on with one by one.
TOGETHER = 16


def stable_hashes(texts: pa.Array) -> pa.Array:
    """text.stable_hash() of many texts at once: a place of all of them is one step, from the longest text to the shortest."""
    mask, whole = np.uint64(0xFFFFFFFF), 1 << 32
    units = [b"" if t is None else t.encode("utf-16-le") for t in texts.to_pylist()]
    n = np.array([len(u) // 2 for u in units], int)
    flat, starts = np.frombuffer(b"".join(units), "<u2"), np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    starts, n = starts[order], n[order]
    a, b = (np.full(len(n), seed, np.uint64) for seed in T.SEEDS)
    f, g = map(np.uint64, T.FACTORS)
    at, rows = 0, len(n)
    while rows and n[rows - 1] <= at:
        rows -= 1
    while rows >= TOGETHER:
        u = flat[starts[:rows] + at].astype(np.uint64)
        a[:rows] = (a[:rows] ^ u) * f & mask
        b[:rows] = (b[:rows] ^ (u + np.uint64(at))) * g & mask
        at += 1
        while rows and n[rows - 1] <= at:
            rows -= 1
    for r in range(rows):
        x, y = int(a[r]), int(b[r])
        for i, u in enumerate(flat[starts[r] + at : starts[r] + n[r]].tolist(), at):
            x, y = (x ^ u) * T.FACTORS[0] % whole, (y ^ (u + i)) * T.FACTORS[1] % whole
        a[r], b[r] = x, y
    out = [""] * len(n)
    for place, x, y in zip(order.tolist(), a.tolist(), b.tolist()):
        out[place] = f"{x:08x}{y:08x}"
    return pa.array(out, pa.string(), mask=~texts.is_valid().to_numpy(zero_copy_only=False))


def value_hash(text: Column) -> Column:
    """The stable hash of a JSON value: equal for values that differ in the order of keys, spaces or spelling of numbers alone."""
    return T.stable_hash(canonical_json(text))


def with_value_hash(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with a column more: value_hash(text), taken of many rows at once, as an aggregate over a text's units costs far more than all else."""
    kept = df.columns

    def add(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            hashes = stable_hashes(batch.column(len(kept)))
            yield from table.select(range(len(kept))).append_column(name, hashes).to_batches()

    return df.withColumn("_canonical", canonical_json(text)).mapInArrow(add, StructType([*df.schema.fields, StructField(name, StringType())]))


_PLAIN = r'"(?:[^"\\]++|\\.)*+"'


def without_nulls(text: Column) -> Column:
    """JSON without the fields of objects that are null, at any depth; nulls within lists stay, as their places count. Null if it isn't JSON, or null."""
    bare = F.to_json(F.try_parse_json(text))
    # strings are matched whole, so nothing within one is taken for a field
    fields = F.regexp_replace(bare, f"{_PLAIN}:null,?+|({_PLAIN})", "$1")
    return F.nullif(F.regexp_replace(fields, rf"({_PLAIN})|,(?=\}})", "$1"), F.lit("null"))

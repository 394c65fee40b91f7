"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

Each byte b stands as the character U+0100 + b, each vocabulary entry as the string of its bytes' characters with
score -rank, so that the merge sentencepiece prefers is the one of lowest rank, leftmost first. Normalisation is
the identity. Pieces stand in rank order: a piece's id is its rank. The unknown piece comes last and never occurs,
for every single byte is in the vocabulary. Decoding maps ids back to bytes by the inverse table.

Pre-tokens are encoded separately, and one that is itself an entry has that entry's id. What a pre-token encodes to
is kept in a table of bounded size in each worker; very long pre-tokens aren't kept.

Defined results: a null text encodes as the empty one (no ids, empty bytes); repeated rows give repeated results;
columns of the input stay, and those named like a result (ids) are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that stand for bytes start here.
BASE = 0x100
#: Longest pre-token, in characters, whose ids are kept; how many are kept.
KEEP, MOST = 48, 400_000
ROWS = 512


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def as_piece(token: bytes) -> str:
    return "".join(chr(BASE + b) for b in token)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto. Ranks have to be 0, 1, 2, ... and hold every single byte."""
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("ranks have to run from 0 without gaps and to hold all single bytes")
    pieces = [_field(1, _field(1, as_piece(t).encode()) + _field(2, -float(i))) for i, t in enumerate(order)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    n = len(order)
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


def splitter(pattern: str):
    """findall of the pattern. Texts of ASCII alone go to the standard library's matcher, which is faster, with the classes written out for them."""
    import regex

    inside = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r" \t-\r"}

    def written_out(m: re.Match) -> str:
        if m[0][0] == "[":
            out = m[0]
            for name, chars in inside.items():
                out = out.replace(name, chars)
            return out
        return f"[^{inside[r'\s']}]" if m[0] == r"\S" else f"[{inside[m[0]]}]"

    plain = re.compile(re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\[sS]", written_out, pattern)).findall
    full = regex.compile(pattern).findall
    return lambda text: plain(text) if text.isascii() else full(text)


class Codec:
    """Encodes texts and decodes ids; made once in each worker."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        self.split = splitter(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.table = [bytes(ord(c) - BASE for c in self.model.id_to_piece(i)) for i in range(len(self.ranks))]
        self.names = str.maketrans({i: chr(BASE + i) for i in range(256)})
        self.kept: dict[str, tuple[int, ...]] = {}

    def _fill(self, tokens: list[str]) -> list[str]:
        """Puts the ids of all these pre-tokens in the table; returns those too long to stay there."""
        kept, ranks = self.kept, self.ranks
        if len(kept) > MOST:
            kept.clear()
        new = list(set(tokens).difference(kept))
        if not new:
            return new
        raw = [t.encode() for t in new]
        ids = {t: (ranks[r],) for t, r in zip(new, raw) if r in ranks}
        rest = [(t, r) for t, r in zip(new, raw) if t not in ids]
        ids.update(zip((t for t, _ in rest), map(tuple, self.model.encode([r.decode("latin-1").translate(self.names) for _, r in rest], num_threads=1))))
        kept.update(ids)
        return [t for t in new if len(t) > KEEP]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        tokens = self.split(text)
        long = self._fill(tokens)
        ids = list(chain.from_iterable(map(self.kept.__getitem__, tokens)))
        for t in long:
            del self.kept[t]
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    return _codecs.get((path, pattern)) or _codecs.setdefault((path, pattern), Codec(path, pattern))


def _with(df: DataFrame, name: str, kind: T.DataType, needs: str, make) -> DataFrame:
    """df with a column made from batches; the needed column goes through Python along with the others."""
    keep = [c for c in df.columns if c != name]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, kind)])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), make(part.column(needs))], [*keep, name])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with ids array<int>. path: the rank file, on every executor; pattern: what splits texts into pre-tokens."""

    def make(texts: pa.Array) -> pa.Array:
        run = codec(path, pattern).encode
        rows = [run(t) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))))

    return _with(df, "ids", T.ArrayType(T.IntegerType()), text, make)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """df with decoded binary: the bytes of each row's ids (null: none)."""

    def make(rows: pa.Array) -> pa.Array:
        run = codec(path, pattern).decode
        flat, ends = rows.values.to_numpy(zero_copy_only=False).tolist(), rows.offsets.to_numpy().tolist()
        return pa.array([run(flat[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())

    return _with(df, "decoded", T.BinaryType(), ids, make)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Columns of df but text, with n_tokens, ids_sha256 and decoded_sha256, and ids if they are wanted. Ids are decoded as soon as they are made, so that one worker with one table does both and no bytes leave it."""
    from hashlib import sha256

    made = ("n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else []))
    keep = [c for c in df.columns if c != text and c not in made]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        c = codec(path, pattern)
        names = list(map(str, range(len(c.table))))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n, a, b, flat = [], [], [], []
                for t in part.column(text):
                    ids = c.encode(t.as_py())
                    n.append(len(ids))
                    a.append(sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    b.append(sha256(c.decode(ids)).hexdigest())
                    if keep_ids:
                        flat.append(np.array(ids, np.int32))
                columns = [*(part.column(k) for k in keep), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n], dtype=np.int32)), pa.array(np.concatenate(flat))))
                yield pa.RecordBatch.from_arrays(columns, [*keep, *made])

    return df.select(*keep, F.col(text)).mapInArrow(run, schema)

"""Chat formatting by columnar byte assembly.

A conversation becomes one string: a start mark, then each turn between the marks of its role. In texts (and in names
of roles other than the three known) every character of SPECIAL gets a backslash before it, so no text can hold a
mark, and taking the backslashes away gives the text back.

For each Arrow batch numpy computes how long each turn becomes, where it starts (cumulative offsets) and where every
byte of its text lands (scatter indices); headers, texts and footers are then copied into one buffer, which becomes
the Arrow string column without another copy. Beside it stand the byte ranges of the loss mask: the assistant texts.

Rows are dealt by conversation and sorted by turn. A conversation is one value of the result, so its rows have to
meet; batches stream through, and what is held is one batch and the conversation that runs over its end.

Defined results: null text or role counts as empty; a null conv_id is a conversation; rows of equal turn stand by
role, then text (null first); repeated rows are repeated turns; other input columns are dropped; an empty table gives
an empty one.
"""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's fixed marks.
START = b"<s>"
MARKS = {"user": (b"[INST] ", b" [/INST]"), "assistant": (b"[ANS] ", b" </s>"), "system": (b"<<SYS>>\n", b"\n<</SYS>>")}
SPECIAL = b"\\[<"
SCHEMA = "conv_id long, formatted string, mask array<struct<start:int,stop:int>>"
_FLAG = np.zeros(256, bool)
_FLAG[list(SPECIAL)] = True
_BODY = rb"((?:[^\\\[<]+|\\.)*)"
_TURN = re.compile(b"|".join([*(re.escape(a) + _BODY + re.escape(b) for a, b in MARKS.values()), rb"<role " + _BODY + rb">" + _BODY + rb"</role>"]), re.S)
_ESCAPED = re.compile(rb"\\(.)", re.S)


def escape(raw: bytes) -> bytes:
    return re.sub(rb"[\\\[<]", rb"\\\g<0>", raw)


def unescape(raw: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", raw)


def marks(role: str) -> tuple[bytes, bytes]:
    return MARKS.get(role) or (b"<role " + escape(role.encode()).replace(b">", b"\\>") + b">", b"</role>")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes and their n + 1 bounds; a null has none."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def assemble(conv: pa.Array, role: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """Rows in order, those of a conversation together -> one row for each conversation."""
    n = len(conv)
    ids = np.array([(0, 0) if c is None else (1, c) for c in conv.to_pylist()], np.int64).reshape(n, 2)
    first = np.concatenate(([True], (ids[1:] != ids[:-1]).any(1)))
    raw, ends = _bytes(text)
    flagged = _FLAG[raw]
    escapes = np.concatenate(([0], np.cumsum(flagged)))
    body = np.diff(ends) + np.diff(escapes[ends])
    kinds = pc.fill_null(role, "").dictionary_encode()
    which = kinds.indices.to_numpy(zero_copy_only=False)
    named = [marks(r) for r in kinds.dictionary.to_pylist()]
    heads, feet = (np.array([len(m[i]) for m in named], np.int64)[which] for i in (0, 1))
    lead = np.where(first, len(START), 0)
    stop = np.cumsum(lead + heads + body + feet)
    at = stop - feet - body - heads  # where each header starts
    out = np.empty(int(stop[-1]), np.uint8)

    def put(where: np.ndarray, what: bytes) -> None:
        out[where[:, None] + np.arange(len(what))] = np.frombuffer(what, np.uint8)

    put(at[first] - len(START), START)
    for k, (head, foot) in enumerate(named):
        own = which == k
        put(at[own], head)
        put(at[own] + len(head) + body[own], foot)
    begin = at + heads
    target = np.arange(len(raw)) + np.repeat(begin - ends[:-1] - escapes[ends[:-1]], np.diff(ends)) + escapes[1:]
    out[target] = raw
    out[target[flagged] - 1] = 0x5C
    rows = np.flatnonzero(first)
    bounds = np.concatenate((stop[rows[1:] - 1] if len(rows) > 1 else stop[:0], stop[-1:]))
    bounds = np.concatenate(([0], bounds))
    assistant = np.array([r == "assistant" for r in kinds.dictionary.to_pylist()], bool)[which]
    owner = np.cumsum(first) - 1
    base = bounds[owner]
    spans = pa.StructArray.from_arrays([pa.array((begin - base)[assistant], pa.int32()), pa.array((begin - base + body)[assistant], pa.int32())], ["start", "stop"])
    spans_at = np.concatenate(([0], np.cumsum(np.bincount(owner[assistant], minlength=len(rows)))))
    formatted = pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(out)])
    return pa.RecordBatch.from_arrays([conv.take(pa.array(rows)), formatted.cast(pa.string()), pa.ListArray.from_arrays(pa.array(spans_at, pa.int32()), spans)], ["conv_id", "formatted", "mask"])


def _assembled(tables: list[pa.Table]) -> pa.RecordBatch:
    whole = pa.concat_tables(tables).combine_chunks()
    return assemble(*(whole.column(c).combine_chunks() for c in ("conv_id", "role", "text")))


def format_chat(df: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, formatted, mask (byte ranges of assistant texts as they stand, escaped)."""
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        held: list[pa.Table] = []  # the conversation that runs over the last batch's end, joined once when it ends
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_pylist()
            same = bool(held) and held[0].column("conv_id")[0].as_py() == conv[0]
            cut = len(conv) - 1
            while cut and conv[cut - 1] == conv[-1]:
                cut -= 1
            table = pa.Table.from_batches([batch])
            if same and not cut:
                held.append(table)
                continue
            if held or cut:
                yield _assembled([*held, table.slice(0, cut)])
            held = [table.slice(cut)]
        if held:
            yield _assembled(held)

    return rows.mapInArrow(run, SCHEMA)


def parse(formatted: bytes) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    if not formatted.startswith(START):
        raise ValueError("no start mark")
    at, out, known = len(START), [], list(MARKS)
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m or m.end() == at:
            raise ValueError(f"no turn at byte {at}")
        if m[5] is not None:
            out.append((unescape(m[4]).decode(), unescape(m[5]).decode()))
        else:
            k = m.lastindex - 1
            out.append((known[k], unescape(m[k + 1]).decode()))
        at = m.end()
    return out


def read_back(df: DataFrame) -> DataFrame:
    """conv_id, formatted, mask -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the strings and masks."""

    def run(batches):
        for batch in batches:
            rows = []
            for conv, text, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "mask"))):
                raw = text.encode()
                turns = parse(raw)
                said = b"".join(unescape(raw[m["start"] : m["stop"]]) for m in mask)
                rows.append((conv, len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said.decode()), sha256(said).hexdigest(), len(text)))
            names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)

    return df.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

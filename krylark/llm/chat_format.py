"""Chat formatting by columnar byte assembly.

The bytes of a batch of turns are laid out with numpy: lengths, cumulative offsets, scatter indices, and one
buffer that becomes the Arrow column.  A turn is ``### role\\n`` + text + ``</turn>\\n``.  In texts and roles a
backslash becomes ``\\\\``, ``#`` becomes ``\\h`` and ``<`` becomes ``\\l`` (in roles a line feed ``\\n`` too), so no
marker can occur inside a text and the way back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_type, map_arrow, string_parts

HEAD, TAIL = b"### ", b"</turn>\n"
_CODE = np.zeros(256, np.uint8)
for _c, _r in ((92, 92), (35, 104), (60, 108)):
    _CODE[_c] = _r
_ROLE_CODE = _CODE.copy()
_ROLE_CODE[10] = 110
_BACK = {b"\\": b"\\", b"h": b"#", b"l": b"<", b"n": b"\n"}


def _escaped(raw: np.ndarray, off: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Escaped bytes and their offsets."""
    special = code[raw]
    before = np.concatenate([[0], np.cumsum(special != 0)])
    at = np.arange(len(raw)) + before[1:]
    out = np.full(len(raw) + int(before[-1]), 92, np.uint8)
    out[at] = np.where(special != 0, special, raw)
    return out, off + before[off]


def _scatter(out: np.ndarray, starts: np.ndarray, data: np.ndarray, off: np.ndarray) -> None:
    """Copies segment i of ``data`` to ``starts[i]``."""
    n = np.diff(off)
    out[np.arange(len(data)) + np.repeat(starts - off[:-1], n)] = data


def assemble(roles: pa.Array, bodies: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of the turns, start and end of each text in the bytes)."""
    role, role_off = _escaped(*string_parts(roles), _ROLE_CODE)
    body, body_off = _escaped(*string_parts(bodies), _CODE)
    n_role, n_body = np.diff(role_off), np.diff(body_off)
    length = len(HEAD) + n_role + 1 + n_body + len(TAIL)
    off = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    out = np.empty(int(off[-1]), np.uint8)
    start = off[:-1]
    for i, c in enumerate(HEAD):
        out[start + i] = c
    _scatter(out, start + len(HEAD), role, role_off)
    text_at = start + len(HEAD) + n_role + 1
    out[text_at - 1] = 10
    _scatter(out, text_at, body, body_off)
    for i, c in enumerate(TAIL):
        out[text_at + n_body + i] = c
    return out, off, text_at, text_at + n_body


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", train_role: str = "assistant") -> DataFrame:
    """One row per conversation: its id, ``n_turns``, ``formatted`` and ``loss_spans`` (byte ranges of the trained texts).

    Turns are ordered by turn, then role and text (nulls first), so ties and repeated rows have one defined order.
    Null roles and texts are empty; the rows with a null id form one conversation; other columns are ignored.  A
    conversation is one output value, so its own text is the least that a task holds.
    """
    kind = column_type(turns, conv_col)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("conv", kind), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(span))])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def emit(t: pa.Table) -> pa.RecordBatch:
        conv = t.column("conv").combine_chunks()
        ids = conv.to_numpy(zero_copy_only=False) if conv.null_count == 0 else np.array(conv.to_pylist(), object)
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        last = np.append(first[1:], len(ids))
        out, off, lo, hi = assemble(t.column("role"), t.column("text"))
        base = off[first]
        text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(base, off[-1]).astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
        own = np.flatnonzero(np.array([r == train_role for r in t.column("role").to_pylist()], bool))
        group = np.searchsorted(first, own, "right") - 1
        ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(first)))]).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(lo[own] - base[group]), pa.array(hi[own] - base[group])], ["start", "end"])
        return pa.RecordBatch.from_arrays([conv.take(pa.array(first)), pa.array(last - first), text, pa.ListArray.from_arrays(pa.array(ends), spans).cast(span_type)], names=["conv", "n_turns", "formatted", "loss_spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # parts of one conversation
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            conv = b.column(0)
            goes_on = bool(held) and conv[0].as_py() == held[0].column(0)[0].as_py()
            if goes_on and conv[len(conv) - 1].as_py() == conv[0].as_py():
                held.append(t)  # rows are sorted, so the whole batch goes on with the same conversation
                continue
            t = pa.concat_tables([*held, t])
            ids = conv.to_pylist()
            cut = len(ids) - 1
            while cut > 0 and ids[cut - 1] == ids[-1]:
                cut -= 1
            cut += t.num_rows - len(ids)
            if cut:
                yield emit(t.slice(0, cut))
            held = [t.slice(cut)]  # the last conversation may go on in the next batch
        if held:
            yield emit(pa.concat_tables(held))

    df = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    df = df.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    return map_arrow(df, run, schema).withColumnRenamed("conv", conv_col)


def _plain(raw: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: _BACK[m[1]], raw) if b"\\" in raw else raw


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The (role, text) pairs of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        line = formatted.index(b"\n", at)
        end = formatted.index(TAIL, line)
        out.append((_plain(formatted[at + len(HEAD):line]), _plain(formatted[line + 1:end])))
        at = end + len(TAIL)
    return out


def read_back(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of what the formatted texts and loss spans say, read from them alone."""
    schema = T.StructType([T.StructField(conv_col, column_type(chats, conv_col)), *[T.StructField(n, k) for n, k in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[list] = [[], [], [], [], []]
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = text.encode()
                turns = parse(raw)
                whole = hashlib.sha256(b"".join(r + b"\n" + t + b"\n" for r, t in turns)).hexdigest()
                loss = b"".join(_plain(raw[s["start"]:s["end"]]) for s in spans)
                for column, x in zip(got, (len(turns), whole, len(loss.decode()), hashlib.sha256(loss).hexdigest(), len(text))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, k) for x, k in zip(got, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]], names=schema.names)

    return map_arrow(chats.select(conv_col, "formatted", "loss_spans"), run, schema)

"""Chat formatting by columnar byte assembly (operator 4).

Every turn becomes header, escaped text, footer. For a batch, numpy computes the
lengths of these segments, their cumulative offsets and the scatter indices, and
headers and contents are copied into one preallocated buffer that Arrow then reads as the
column of formatted conversations. The template marks turns; a backslash escapes itself and the start
of control strings inside texts and roles, so formatting can be undone exactly.

Cases: a null text or role is empty; null turns come first and ties are ordered by
role and text; a null conv_id is a conversation of its own; repeated rows are
repeated turns; an empty table gives no rows; extra columns are ignored. A formatted
conversation is one value, so a task holds one conversation at a time and what
fits into a batch beside it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = b"<|im_start|>", b"<|im_end|>\n"
_ESCAPED = re.compile(rb"\\(.)", re.DOTALL)


def _escaped(column: pa.Array, lines: bool = False) -> pa.Array:
    """Escapes backslashes and the opening of control strings; with lines also line feeds."""
    out = pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "<|", "<\\|")
    return pc.replace_substring(out, "\n", "\\n") if lines else out


def unescaped(data: bytes) -> bytes:
    return _ESCAPED.sub(lambda m: b"\n" if m[1] == b"n" else m[1], data)


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _scatter(out: np.ndarray, starts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copies the segments of data to the places in out where each starts."""
    lengths = np.diff(offsets)
    out[np.repeat(starts - offsets[:-1], lengths) + np.arange(len(data))] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer of all formatted turns, their offsets in it, and start and end of each text in it."""
    heads = _escaped(roles, lines=True)
    head, head_at = _raw(heads)
    body, body_at = _raw(_escaped(texts))
    n = len(texts)
    sizes = np.stack([np.full(n, len(START)), np.diff(head_at), np.full(n, 1), np.diff(body_at), np.full(n, len(END))], axis=1)
    ends = np.cumsum(sizes.ravel()).reshape(n, 5)
    begins = ends - sizes
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, fixed in ((0, START), (2, b"\n"), (4, END)):
        out[begins[:, k][:, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    _scatter(out, begins[:, 1], head, head_at)
    _scatter(out, begins[:, 3], body, body_at)
    return out, np.append(begins[:, 0], len(out)) if n else np.zeros(1, np.int64), begins[:, 3], ends[:, 3]


_FORMATTED = "conv_id long, formatted binary, loss_starts array<long>, loss_ends array<long>"


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: its formatted bytes (UTF-8) and the spans, in bytes, of the texts that the loss covers."""

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            ids = rest["conv_id"].combine_chunks()
            # The last conversation may go on in the next batch.
            changes = np.flatnonzero(np.append(_differs(ids), False)) + 1
            if len(changes):
                cut = int(changes[-1])
                yield _block(rest.slice(0, cut), changes[:-1])
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield _block(rest, np.empty(0, np.int64))

    def _differs(ids: pa.Array) -> np.ndarray:
        valid = np.asarray(ids.is_valid())
        values = np.asarray(ids.fill_null(0))
        return (values[1:] != values[:-1]) | (valid[1:] != valid[:-1])

    def _block(rows: pa.Table, changes: np.ndarray) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        roles, texts = rows["role"].combine_chunks(), rows["text"].combine_chunks()
        out, at, starts, ends = assemble(roles, texts)
        first = np.concatenate([[0], changes, [rows.num_rows]]).astype(np.int64)
        offsets = at[first]
        formatted = pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
        losses = np.flatnonzero(np.asarray(pc.equal(roles, loss_role)))
        conv = np.searchsorted(first, losses, side="right") - 1
        lists = np.searchsorted(conv, np.arange(len(first))).astype(np.int32)
        spans = [pa.ListArray.from_arrays(pa.array(lists), pa.array(x[losses] - offsets[conv])) for x in (starts, ends)]
        return pa.RecordBatch.from_arrays([rows["conv_id"].combine_chunks().take(pa.array(first[:-1])), formatted.cast(pa.binary()), *spans], ["conv_id", "formatted", "loss_starts", "loss_ends"])

    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(turn).alias("turn"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(assembled, _FORMATTED)


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The (role, text) pairs that a formatted conversation holds."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.partition(b"\n")
        out.append((unescaped(role), unescaped(text[: -len(END)])))
    return out


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text of formatted conversations, as counts and digests, from their bytes alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, data, starts, ends in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                turns = parse(data)
                loss = b"".join(unescaped(data[a:b]) for a, b in zip(starts, ends, strict=True))
                whole = hashlib.sha256()
                for role, text in turns:
                    whole.update(role + b"\n" + text + b"\n")
                rows.append((conv, len(turns), whole.hexdigest(), len(loss.decode()), hashlib.sha256(loss).hexdigest(), len(data.decode())))
            columns = [*zip(*rows, strict=True)] if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(read, _READ)

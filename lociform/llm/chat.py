"""Chat formatting with offset-aligned loss masks.

A conversation's turns, in order, are rendered as ``### role: text</turn>`` and a line end. In texts
a backslash stands before each ``\\``, ``###`` and ``</turn>`` (in roles before ``:`` too), so the
rendering is reversible. The rendered text is encoded once with offsets; the sorted spans of the
turns to learn are intersected with the sorted token spans by binary search, which gives both
the token mask and the exact characters under it.

Defined results: rows of one conversation are ordered by turn, ties by role and text; null roles
and texts are empty, a null turn comes first, null ids are one conversation, a repeated row is
a turn of its own, an empty text leaves no character to learn. Columns other than
those named are not read.

A conversation longer than ``segment_chars`` is cut between turns into segments. The tokenizer
never joins a line end with the mark behind it, so the ids are those of the
whole; a task holds one segment at a time, however long the conversation.
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

from ..shipping import map_arrow
from .common import quoted
from .tokens import held, path_of

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
CONTROL = re.compile(r"\\|###|</turn>")
ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
ROLE_END = re.compile(r"\\.|(: )", re.DOTALL)
TURN_END = re.compile(r"\\.|(</turn>\n)", re.DOTALL)
SCHEMA = "segment int, n_turns long, formatted string, input_ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start:long,end:long>>"


def escape(text: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the sorted spans of the texts whose role is to be learned."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role, ROLE_CONTROL) + SEP, escape(text)
        at += len(head)
        if role == learn and body:
            spans.append((at, at + len(body)))
        at += len(body) + len(CLOSE)
        parts += [head, body, CLOSE]
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""

    def until(pattern: re.Pattern, at: int) -> re.Match:
        for m in pattern.finditer(formatted, at):
            if m[1]:
                return m
        raise ValueError("unfinished turn")

    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        role = until(ROLE_END, at + len(OPEN))
        text = until(TURN_END, role.end())
        out.append((unescape(formatted[at + len(OPEN) : role.start()]), unescape(formatted[role.end() : text.start()])))
        at = text.end()
    return out


def intersect(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Token mask, and the characters under it, of sorted spans over sorted token spans.

    Tokens of one character share its span and a token may reach over a span's edge, so the
    characters are those of the touched tokens' union, clipped to the span.
    """
    mask, kept = np.zeros(len(starts), bool), []
    if not len(starts):
        return mask, kept
    starts = np.minimum(starts, np.concatenate([[0], np.maximum.accumulate(ends)[:-1]]))  # no gaps
    for a, b in spans:
        lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        if lo < hi:
            mask[lo:hi] = True
            kept.append((max(a, int(starts[lo])), min(b, int(ends[hi - 1]))))
    return mask, kept


def tokenizer_with_offsets(path: str | None):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path or path_of("byte_bpe_50k.json"))
    out.encode_special_tokens = True
    return out


def format_conversations(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learn: str = "assistant",
    tokenizer: str | None = None,
    segment_chars: int = 2_000_000,
) -> DataFrame:
    """One row for each conversation (segment): its id, segment, n_turns, formatted, input_ids, loss_mask, loss_spans.

    The one shuffle deals rows by conversation; each task then streams its sorted rows.
    """
    rows = df.select(
        F.col(quoted(conv_col)).alias("c"), F.col(quoted(turn_col)).alias("t"), F.coalesce(F.col(quoted(role_col)), F.lit("")).alias("r"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("x")
    )
    schema = T.StructType([T.StructField(conv_col, rows.schema["c"].dataType), *T._parse_datatype_string(SCHEMA).fields])
    target = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        encoder = held(tokenizer_with_offsets, tokenizer)
        arrow = to_arrow_schema(schema)
        done: list[tuple] = []
        turns: list[tuple[str, str]] = []
        who, segment, size, started = None, 0, 0, False

        def close() -> None:
            text, spans = render(turns, learn)
            e = encoder.encode_batch([text], add_special_tokens=False)[0]
            offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
            mask, kept = intersect(spans, offsets[:, 0], offsets[:, 1])
            done.append((who, segment, len(turns), text, e.ids, mask.tolist(), [{"start": a, "end": b} for a, b in kept]))

        def rows_out() -> pa.RecordBatch:
            columns = [pa.array(c, arrow.field(i).type) for i, c in enumerate(zip(*done, strict=True))]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=target)

        for batch in batches:
            ids, roles, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for c, role, text in zip(ids, roles, texts, strict=True):
                if started and (c != who or size + len(text) > segment_chars and turns):
                    close()
                    segment = segment + 1 if c == who else 0
                    turns, size = [], 0
                    if len(done) >= 256 or sum(len(d[3]) for d in done[-8:]) > 2_000_000:
                        yield rows_out()
                who, started = c, True
                turns.append((role, text))
                size += len(text) + len(role) + 16
        if started:
            close()
        if done:
            yield rows_out()

    return map_arrow(rows.repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x"), run, schema)


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What can be read back from the output of format_conversations, one row a conversation.

    A conversation's segments follow each other within a task, so running hashes suffice.
    """
    schema = T.StructType([formatted.schema[conv_col], *T._parse_datatype_string("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long").fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []

        def row() -> pa.RecordBatch:
            who, n, turns, chars, loss, size, tokens, marked = state
            values = [n, turns.hexdigest(), chars, loss.hexdigest(), size, tokens, marked]
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([who, *(pa.array([v], t) for v, t in zip(values, types, strict=True))], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                segment, text, mask, spans = (batch.column(k)[i].as_py() for k in (1, 2, 3, 4))
                if segment == 0:
                    if state:
                        yield row()
                    state = [batch.column(0).slice(i, 1), 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, body in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
                for span in spans:
                    learned = unescape(text[span["start"] : span["end"]])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(text)
                state[6] += len(mask)
                state[7] += sum(mask)
        if state:
            yield row()

    return map_arrow(formatted.select(conv_col, "segment", "formatted", "loss_mask", "loss_spans"), run, schema)

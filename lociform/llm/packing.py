"""Packing along a space-filling curve.

Each document's hashed vector (counts of byte trigrams in ``BUCKETS`` buckets, scaled to unit
length) is projected to ``DIMENSIONS`` fixed random directions; the quantised point's Hilbert
index orders documents so that neighbours are alike. Rows are range-sorted by that
index (ties dealt by a hash of the id, so copies don't meet in one task), tokenised once after the
shuffle, and packed one behind the other: a document that reaches over the end of a sequence
is cut and goes on in the next. Only the last sequence of each sorted range is padded.

Defined results: a null or empty text is a document of the end id alone; repeated rows and null
ids are packed like others; an empty table gives no rows; other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import map_arrow
from .common import append_columns, quoted, slices, text_or_empty
from .tokens import byte_bpe, held

BUCKETS, DIMENSIONS, BITS = 256, 4, 12
SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def directions() -> np.ndarray:
    return np.random.default_rng(20240607).normal(size=(BUCKETS, DIMENSIONS))


def hashed_vector(data: bytes) -> np.ndarray:
    """Unit-length square roots of the trigram counts."""
    counts = np.zeros(BUCKETS)
    for i in range(0, max(1, len(data) - 2), 1 << 20):
        b = np.frombuffer(data[i : i + (1 << 20) + 2], np.uint8).astype(np.uint32)
        if len(b) >= 3:
            h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(24)
            counts += np.bincount(h, minlength=BUCKETS)
    root = np.sqrt(counts)
    return root / max(1.0, float(np.linalg.norm(root)))


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points (n, d) with coordinates below 2**bits.

    Top bit first: undo the rotations and reflections of each level (exchange low bits with the first
    axis, or invert them), Gray-decode across axes, then interleave the bits.
    """
    x = points.astype(np.int64).copy()
    n, d = x.shape
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(d):
            on = (x[:, i] & level) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
        level >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        flip ^= np.where((x[:, d - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= flip[:, None]
    out = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


def curve_keys(texts: list[bytes]) -> np.ndarray:
    """Hilbert index of each text."""
    if not texts:
        return np.zeros(0, np.int64)
    points = np.stack([hashed_vector(t) for t in texts]) @ directions()
    top = (1 << BITS) - 1
    return hilbert_index(np.clip((np.tanh(points / 2) + 1) / 2 * top, 0, top).astype(np.int64), BITS)


def along_curve(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """(id, text, key) range-sorted by the curve's index."""

    def kernel(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(curve_keys([t.encode() for t in texts.to_pylist()]), pa.int64())]

    rows = df.select(F.col(quoted(id_col)).alias("id"), text_or_empty(text_col).alias("text"))
    rows = append_columns(rows, [F.col("text")], [T.StructField("key", T.LongType())], kernel).withColumn("tie", F.xxhash64("id", F.lit(3)))
    order = ["key", "tie", "id"]
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order)


def pack(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    length: int = 2048,
    end_id: int = 1,
    tokenizer: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """One row for each piece: id, start (its document's ids before it), length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset (in the sequence). Sequences have ``length``
    tokens, the last one of each sorted range at most."""
    rows = along_curve(df, text_col, id_col, partitions).select("id", "text")
    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string(SCHEMA).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = held(byte_bpe, tokenizer)
        at = 0  # tokens packed so far in this range
        first = TaskContext.get().partitionId() << 36
        end = np.array([end_id], "<u4")
        for batch in batches:
            for part in slices(batch, 512, 2 << 20):
                source, starts, lengths, ids, totals, seqs, offsets = [], [], [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    tokens = np.concatenate([encoder.encode_to_numpy(text, disallowed_special=()).astype("<u4"), end])
                    done = 0
                    while done < len(tokens):
                        n = min(length - at % length, len(tokens) - done)
                        source.append(row)
                        starts.append(done)
                        lengths.append(n)
                        ids.append(tokens[done : done + n].tobytes())
                        totals.append(len(tokens))
                        seqs.append(first + at // length)
                        offsets.append(at % length)
                        done += n
                        at += n
                who = part.column(0).take(pa.array(source, pa.int64()))
                longs = [pa.array(x, pa.int64()) for x in (starts, lengths, totals, seqs, offsets)]
                yield pa.RecordBatch.from_arrays([who, *longs[:2], pa.array(ids, pa.binary()), *longs[2:]], names=schema.fieldNames())

    return map_arrow(rows, run, schema)

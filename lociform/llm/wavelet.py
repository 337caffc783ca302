"""Token shards as wavelet matrices.

A shard file holds the ids of consecutive documents as one succinct bit-plane for each bit of
an id, most significant first; behind each plane the sequence is stably parted into ids
with a 0 and with a 1 there. With the number of ones before each block of 512 bits, rank and
select take constant and logarithmic time, so ``access``, ``rank`` and
``select`` answer from the one compressed file. ``decode`` undoes the partings of all ids.

File: ``WVM1``, a little-endian unsigned 32-bit length, a JSON header, then the named sections, each
compressed with zstd: planes, block ranks, document ids and document ends.

Defined results: null and empty texts are documents of the end id alone; rows with a null id
come first; repeated rows are documents of their own; an empty table writes no shard.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import map_arrow
from .common import Scratch, open_uri, quoted, slices, text_or_empty
from .tokens import WordBpe, held

MAGIC, BLOCK = b"WVM1", 512
SHARD_TOKENS = 2_000_000
MANIFEST = "shard long, part long, path string, n_docs long, n_tokens long, n_bytes long"
NULL_ID = -(1 << 63)


class WaveletMatrix:
    """Ids with rank and select; build from an array or read from a file's bytes."""

    def __init__(self, n: int, planes: list[np.ndarray], ones: list[np.ndarray] | None = None):
        self.n, self.planes = n, planes
        self.ones = ones if ones is not None else [self._blocks(p) for p in planes]
        self.zeros = [n - int(o[-1]) for o in self.ones]

    @staticmethod
    def _blocks(plane: np.ndarray) -> np.ndarray:
        """Ones before each block, and in all."""
        size = BLOCK // 8
        padded = np.zeros(-(-max(1, len(plane)) // size) * size, np.uint8)
        padded[: len(plane)] = plane
        each = np.bitwise_count(padded.view(np.uint64)).reshape(-1, size // 8).sum(axis=1, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(each)])

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        seq = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes = []
        for level in range(levels - 1, -1, -1):
            bit = (seq >> level) & 1 != 0
            planes.append(np.packbits(bit))
            seq = np.concatenate([seq[~bit], seq[bit]])
        return cls(len(ids), planes)

    def bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (7 - (i & 7))) & 1

    def rank1(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        block = i // BLOCK
        out = int(self.ones[level][block])
        part = self.planes[level][block * BLOCK // 8 : -(-i // 8)]
        bits = np.unpackbits(part)[: i - block * BLOCK]
        return out + int(bits.sum())

    def select(self, level: int, value: int, k: int) -> int:
        """Position of the k-th (from 0) bit of that value in a plane."""
        ones = self.ones[level]
        held = ones if value else np.minimum(np.arange(len(ones), dtype=np.int64) * BLOCK, self.n) - ones
        block = int(np.searchsorted(held, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8])[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == value)[k - int(held[block])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            b = self.bit(level, i)
            r = self.rank1(level, i)
            i = self.zeros[level] + r if b else i - r
            value = value << 1 | b
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            if token >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in positions lo to hi."""
        if token >> len(self.planes):
            return 0
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def find(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence, from 0."""
        if token >> len(self.planes):
            raise IndexError(k)
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - level) & 1
            i = self.select(level, one, i - self.zeros[level] if one else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids: from the last plane up, each parting is undone."""
        seq = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for up, plane in enumerate(reversed(self.planes)):
            bit = np.unpackbits(plane, count=self.n) != 0
            back = np.empty_like(seq)
            zeros = self.n - int(np.count_nonzero(bit))
            back[~bit] = seq[:zeros]
            back[bit] = seq[zeros:] | (1 << up)
            seq = back
        return seq.astype("<u4")


def dump(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard file's bytes."""
    m = WaveletMatrix.build(ids)
    press = zstandard.ZstdCompressor(level=1)
    parts = {f"plane{i}": p.tobytes() for i, p in enumerate(m.planes)}
    parts |= {f"ones{i}": o.astype("<i8").tobytes() for i, o in enumerate(m.ones)}
    parts |= {"docs": doc_ids.astype("<i8").tobytes(), "ends": ends.astype("<i8").tobytes()}
    packed = {k: press.compress(v) for k, v in parts.items()}
    head = json.dumps({"n": m.n, "levels": len(m.planes), "sections": {k: len(v) for k, v in packed.items()}}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *packed.values()])


def load(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """Document ids, document ends and the ids of a shard file."""
    if data[:4] != MAGIC:
        raise ValueError("not a token shard")
    (size,) = struct.unpack_from("<I", data, 4)
    head = json.loads(data[8 : 8 + size])
    at, got, open_ = 8 + size, {}, zstandard.ZstdDecompressor()
    for k, n in head["sections"].items():
        got[k] = open_.decompress(data[at : at + n])
        at += n
    planes = [np.frombuffer(got[f"plane{i}"], np.uint8) for i in range(head["levels"])]
    ones = [np.frombuffer(got[f"ones{i}"], "<i8") for i in range(head["levels"])]
    return np.frombuffer(got["docs"], "<i8"), np.frombuffer(got["ends"], "<i8"), WaveletMatrix(head["n"], planes, ones)


def write_shards(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    end_id: int = 2,
    tokenizer: str | None = None,
    scratch: Scratch | None = None,
    folder: str | None = None,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Encode df in ascending order of an integer id and write its shards; the manifest, one row a file.

    Rows are range-sorted by id, so a task writes consecutive documents; a file is closed at
    ``shard_tokens``, which bounds a task's memory. File names carry the task attempt and
    the manifest names only files of attempts that ended well.
    """
    scratch = scratch or Scratch(df.sparkSession, "shards")
    folder = folder or scratch.path("files")
    rows = df.select(F.col(quoted(id_col)).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    order = [F.asc_nulls_first("id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    names = T._parse_datatype_string(MANIFEST).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encoder = TaskContext.get(), held(WordBpe, tokenizer)
        shard, part = task.partitionId(), 0
        docs: list[int] = []
        tokens: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            data = dump(np.array(docs, np.int64), np.cumsum([len(t) for t in tokens]), np.concatenate(tokens))
            path = f"{folder}/shard-{shard:06d}-{part:04d}-{task.taskAttemptId()}.wvm"
            with open_uri(path, "wb") as f:
                f.write(data)
            row = [shard, part, path, len(docs), sum(map(len, tokens)), len(data)]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=names)

        size = 0
        for batch in batches:
            for piece in slices(batch, 1024, 2 << 20):
                for who, ids in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist(), end_id), strict=True):
                    docs.append(NULL_ID if who is None else who)
                    tokens.append(ids)
                    size += len(ids)
                    if size >= shard_tokens:
                        yield flush()
                        docs, tokens, size, part = [], [], 0, part + 1
        if docs:
            yield flush()

    return scratch.keep(map_arrow(rows, run, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(id, start, ids): the documents of a manifest's files with their ids (little-endian
    unsigned 32-bit) and the number of ids in all documents before. One task a file."""
    # a running sum over the files, of which there are few: one row for some millions of tokens
    base = F.sum("n_tokens").over(Window.orderBy("shard", "part")) - F.col("n_tokens")
    files = max(1, manifest.count())
    listed = manifest.select("path", base.alias("base")).repartition(files)
    schema = T._parse_datatype_string("id long, start long, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_uri(path, "rb") as f:
                    docs, ends, matrix = load(f.read())
                ids = matrix.decode()
                starts = np.concatenate([[0], ends[:-1]])
                for i in range(0, len(docs), 1024):
                    d, s, e = docs[i : i + 1024], starts[i : i + 1024], ends[i : i + 1024]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d, pa.int64(), mask=d == NULL_ID), pa.array(s + before), pa.array([ids[a:b].tobytes() for a, b in zip(s, e, strict=True)], pa.binary())],
                        names=schema.fieldNames(),
                    )

    return map_arrow(listed, run, schema)

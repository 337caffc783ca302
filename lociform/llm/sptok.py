"""SentencePiece encoding and decoding by suffix-array matching.

A slice's texts are normalised and cut where no piece can reach over; the distinct parts are
concatenated into one text with separators, whose suffixes are sorted. Each piece's
occurrences are one range of that order, found by two binary searches; all occurrences
are edges, sorted by position (a counting sort into a table by position and length), and each part's segmentation is
relaxed over its own edges: byte-pair models join, again and again, the adjacent pair whose
edge has the best rank (the leftmost of equals), which gives the ids of the sentencepiece library.
Characters without a piece become byte pieces.

Defined results: a null text stays null on encoding, an empty text has no ids; decoding returns
the text for every text (but for a dummy space before it, as in the library); repeated rows
are encoded alike; extra columns pass through, those named like an added column are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, quoted
from .tokens import held, path_of

SPACE = "▁"
#: Characters in one index, the distinct parts held in memory, and the length of a part that is held.
INDEX_CHARS, HELD_PARTS, HELD_CHARS = 150_000, 200_000, 48
#: Parts of up to this length are relaxed together, a pair of each in a round; longer ones by a queue.
SHORT = 64


def suffix_order(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by the ``depth`` characters that begin there, and these keys in order."""
    padded = np.concatenate([codes, np.zeros(depth, codes.dtype)]).astype(">u4")
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[: len(codes)]).view(f"S{4 * depth}").reshape(-1)
    order = np.argsort(keys, kind="stable")
    return order, keys[order]


class Matcher:
    """A byte-pair model's pieces, matched through suffix arrays."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path or path_of("piece_bpe_32k.model"))
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id_of = {model.id_to_piece(i): i for i in plain}
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        # place of each piece's score, the best first; the last entry, also index -1, is no piece
        scores = np.array([model.get_score(i) for i in plain])
        best = -np.unique(-scores)
        self.order = np.full(model.get_piece_size() + 1, len(best), np.int64)
        self.order[plain] = np.searchsorted(-best, -scores)
        self.depth = max(map(len, self.id_of))
        pieces = [p for p in self.id_of if len(p) > 1]
        self.pieces = np.array([self.id_of[p] for p in pieces])
        self.lengths = np.array([len(p) for p in pieces])
        self.low = np.array([p.encode("utf-32-be") for p in pieces], f"S{4 * self.depth}")
        self.high = np.array([p.encode("utf-32-be") + b"\xff" * 4 * (self.depth - len(p)) for p in pieces], f"S{4 * self.depth}")
        inner = {c for p in pieces for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece reaches over a space")
        # a part is a run of spaces and what follows, up to the next; a line end is in no longer piece
        self.parts = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if "\n" not in inner else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.memory: dict[str, bytes] = {}

    def edges(self, text: str) -> np.ndarray:
        """table[position, length]: the piece of two characters or more that occurs there, or -1.

        The occurrences of all pieces, put in order of position.
        """
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        order, keys = suffix_order(codes, self.depth)
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        sizes = hi - lo
        found = np.flatnonzero(sizes > 0)
        reps = sizes[found]
        at = order[np.repeat(lo[found] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(int(reps.sum()))]
        table = np.full((len(codes) + 1, self.depth + 1), -1, np.int32)
        table[at, np.repeat(self.lengths[found], reps)] = np.repeat(self.pieces[found], reps)
        return table

    def relax_short(self, table: np.ndarray, first: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> None:
        """Join, a round for all parts at once, each part's best adjacent pair; ``starts`` loses the joined places."""
        at = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        stop, count = at + 1, sizes
        while len(count):
            head = np.concatenate([[0], np.cumsum(count)[:-1]])
            size = np.concatenate([stop[1:], stop[-1:]]) - at
            size[head[1:] - 1], size[-1], size[size > self.depth] = 0, 0, 0  # no pair reaches over a part's end
            place = np.arange(len(at)) - np.repeat(head, count)
            key = self.order[table[at, size]] * SHORT + place  # the leftmost of equals
            best = np.minimum.reduceat(key, head)
            going = best < self.order[-1] * SHORT
            left = head[going] + best[going] % SHORT
            stop[left] = stop[left + 1]
            starts[at[left + 1]] = False
            keep = np.repeat(going, count)
            keep[left + 1] = False
            at, stop, count = at[keep], stop[keep], count[going] - 1

    def relax_long(self, table: np.ndarray, first: int, n: int, starts: np.ndarray) -> None:
        """The same for one part, by a queue of pairs."""
        import heapq

        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive, queue = [True] * n, []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and end[j] - i <= self.depth and (p := table[first + i, end[j] - i]) >= 0:
                heapq.heappush(queue, (int(self.order[p]), i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, mid, stop = heapq.heappop(queue)
            if not alive[i] or end[i] != mid or mid >= n or end[mid] != stop or not alive[mid]:
                continue
            alive[mid] = starts[first + mid] = False
            end[i], after[i] = stop, stop
            if stop < n:
                before[stop] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)

    def segment(self, parts: list[str]) -> list[bytes]:
        """The ids, as little-endian 32-bit integers, of each part of a block."""
        # code 1 parts the texts: no piece has it, as control characters are written in bytes
        text = "\x01".join(parts) + "\x01"
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        table = self.edges(text)
        sizes = np.array([len(p) for p in parts])
        first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        starts = np.ones(len(codes), bool)
        short = sizes <= SHORT
        self.relax_short(table, first[short], sizes[short], starts)
        for k in np.flatnonzero(~short).tolist():
            self.relax_long(table, int(first[k]), int(sizes[k]), starts)
        at = np.flatnonzero(starts)  # the separators start too
        size = np.diff(at, append=len(codes))
        ids = table[at, np.minimum(size, self.depth)]
        one = np.flatnonzero(size == 1)
        chars, which = np.unique(codes[at[one]], return_inverse=True)
        single = np.array([self.id_of.get(chr(c), -1) for c in chars.tolist()], np.int32)
        ids[one] = single[which]
        width = np.ones(len(at), np.int64)
        spelled = [(k, chr(c).encode()) for k, c in enumerate(chars.tolist()) if single[k] < 0]
        for k, utf8 in spelled:
            width[one[which == k]] = len(utf8)
        offset = np.concatenate([[0], np.cumsum(width)])
        out = np.zeros(int(offset[-1]), "<i4")
        out[offset[:-1]] = ids
        for k, utf8 in spelled:
            to = offset[one[which == k]]
            for j, byte in enumerate(utf8):
                out[to + j] = self.bytes[byte]
        blob, cuts = out.tobytes(), (4 * offset[np.searchsorted(at, first)]).tolist()
        ends = (4 * offset[np.searchsorted(at, first + sizes)]).tolist()
        return [blob[a:b] for a, b in zip(cuts, ends, strict=True)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        cut = [None if t is None else self.parts.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        distinct = {p for ps in cut if ps for p in ps}
        new = [p for p in distinct if p not in self.memory]
        full = len(self.memory) + len(new) > HELD_PARTS
        if full and 2 * len(new) > len(distinct):  # other texts than before
            self.memory, new = {}, list(distinct)
        new.sort()
        i = 0
        while i < len(new):
            block, size = [], 0
            while i < len(new) and (not block or size + len(new[i]) < INDEX_CHARS):
                block.append(new[i])
                size += len(new[i]) + 1
                i += 1
            self.memory.update(zip(block, self.segment(block), strict=True))
        known = self.memory.__getitem__
        out = [None if ps is None else np.frombuffer(b"".join(map(known, ps)), "<i4") for ps in cut]
        for p in new:  # frequent parts came early and stay
            if full or len(p) > HELD_CHARS:
                del self.memory[p]
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Pieces joined, runs of byte pieces read as UTF-8, the dummy space taken off.

        Control pieces have no text and ids without a piece (or null) read as U+FFFD.
        """
        if not hasattr(self, "surface"):
            self.surface = {i: p.replace(SPACE, " ").encode() for p, i in self.id_of.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
            self.surface |= {i: b"" for i in range(self.model.get_piece_size()) if self.model.is_control(i)}
        get, unknown = self.surface.get, "\ufffd".encode()
        text = b"".join([get(i, unknown) for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode(df: DataFrame, text_col: str = "text", out: str = "ids", model: str | None = None, decoded: str | None = None) -> DataFrame:
    """df with an array of ids: a map without a shuffle. With ``decoded`` also the text that these ids give, in the same pass."""

    def kernel(texts: pa.Array) -> list[pa.Array]:
        m = held(Matcher, model)
        ids = pa.array(m.encode(texts.to_pylist()), pa.list_(pa.int32()))
        return [ids] if decoded is None else [ids, decode_array(m, ids)]

    fields = [T.StructField(out, T.ArrayType(T.IntegerType()))]
    if decoded is not None:
        fields.append(T.StructField(decoded, T.StringType()))
    return append_columns(df, [F.col(quoted(text_col)).cast("string")], fields, kernel, nbytes=2 << 20)


def decode_array(m: Matcher, ids: pa.Array) -> pa.Array:
    """The text of each list of ids; the ids of one list at a time become Python numbers."""
    return pa.array([m.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in ids], pa.string())


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", model: str | None = None) -> DataFrame:
    """df with the text of each array of ids."""

    def kernel(ids: pa.Array) -> list[pa.Array]:
        return [decode_array(held(Matcher, model), ids)]

    return append_columns(df, [F.col(quoted(ids_col))], [T.StructField(out, T.StringType())], kernel, nbytes=2 << 20)

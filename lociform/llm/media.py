"""Media columns: progressive JPEG.

``decode_progressive`` accumulates spectral-selection and successive-approximation scans into
coefficient arrays, inverse-transforms them in numpy, upsamples chroma and gives
full-resolution RGB. Restart segments of a first DC scan are decoded side by side; runs of one
symbol in a first AC scan and end-of-band runs in a refining scan are decoded as arrays, all
else symbol by symbol.

``encode_payload`` carries any bytes without loss: 192 bytes are the 64 quantised coefficients of a
luma and two chroma blocks (the format's unit), with quantiser 1. The coefficient of a byte has a
magnitude of 127 to 255, so each scan of the high bits is one symbol a coefficient, and
the low bits follow in refining scans. The picture is valid, and not meant to be looked at.

Defined results: a null or empty payload is 192 bytes 32; equal payloads give equal media;
null media give nulls; broken media raise ValueError; extra columns pass through,
those named like an added column are replaced.
"""

from __future__ import annotations

import functools
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, quoted

UNIT = 192


def zigzag() -> np.ndarray:
    """Natural index of each zigzag position: diagonals, in turn up and down."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in order])


@functools.cache
def inverse_transform() -> np.ndarray:
    """Zigzag coefficients to 64 samples, as one matrix."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)
    return np.ascontiguousarray(np.kron(c, c)[zigzag()].astype(np.float32))


@functools.lru_cache(64)
def huffman(spec: bytes) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[int, int]]]:
    """By the next 16 bits: code length (0: none) and symbol; by symbol: (code, length)."""
    lengths, symbols, codes = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8), {}
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(spec[n - 1]):
            span = 1 << (16 - n)
            lengths[code * span : (code + 1) * span], symbols[code * span : (code + 1) * span] = n, spec[at]
            codes.setdefault(spec[at], (code, n))
            code, at = code + 1, at + 1
        code <<= 1
    return lengths, symbols, codes


class Bits:
    """Bits of an unstuffed segment; ones follow its end."""

    def __init__(self, data: bytes):
        self.data, self.at = data + b"\xff" * 8, 0

    def peek16(self) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 3].ljust(3, b"\xff"), "big") >> (8 - (self.at & 7)) & 0xFFFF

    def read(self, n: int) -> int:
        out = self.peek16() >> (16 - n) if n else 0
        self.at += n
        return out

    def symbol(self, table) -> int:
        v = self.peek16()
        n = int(table[0][v])
        if not n or self.at > 8 * len(self.data):
            raise ValueError("no such code")
        self.at += n
        return int(table[1][v])

    def array(self, n: int) -> np.ndarray:
        first = self.at >> 3
        raw = np.frombuffer(self.data, np.uint8, -(-(self.at + n) // 8) - first, first)
        out = np.unpackbits(raw)[self.at & 7 : (self.at & 7) + n]
        if len(out) < n:
            raise ValueError("the scan ends early")
        self.at += n
        return out


def extend(v: int, s: int) -> int:
    return v if s == 0 or v >> (s - 1) else v - (1 << s) + 1


class Picture:
    def __init__(self):
        self.quant, self.dc, self.ac, self.restart, self.comment = {}, {}, {}, 0, b""
        self.components: list[dict] = []

    def frame(self, seg: bytes) -> None:
        bits, self.height, self.width, n = struct.unpack(">BHHB", seg[:6])
        if bits != 8 or n not in (1, 3) or not self.height or not self.width:
            raise ValueError("only 8-bit pictures of one or three components")
        for i in range(n):
            c, hv, q = seg[6 + 3 * i : 9 + 3 * i]
            self.components.append({"id": c, "h": hv >> 4, "v": hv & 15, "q": q})
        self.hmax, self.vmax = max(c["h"] for c in self.components), max(c["v"] for c in self.components)
        self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c in self.components:
            c["coef"] = np.zeros((self.down * c["v"], self.across * c["h"], 64), np.int16)
            c["rows"] = -(-(-(-self.height * c["v"] // self.vmax)) // 8)
            c["cols"] = -(-(-(-self.width * c["h"] // self.hmax)) // 8)

    def order(self, chosen: list[int]) -> tuple[list[np.ndarray], int]:
        """For each component of a scan the numbers of its blocks, (units, blocks a unit), and the units."""
        if len(chosen) == 1:
            c = self.components[chosen[0]]
            wide = c["coef"].shape[1]
            if wide == c["cols"]:
                return [np.arange(c["rows"] * wide)[:, None]], c["rows"] * wide
            return [(np.arange(c["rows"])[:, None] * wide + np.arange(c["cols"])).reshape(-1, 1)], c["rows"] * c["cols"]
        out, units = [], self.down * self.across
        for k in chosen:
            c = self.components[k]
            if c["h"] == c["v"] == 1:
                out.append(np.arange(units)[:, None])
                continue
            wide = c["coef"].shape[1]
            unit = np.arange(self.down)[:, None] * c["v"] * wide + np.arange(self.across) * c["h"]
            inner = np.arange(c["v"])[:, None] * wide + np.arange(c["h"])
            out.append(unit.reshape(-1, 1) + inner.reshape(1, -1))
        return out, units

    def blocks(self, k: int) -> np.ndarray:
        return self.components[k]["coef"].reshape(-1, 64)

    def scan(self, head: bytes, segments: list[bytes]) -> None:
        n = head[0]
        chosen, tables = [], []
        for i in range(n):
            chosen.append(next(k for k, c in enumerate(self.components) if c["id"] == head[1 + 2 * i]))
            tables.append(head[2 + 2 * i])
        first, last, approx = head[1 + 2 * n : 4 + 2 * n]
        high, low = approx >> 4, approx & 15
        places, units = self.order(chosen)
        each = self.restart or units
        if len(segments) != max(1, -(-units // each)):
            raise ValueError("restart markers are missing")
        if first == 0:
            if last:
                raise ValueError("a progressive scan of DC has no AC")
            if high:
                self.refine_dc(chosen, places, segments, each, low)
            elif len(segments) > 8:
                self.first_dc_lanes(chosen, [self.dc[t >> 4] for t in tables], places, segments, each, low)
            else:
                self.first_dc(chosen, [self.dc[t >> 4] for t in tables], places, segments, each, low)
            return
        if n != 1:
            raise ValueError("AC scans have one component")
        flat, at, table = self.blocks(chosen[0]), places[0][:, 0], self.ac[tables[0] & 15]
        whole = len(at) == len(flat)
        blocks = flat if whole else flat[at]
        for k, seg in enumerate(segments):
            part = blocks[k * each : (k + 1) * each]
            (self.refine_ac if high else self.first_ac)(part, Bits(seg), table, first, last, low)
        if not whole:
            flat[at] = blocks

    def first_dc(self, chosen, tables, places, segments, each, low) -> None:
        for k, seg in enumerate(segments):
            bits, was = Bits(seg), [0] * len(chosen)
            for u in range(k * each, min((k + 1) * each, len(places[0]))):
                for i, c in enumerate(chosen):
                    for q in places[i][u].tolist():
                        s = bits.symbol(tables[i])
                        was[i] += extend(bits.read(s), s)
                        self.blocks(c)[q, 0] = was[i] << low

    def first_dc_lanes(self, chosen, tables, places, segments, each, low) -> None:
        """Segments begin anew, so they are decoded side by side, one array element each."""
        size = np.array([len(s) for s in segments])
        base = np.concatenate([[0], np.cumsum(size[:-1] + 4)])
        data = np.frombuffer(b"\xff\xff\xff\xff".join(segments) + b"\xff" * 8, np.uint8).astype(np.uint32)
        at, lanes, units = base * 8, np.arange(len(segments)), len(places[0])
        was = [np.zeros(len(segments), np.int64) for _ in chosen]

        def peek() -> np.ndarray:
            i = at[lanes] >> 3
            return (data[i] << 16 | data[i + 1] << 8 | data[i + 2]) >> (8 - (at[lanes] & 7)).astype(np.uint32) & 0xFFFF

        for step in range(each):
            lanes = lanes[lanes * each + step < units]
            for i, c in enumerate(chosen):
                for b in range(places[i].shape[1]):
                    v = peek()
                    length, s = tables[i][0][v].astype(np.int64), tables[i][1][v].astype(np.int64)
                    if not length.all():
                        raise ValueError("no such code")
                    at[lanes] += length
                    v = peek().astype(np.int64) >> (16 - s)
                    at[lanes] += s
                    was[i][lanes] += np.where((s > 0) & (v < (1 << np.maximum(s - 1, 0))), v - (1 << s) + 1, v)
                    self.blocks(c)[places[i][lanes * each + step, b], 0] = was[i][lanes] << low
        if (at > (base + size) * 8).any():
            raise ValueError("the scan ends early")

    def refine_dc(self, chosen, places, segments, each, low) -> None:
        sizes = [p.shape[1] for p in places]
        for k, seg in enumerate(segments):
            part = slice(k * each, (k + 1) * each)
            units = len(places[0][part])
            bits = Bits(seg).array(units * sum(sizes)).astype(np.int16).reshape(units, -1) << low
            at = 0
            for c, p, n in zip(chosen, places, sizes, strict=True):
                self.blocks(c)[p[part], 0] |= bits[:, at : at + n]
                at += n

    @staticmethod
    def first_ac(blocks: np.ndarray, bits: Bits, table, first: int, last: int, low: int) -> None:
        n, band = len(blocks), last - first + 1
        v = bits.peek16()
        length, symbol = int(table[0][v]), int(table[1][v])
        if length and 0 < symbol < 16 and length + symbol == 8 and 8 * len(bits.data) >= n * band * 8 + 64:
            # perhaps every coefficient has this symbol: then each is one byte, code and value
            raw = np.frombuffer(bits.data, np.uint8, n * band)
            if ((raw >> symbol) == table[2][symbol][0]).all():
                value = (raw & ((1 << symbol) - 1)).astype(np.int16)
                value = np.where(value >> (symbol - 1) != 0, value, value - (1 << symbol) + 1) << low
                blocks[:, first : last + 1] = value.reshape(n, band)
                return
        run = 0
        for block in blocks:
            if run:
                run -= 1
                continue
            k = first
            while k <= last:
                rs = bits.symbol(table)
                r, s = rs >> 4, rs & 15
                if s:
                    k += r
                    if k > last:
                        raise ValueError("a run leaves its band")
                    block[k] = extend(bits.read(s), s) << low
                    k += 1
                elif r == 15:
                    k += 16
                else:
                    run = (1 << r) + bits.read(r) - 1
                    break

    @staticmethod
    def refine_ac(blocks: np.ndarray, bits: Bits, table, first: int, last: int, low: int) -> None:
        step = 1 << low

        def correct(part: np.ndarray) -> None:
            """A bit for each coefficient that is not zero, in order."""
            on = part != 0
            more = bits.array(int(on.sum())).astype(np.int16) * step
            part[on] += np.where(part[on] > 0, more, -more)

        i = 0
        while i < len(blocks):
            block, k, run = blocks[i], first, -1
            while k <= last:
                rs = bits.symbol(table)
                r, s = rs >> 4, rs & 15
                value = 0
                if s:
                    value = step if bits.read(1) else -step
                elif r < 15:
                    run = (1 << r) + bits.read(r)
                    break
                start = k  # pass r zeros (and the place of the new value), correcting what is not zero
                zeros = np.flatnonzero(block[k : last + 1] == 0)
                if len(zeros) > r:
                    k += int(zeros[r])
                elif value:
                    raise ValueError("a run leaves its band")
                else:
                    k = last
                correct(block[start:k] if value or len(zeros) > r else block[start : last + 1])
                if value:
                    block[k] = value
                k += 1
            if run < 0:
                i += 1
                continue
            correct(block[k : last + 1])
            rest = blocks[i + 1 : i + run, first : last + 1]
            if len(rest) < run - 1:
                raise ValueError("a run leaves its scan")
            if run > 1:
                correct(rest)
            i += run

    def rgb(self) -> np.ndarray:
        planes = []
        for c in self.components:
            rows, cols, _ = c["coef"].shape
            samples = (c["coef"].reshape(-1, 64) * self.quant[c["q"]]).astype(np.float32) @ inverse_transform() + np.float32(128)
            plane = samples.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
            v, h = self.vmax // c["v"], self.hmax // c["h"]
            if v > 1 or h > 1:
                plane = plane.repeat(v, axis=0).repeat(h, axis=1)
            plane = np.rint(plane[: self.height, : self.width])
            planes.append(np.clip(plane, 0, 255, out=plane))
        if len(planes) == 1:
            return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, axis=2)
        y, b, r = planes
        b -= np.float32(128)
        r -= np.float32(128)
        out = np.empty((*y.shape, 3), np.uint8)
        for k, (cb, cr) in enumerate(((0, 1.402), (-0.344136, -0.714136), (1.772, 0))):
            v = y + np.float32(cr) * r if cr else y + np.float32(cb) * b
            if cb and cr:
                v += np.float32(cb) * b
            np.rint(v, out=v)
            out[:, :, k] = np.clip(v, 0, 255, out=v)
        return out


def decode_progressive(data: bytes) -> Picture:
    """The picture of a progressive JPEG, its coefficients accumulated."""
    try:
        return _decode(data)
    except (struct.error, IndexError, KeyError, StopIteration) as broken:
        raise ValueError(f"broken JPEG: {broken!r}") from broken


def _decode(data: bytes) -> Picture:
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    p, at = Picture(), 2
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("no marker")
        kind = data[at + 1]
        if kind == 0xD9:
            return p
        (size,) = struct.unpack_from(">H", data, at + 2)
        seg, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while seg:
                wide = seg[0] >> 4
                p.quant[seg[0] & 15] = np.frombuffer(seg, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                seg = seg[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while seg:
                n = 17 + sum(seg[1:17])
                (p.ac if seg[0] >> 4 else p.dc)[seg[0] & 15] = huffman(bytes(seg[1:n]))
                seg = seg[n:]
        elif kind == 0xC2:
            p.frame(seg)
        elif kind == 0xDD:
            (p.restart,) = struct.unpack(">H", seg)
        elif kind == 0xFE:
            p.comment = seg
        elif kind == 0xDA:
            segments, start = [], at
            while True:
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    raise ValueError("the scan has no end")
                if data[at + 1] == 0:
                    at += 2
                elif 0xD0 <= data[at + 1] <= 0xD7:
                    segments.append(data[start:at])
                    start = at = at + 2
                else:
                    break
            segments.append(data[start:at])
            p.scan(seg, [s.replace(b"\xff\x00", b"\xff") for s in segments])
        elif kind in (0xC0, 0xC1, *range(0xC3, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a progressive Huffman-coded JPEG")


def marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def table(kind: int, codes: dict[int, list[int]]) -> bytes:
    """A Huffman table segment; codes: symbols by code length."""
    return marker(0xC4, bytes([kind, *(len(codes.get(n, [])) for n in range(1, 17)), *(s for n in range(1, 17) for s in codes.get(n, []))]))


#: Tables: size 7 in one bit, for DC and first AC; end-of-band runs in four bits.
HIGH_DC, HIGH_AC, LOW_AC = table(0x00, {1: [7]}), table(0x10, {1: [7]}), table(0x11, {4: [n << 4 for n in range(15)]})


def pad(data: bytes) -> bytes:
    """data with bytes 32 up to a positive multiple of UNIT."""
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


def coefficients(payload: np.ndarray) -> np.ndarray:
    """(units, 3, 64): a byte's top bit is the sign, the others the magnitude over 128; DC is offset by one below zero,
    as its point transform rounds down."""
    b = payload.reshape(-1, 3, 64).astype(np.int16)
    c = np.where(b >= 128, b, -128 - b)
    c[:, :, 0] = np.where(b[:, :, 0] >= 128, b[:, :, 0], b[:, :, 0] - 254)
    return c


def payload_of(p: Picture) -> bytes:
    """The bytes that encode_payload stored."""
    if not p.comment.startswith(b"payload="):
        raise ValueError("no payload")
    c = np.stack([x["coef"].reshape(-1, 64) for x in p.components], axis=1)
    b = np.where(c >= 0, c, -128 - c)
    b[:, :, 0] = np.where(c[:, :, 0] >= 0, c[:, :, 0], c[:, :, 0] + 254)
    return b.astype(np.uint8).tobytes()[: int(p.comment[8:])]


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG of a multiple of UNIT bytes: DC high bits with a restart after every unit,
    DC low bits, then for each component AC high bits and AC low bits."""
    units = len(payload) // UNIT
    wide = min(units, 1024)
    tall = -(-units // wide)
    raw = np.full(wide * tall * UNIT, 32, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    c = coefficients(raw)
    n = len(c)
    out = [b"\xff\xd8", marker(0xFE, b"payload=%d" % len(payload)), marker(0xDB, b"\x00" + b"\x01" * 64)]
    out += [marker(0xC2, struct.pack(">BHHB", 8, 8 * tall, 8 * wide, 3) + b"".join(bytes([i, 0x11, 0]) for i in (1, 2, 3)))]
    out += [HIGH_DC, HIGH_AC, LOW_AC]
    stuffed = lambda bits: np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")
    every = b"\x03\x01\x00\x02\x00\x03\x00"
    high = c[:, :, 0] >> 1
    rows = np.empty((n, 5), np.uint8)
    rows[:, :3] = np.where(high > 0, high, high + 127)
    rows[:, 3], rows[:, 4] = 0xFF, 0xD0 + np.arange(n) % 8
    out += [marker(0xDD, b"\x00\x01"), marker(0xDA, every + b"\x00\x00\x01"), rows.tobytes()[:-2], marker(0xDD, b"\x00\x00")]
    out += [marker(0xDA, every + b"\x00\x00\x10"), stuffed((c[:, :, 0] & 1).astype(np.uint8).reshape(-1))]
    for k in range(3):
        ac = c[:, k, 1:]
        size = np.abs(ac)
        out += [marker(0xDA, bytes([1, k + 1, 0x00, 1, 63, 0x01])), np.where(ac > 0, size >> 1, 127 - (size >> 1)).astype(np.uint8).tobytes()]
        low, bits = (size & 1).astype(np.uint8), []
        for i in range(0, n, 32767):
            part = low[i : i + 32767]
            r = len(part).bit_length() - 1
            head = (r << r) | (len(part) - (1 << r))
            bits += [np.array([head >> (3 + r - j) & 1 for j in range(4 + r)], np.uint8), part.reshape(-1)]
        out += [marker(0xDA, bytes([1, k + 1, 0x01, 1, 63, 0x10])), stuffed(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


def store(df: DataFrame, payload, out: str = "media") -> DataFrame:
    """df with a binary expression stored as progressive JPEG."""

    def kernel(data: pa.Array) -> list[pa.Array]:
        return [pa.array([encode_payload(pad(x or b"")) for x in data.to_pylist()], pa.binary())]

    return append_columns(df, [payload], [T.StructField(out, T.BinaryType())], kernel, rows=256, nbytes=1 << 20)


def features(rgb: np.ndarray) -> str:
    """Size, and the whole-number mean and mean square of each channel."""
    flat = rgb.reshape(-1, 3)
    sums = flat.sum(axis=0, dtype=np.int64)
    grey = flat[:, 1]
    counts = np.bincount(grey >> 5, minlength=8)
    return f"{rgb.shape[1]}x{rgb.shape[0]};mean=" + ",".join(str(int(s) // len(flat)) for s in sums) + ";green=" + ",".join(map(str, counts * 1000 // len(flat)))


def decode(df: DataFrame, media_col: str = "media", payload: bool = False, tensor: bool = True) -> DataFrame:
    """df with width, height, feature and, if asked for, rgb (height x width x 3 bytes) and payload."""
    fields = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("feature", T.StringType())]
    fields += [T.StructField("rgb", T.BinaryType())] * tensor + [T.StructField("payload", T.BinaryType())] * payload

    def kernel(media: pa.Array) -> list[pa.Array]:
        columns: list[list] = [[] for _ in fields]
        for data in media.to_pylist():
            if data is None:
                row = [None] * len(fields)
            else:
                p = decode_progressive(data)
                rgb = p.rgb()
                row = [p.width, p.height, features(rgb)] + [rgb.tobytes()] * tensor
                row += [payload_of(p)] if payload else []
            for c, x in zip(columns, row, strict=True):
                c.append(x)
        types = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
        return [pa.array(c, t) for c, t in zip(columns, types, strict=False)]

    return append_columns(df, [F.col(quoted(media_col))], fields, kernel, rows=256, nbytes=1 << 20)

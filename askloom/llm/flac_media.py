"""Media columns: FLAC streams in a binary column, decoded to PCM blocks with seekable sample offsets.

Encoder: mono, 8 bits, blocks of 1152 samples (the last one shorter), each the cheapest of constant, verbatim, fixed
predictors of order 0 to 2 and a linear predictor of order 4, residuals in Rice codes; a seek table has every frame.
Decoder: mono streams of 4 to 16 bits with any of FLAC's subframe types, orders, partition orders, both Rice parameter
sizes, escaped partitions and wasted bits; the header's CRC-8 and the frame's CRC-16 are verified. With a seek table
that has every frame, the frames of many streams are decoded at once, one sample of all of them a step; other streams
go frame by frame.

Decoded streams are written as PCM blocks with the offset of their first sample, and whatever is told of a payload, its
digest, its features and its last bytes, is read from those blocks: the last bytes by their offset, from the blocks that
hold them.

A text's payload is its UTF-8 with bytes 32 up to a positive multiple of 192; a byte b is the sample b - 128.

Defined results: doc_ids are whole numbers or null; null text is the empty text, whose payload is 192 bytes 32; equal texts have equal streams; repeated
rows each give a row; an empty table gives an empty table; other columns are ignored; a damaged stream raises.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import steps, table, tidy, utf8

UNIT, BLOCK, LPC_ORDER, PRECISION, RATE, AT_ONCE = 192, 1152, 4, 10, 8000, 2048
#: Fixed values of the format: block sizes by code, bits a sample by code.
_BLOCK_CODES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
_BITS_CODES = {1: 8, 2: 12, 4: 16}


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = ((out << 1) ^ np.where(out >> (bits - 1) & 1, poly, 0)) & ((1 << bits) - 1)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of many stretches of data, a byte of all of them a step."""
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    crc = np.zeros(len(at), np.int64)
    active = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
    for j, n in enumerate(active.tolist()):
        now = crc[:n]
        crc[:n] = _CRC16[(now >> 8) ^ data[at[:n] + j]] ^ ((now << 8) & 0xFFFF)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _crc8(fields: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(fields), np.int64)
    for j in range(fields.shape[1]):
        crc = np.where(j < sizes, _CRC8[crc ^ fields[:, j]], crc)
    return crc


# Encoding


def _pack(at: np.ndarray, width: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Bytes with each value's low `width` bits (32 at most) at its bit offset; fields do not overlap."""
    placed = value.astype(np.uint64) << (64 - (at & 31) - width).astype(np.uint64)
    word, n = at >> 5, size // 4 + 2
    # Sums are unions, below 2^53 and so exact as doubles.
    high = np.bincount(word, weights=(placed >> np.uint64(32)).astype(np.float64), minlength=n)
    low = np.bincount(word + 1, weights=(placed & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    return (high[:n] + low[:n]).astype(np.uint64).astype(">u4").view(np.uint8)[:size]


def _coefficients(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors of each row and their shifts, by autocorrelation and Levinson's recursion."""
    n = x.shape[1]
    f = x.astype(np.float32) * np.sin(np.pi * (np.arange(n, dtype=np.float32) + 0.5) / n)
    r = np.stack([np.einsum("ij,ij->i", f[:, k:], f[:, : n - k]) for k in range(order + 1)], axis=1).astype(np.float64)
    r[:, 0] = r[:, 0] * 1.0001 + 1e-6
    a, error = np.zeros((len(x), order)), r[:, 0].copy()
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = (1 << (PRECISION - 1)) - 1
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(np.maximum(np.abs(a).max(axis=1), 1e-9))).astype(np.int64), 0, 15)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -most, most).astype(np.int64), shift


def _rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals, the Rice parameter and the bits of each row."""
    folded = (residual << 1) ^ (residual >> 31)
    n = residual.shape[1]
    k = np.clip(np.floor(np.log2(np.maximum(folded.sum(axis=1, dtype=np.int64) * 0.6931 / n, 1))), 0, 14).astype(np.int64)
    return folded, k, n * (1 + k) + (folded >> k[:, None].astype(np.int32)).sum(axis=1, dtype=np.int64)


def _number_fields(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the extended UTF-8 form: seven columns of bytes, and how many count."""
    size = np.ones(len(number), np.int64)
    for n, bits in ((2, 7), (3, 11), (4, 16), (5, 21), (6, 26), (7, 31)):
        size[number >> bits > 0] = n
    out = np.zeros((len(number), 7), np.int64)
    for n in range(1, 8):
        some = size == n
        if n == 1:
            out[some, 0] = number[some]
            continue
        for j in range(n):
            part = number[some] >> (6 * (n - 1 - j))
            out[some, j] = ((0xFF << (8 - n)) & 0xFF | part) if j == 0 else 0x80 | (part & 0x3F)
    return out, size


def _encode_frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of equal block size: their bytes one after another, and where each starts."""
    m, n = x.shape
    code = {v: k for k, v in _BLOCK_CODES.items()}.get(n, 7)
    utf, size = _number_fields(number)
    head = np.zeros((m, 13), np.int64)
    head[:, 0], head[:, 1], head[:, 2], head[:, 3] = 0xFF, 0xF8, code << 4 | 4, 1 << 1
    head[:, 4:11] = utf
    size = size + 4
    if code == 7:
        rows = np.arange(m)
        head[rows, size], head[rows, size + 1] = (n - 1) >> 8, (n - 1) & 0xFF
        size = size + 2
    head = np.concatenate([head, np.zeros((m, 2), np.int64)], axis=1)
    head[np.arange(m), size] = _crc8(head[:, :-2], size)
    size = size + 1
    # The cheapest way for each frame: 0 constant, 1 verbatim, 8 + order fixed, 32 + order - 1 linear.
    best = np.full(m, 8 * n, np.int64)
    kind = np.ones(m, np.int64)
    folded, k = np.zeros((m, n), np.int32), np.zeros(m, np.int64)
    residual = x
    for order in range(min(3, n)):
        if order:
            residual = residual[:, 1:] - residual[:, :-1]
        got, kk, bits = _rice(residual)
        some = np.flatnonzero(bits + 8 * order + 10 < best)
        best[some], kind[some], k[some] = bits[some] + 8 * order + 10, 8 + order, kk[some]
        folded[some, order:] = got[some]
    coefficients, shift = _coefficients(x, LPC_ORDER)
    if n > LPC_ORDER:
        predicted = sum(coefficients[:, j, None].astype(np.int32) * x[:, LPC_ORDER - 1 - j : n - 1 - j] for j in range(LPC_ORDER)) >> shift[:, None].astype(np.int32)
        got, kk, bits = _rice(x[:, LPC_ORDER:] - predicted)
        bits += 8 * LPC_ORDER + 10 + 9 + LPC_ORDER * PRECISION
        some = np.flatnonzero(bits < best)
        best[some], kind[some], k[some] = bits[some], 32 + LPC_ORDER - 1, kk[some]
        folded[some, LPC_ORDER:] = got[some]
    still = (x == x[:, :1]).all(axis=1)
    kind[still], best[still] = 0, 8
    body_at = 8 * size + 8
    bytes_ = (body_at + best + 7) // 8 + 2
    starts = np.cumsum(bytes_) - bytes_
    at, width, value = [], [], []

    def put(rows: np.ndarray, offset: np.ndarray, bits: np.ndarray | int, what: np.ndarray) -> None:
        place = 8 * starts[rows][:, None] + offset if offset.ndim == 2 else 8 * starts[rows] + offset
        at.append(place.ravel())
        width.append(np.broadcast_to(bits, place.shape).ravel().astype(np.int64))
        value.append((np.broadcast_to(what, place.shape).astype(np.int64) & ((np.int64(1) << np.broadcast_to(bits, place.shape)) - 1)).ravel())

    every = np.arange(m)
    for j in range(head.shape[1]):
        some = every[j < size]
        put(some, np.full(len(some), 8 * j), 8, head[some, j])
    put(every, 8 * size, 8, kind << 1)
    some = np.flatnonzero(kind == 0)
    put(some, body_at[some], 8, x[some, 0])
    some = np.flatnonzero(kind == 1)
    put(some, body_at[some][:, None] + 8 * np.arange(n), 8, x[some])
    for type_, order in [(8, 0), (9, 1), (10, 2), (32 + LPC_ORDER - 1, LPC_ORDER)]:
        some = np.flatnonzero(kind == type_)
        if not len(some):
            continue
        here = body_at[some]
        put(some, here[:, None] + 8 * np.arange(order), 8, x[some, :order])
        here = here + 8 * order
        if type_ >= 32:
            put(some, here, 4, np.full(len(some), PRECISION - 1))
            put(some, here + 4, 5, shift[some])
            put(some, here[:, None] + 9 + PRECISION * np.arange(order), PRECISION, coefficients[some])
            here = here + 9 + PRECISION * order
        put(some, here + 6, 4, k[some])  # method 0 and one partition are zero bits
        here = here + 10
        u, kk = folded[some, order:].astype(np.int64), k[some][:, None]
        unary = u >> kk
        ends = np.cumsum(unary + 1 + kk, axis=1)
        put(some, here[:, None] + ends - kk - 1, kk + 1, (1 << kk) | (u & ((1 << kk) - 1)))
    data = _pack(np.concatenate(at), np.concatenate(width), np.concatenate(value), int(bytes_.sum())).copy()
    crc = crc16(data, starts, bytes_ - 2)
    data[starts + bytes_ - 2], data[starts + bytes_ - 1] = crc >> 8, crc & 0xFF
    return data, np.append(starts, len(data))


def encode(payloads: list[bytes], rate: int = RATE) -> list[bytes]:
    """A FLAC stream of each payload of 8-bit samples (at least one)."""
    sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
    if (sizes < 1).any():
        raise ValueError("a stream has at least one sample")
    samples = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).astype(np.int8)
    counts = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.repeat(np.cumsum(sizes) - sizes, counts) + number * BLOCK
    length = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
    frames: list[bytes] = [b""] * len(owner)
    for n in np.unique(length).tolist():
        mine = np.flatnonzero(length == n)
        for a in range(0, len(mine), AT_ONCE):
            some = mine[a : a + AT_ONCE]
            data, starts = _encode_frames(samples[first[some][:, None] + np.arange(n)].astype(np.int32), number[some])
            held = data.tobytes()
            for i, b, c in zip(some.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                frames[i] = held[b:c]
    out, heads = [], np.append(np.cumsum(counts) - counts, len(owner)).tolist()
    raw = samples.tobytes()
    at = 0
    for i, total in enumerate(sizes.tolist()):
        own = frames[heads[i] : heads[i + 1]]
        lengths = np.fromiter(map(len, own), np.int64, len(own))
        seek = np.zeros(len(own), [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        seek["sample"], seek["offset"], seek["n"] = np.arange(len(own)) * BLOCK, np.cumsum(lengths) - lengths, length[heads[i] : heads[i + 1]]
        info = BLOCK.to_bytes(2, "big") * 2 + int(lengths.min()).to_bytes(3, "big") + int(lengths.max()).to_bytes(3, "big")
        info += (rate << 44 | 0 << 41 | 7 << 36 | total).to_bytes(8, "big") + hashlib.md5(raw[at : at + total]).digest()
        table_ = seek.tobytes()
        # Metadata: stream information, then the seek table in as many blocks as 24-bit lengths take.
        pieces = [table_[a : a + 18 * 900_000] for a in range(0, len(table_), 18 * 900_000)]
        meta = b"\x00" + len(info).to_bytes(3, "big") + info
        meta += b"".join(bytes([3 | 0x80 * (j == len(pieces) - 1)]) + len(p).to_bytes(3, "big") + p for j, p in enumerate(pieces))
        out.append(b"fLaC" + meta + b"".join(own))
        at += total
    return out


# Decoding


class Bits:
    """Bit reads at many places of one buffer at once."""

    def __init__(self, data: np.ndarray):
        body = np.zeros((len(data) + 3) // 4 * 4 + 12, np.uint8)
        body[: len(data)] = data
        words = body.view(">u4").astype(np.uint64)
        self.pairs = (words[:-1] << np.uint64(32)) | words[1:]
        self.last = 32 * (len(self.pairs) - 1)

    def window(self, at: np.ndarray) -> np.ndarray:
        """64 bits from each place on, of which the first 33 hold."""
        at = np.minimum(at, self.last)  # damaged frames may lead beyond the end; their CRC tells
        return self.pairs[at >> 5] << (at & 31).astype(np.uint64)

    def read(self, at: np.ndarray, n) -> np.ndarray:
        """n bits (32 at most, also by place)."""
        n = np.asarray(n, np.uint64)
        return ((self.window(at) >> np.uint64(1)) >> (np.uint64(63) - n)).astype(np.int64)

    def signed(self, at: np.ndarray, n) -> np.ndarray:
        got, n = self.read(at, n), np.asarray(n, np.int64)
        return np.where(n > 0, got - ((got >> np.maximum(n - 1, 0) & 1) << n), 0)


_LEADING = np.full(1 << 16, 16, np.uint64)
for _i in range(16):
    _LEADING[1 << _i : 2 << _i] = 15 - _i


def _rice_run(bits: Bits, at: np.ndarray, k: np.ndarray, n: int, out: np.ndarray) -> np.ndarray:
    """n Rice codes at each place, one of all places a step; returns where they end."""
    ku, left, one, none = k.astype(np.uint64), (63 - k).astype(np.uint64), np.uint64(1), np.uint64(48)
    for j in range(n):
        window = bits.window(at)
        q = _LEADING[window >> none]
        if (q == 16).any():
            long = np.flatnonzero(q == 16)
            while len(long):  # long runs of zeros, 16 at a time
                more = _LEADING[bits.window(at[long] + q[long].astype(np.int64)) >> none]
                q[long] += more
                long = long[(more == 16) & (at[long] + q[long].astype(np.int64) < bits.last)]
            low = bits.read(at + q.astype(np.int64) + 1, ku).astype(np.uint64)
        else:
            low = ((window << (q + one)) >> left) >> one
        out[j] = (q << ku) | low
        at = at + (q + one + ku).astype(np.int64)
    return at


def _residuals(bits: Bits, at: np.ndarray, n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals (n - order, frames) and where they end; frames go by method and partition order."""
    out = np.zeros((n - order, len(at)), np.int64)
    method, parts = bits.read(at, 2), bits.read(at + 2, 4)
    if (method > 1).any():
        raise ValueError("FLAC: unknown residual coding")
    ends = at + 6
    for key in np.unique(method * 16 + parts).tolist():
        some = np.flatnonzero(method * 16 + parts == key)
        size, pos, done = 4 + key // 16, ends[some], 0
        if n >> (key % 16) << (key % 16) != n or n >> (key % 16) < order:
            raise ValueError("FLAC: partitions do not fit the block")
        for part in range(1 << key % 16):
            count = (n >> key % 16) - (order if part == 0 else 0)
            k = bits.read(pos, size)
            pos = pos + size
            raw = k == (1 << size) - 1
            got = np.zeros((count, len(some)), np.uint64)
            plain = np.flatnonzero(~raw)
            if len(plain) == len(some):
                pos = _rice_run(bits, pos, k, count, got)
                got = got.astype(np.int64)
                got = (got >> 1) ^ -(got & 1)
            else:
                rice = np.zeros((count, len(plain)), np.uint64)
                pos[plain] = _rice_run(bits, pos[plain], k[plain], count, rice)
                rice, got = rice.astype(np.int64), got.astype(np.int64)
                got[:, plain] = (rice >> 1) ^ -(rice & 1)
                other = np.flatnonzero(raw)
                width = bits.read(pos[other], 5)
                pos[other] += 5
                for j in range(count):
                    got[j, other] = bits.signed(pos[other], width)
                    pos[other] += width
            out[done : done + count, some] = got
            done += count
        ends[some] = pos
    return out, ends


def _subframes(bits: Bits, at: np.ndarray, type_: int, depth: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples (n, frames) of subframes of one type and block size, and where they end."""
    if type_ == 0:
        return np.broadcast_to(bits.signed(at, depth), (n, len(at))), at + depth
    if type_ == 1:
        return np.stack([bits.signed(at + j * depth, depth) for j in range(n)]), at + n * depth
    order = type_ - 8 if type_ < 32 else type_ - 31
    if not (8 <= type_ <= 12 or type_ >= 32) or order > n:
        raise ValueError("FLAC: unknown subframe")
    out = np.zeros((n, len(at)), np.int64)
    for j in range(order):
        out[j] = bits.signed(at + j * depth, depth)
    at = at + order * depth
    if type_ < 32:
        rest, at = _residuals(bits, at, n, order)
        start = out[:order].copy()
        for level in range(order, 0, -1):  # sums undo differences, from the highest order down
            lead = np.diff(start, n=level - 1, axis=0)[0] if level > 1 else start[0]
            rest = np.cumsum(np.concatenate([lead[None], rest]), axis=0)
        return rest, at
    precision = bits.read(at, 4) + 1
    if (precision == 16).any():
        raise ValueError("FLAC: unknown precision")
    shift = bits.signed(at + 4, 5)
    at = at + 9
    coefficients = [bits.signed(at + j * precision, precision) for j in range(order)]
    out[order:], at = _residuals(bits, at + order * precision, n, order)
    shift = np.maximum(shift, 0)
    for i in range(order, n):
        total = coefficients[0] * out[i - 1]
        for j in range(1, order):
            total += coefficients[j] * out[i - 1 - j]
        out[i] += total >> shift
    return out, at


def decode_frames(data: np.ndarray, bits: Bits, starts: np.ndarray, depth: int = 8) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Samples, coded numbers and ends of the frames that start at these bytes; both CRCs are verified."""
    padded = np.concatenate([data, np.zeros(20, np.uint8)]).astype(np.int64)
    head = padded[starts[:, None] + np.arange(17)]
    if ((head[:, 0] != 0xFF) | (head[:, 1] & 0xFE != 0xF8)).any():
        raise ValueError("FLAC: no frame here")
    code, rate, channels, size_code = head[:, 2] >> 4, head[:, 2] & 15, head[:, 3] >> 4, head[:, 3] >> 1 & 7
    if channels.any():
        raise ValueError("FLAC: only mono streams are decoded")
    lead = head[:, 4]
    extra = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    number = np.where(extra == 0, lead, lead & (0x3F >> extra))
    for j in range(1, 7):
        number = np.where(j <= extra, number << 6 | (head[:, 4 + j] & 0x3F), number)
    at, rows = 5 + extra, np.arange(len(starts))
    n = np.zeros(len(starts), np.int64)
    for c, size in _BLOCK_CODES.items():
        n[code == c] = size
    n = np.where(code == 6, head[rows, at] + 1, np.where(code == 7, (head[rows, at] << 8) + head[rows, at + 1] + 1, n))
    if (n == 0).any():
        raise ValueError("FLAC: unknown block size")
    at = at + (code == 6) + 2 * (code == 7) + (rate == 12) + 2 * ((rate == 13) | (rate == 14))
    if (_crc8(head, at) != head[rows, at]).any():
        raise ValueError("FLAC: a header's CRC-8 is wrong")
    width = np.full(len(starts), depth, np.int64)
    for c, size in _BITS_CODES.items():
        width[size_code == c] = size
    pos = 8 * (starts + at + 1)
    type_, wasted = bits.read(pos, 7), bits.read(pos + 7, 1)
    pos = pos + 8
    if wasted.any():
        some = np.flatnonzero(wasted)
        zeros = _LEADING[bits.window(pos[some]) >> np.uint64(48)].astype(np.int64)
        wasted[some], pos[some] = zeros + 1, pos[some] + zeros + 1
    out: list[np.ndarray] = [np.empty(0)] * len(starts)
    ends = np.zeros(len(starts), np.int64)
    group = type_ << 20 | n
    for key in np.unique(group).tolist():
        mine = np.flatnonzero(group == key)
        for a in range(0, len(mine), AT_ONCE):
            some = mine[a : a + AT_ONCE]
            samples, end = _subframes(bits, pos[some], key >> 20, width[some] - wasted[some], key & 0xFFFFF)
            ends[some] = (end + 7) // 8
            samples = np.ascontiguousarray((samples << wasted[some]).T, dtype=np.int16)
            for i, x in zip(some.tolist(), samples, strict=True):
                out[i] = x
    if (ends + 2 > len(data)).any() or (crc16(data, starts, ends - starts) != (padded[np.minimum(ends, len(data))] << 8 | padded[np.minimum(ends + 1, len(data))])).any():
        raise ValueError("FLAC: a frame's CRC-16 is wrong")
    return out, number, ends + 2


def stream_info(stream: bytes) -> tuple[dict, np.ndarray, int]:
    """STREAMINFO, the seek points in use and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("FLAC: no stream marker")
    at, info, points, last = 4, {}, [], False
    while not last:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        last, body = bool(kind & 0x80), stream[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"block": int.from_bytes(body[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind & 0x7F == 3:
            points.append(np.frombuffer(body, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        at += 4 + size
    seek = np.concatenate(points) if points else np.zeros(0, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
    return info, seek[seek["sample"] != 0xFFFFFFFFFFFFFFFF], at


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of each stream."""
    infos = [stream_info(s) for s in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    bits = Bits(data)
    base = np.cumsum([0, *map(len, streams)])
    # Streams with seek points for all their samples; all frames of these are decoded together.
    whole = [i for i, (info, seek, _) in enumerate(infos) if info["bits"] == 8 and len(seek) and int(seek["n"].astype(np.int64).sum()) == info["samples"] and info["samples"]]
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(streams)
    if whole:
        starts = np.concatenate([infos[i][1]["offset"].astype(np.int64) + base[i] + infos[i][2] for i in whole])
        got, _, _ = decode_frames(data, bits, starts)
        at = 0
        for i in whole:
            n = len(infos[i][1])
            out[i] = np.concatenate(got[at : at + n])
            at += n
    for i in sorted(set(range(len(streams))) - set(whole)):
        info, _, first = infos[i]
        at, parts = first + base[i], []
        while at < base[i + 1] and (not info["samples"] or sum(map(len, parts)) < info["samples"]):
            got, _, end = decode_frames(data, bits, np.array([at]), info["bits"])
            parts.append(got[0])
            at = int(end[0])
        out[i] = np.concatenate(parts) if parts else out[i]
    for (info, _, _), x in zip(infos, out, strict=True):
        if info["samples"] and len(x) != info["samples"]:
            raise ValueError("FLAC: samples are missing")
        if any(info["md5"]) and info["bits"] == 8 and hashlib.md5(x.astype(np.int8).tobytes()).digest() != info["md5"]:
            raise ValueError("FLAC: the samples' MD5 is wrong")
    return out


def seek(stream: bytes, sample: int) -> tuple[int, np.ndarray]:
    """The first sample's offset and the samples of the block that holds `sample`, without decoding what is before."""
    info, points, first = stream_info(stream)
    if not 0 <= sample < info["samples"]:
        raise IndexError(sample)
    data = np.frombuffer(stream, np.uint8)
    bits, at, offset = Bits(data), first, 0
    if len(points):
        i = int(np.searchsorted(points["sample"].astype(np.int64), sample, side="right")) - 1
        if i >= 0:
            at, offset = first + int(points["offset"][i]), int(points["sample"][i])
    while True:
        got, _, end = decode_frames(data, bits, np.array([at]), info["bits"])
        if offset + len(got[0]) > sample:
            return offset, got[0]
        offset, at = offset + len(got[0]), int(end[0])


# Columns


def payload(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text", 4 << 20):
        texts = utf8(batch, "text")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode([payload(t) for t in texts]), pa.binary())], names=["doc_id", "n_bytes", "media"])


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a FLAC stream of the text's payload) of every row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(tidy(_encoded), "doc_id long, n_bytes long, media binary")


@dataclass
class Pcm:
    """The PCM blocks of one stream, each with the offset of its first sample."""

    bits: int
    offsets: np.ndarray
    sizes: np.ndarray
    blocks: list[bytes]

    @staticmethod
    def of(stream: bytes, samples: np.ndarray) -> Pcm:
        """Cut where the seek table's frames begin, or else every block's length."""
        info, points, _ = stream_info(stream)
        cuts = np.append(points["sample"].astype(np.int64) if len(points) else np.arange(0, len(samples), info["block"]), len(samples))
        kind = np.int8 if info["bits"] <= 8 else np.dtype("<i2")
        return Pcm(info["bits"], cuts[:-1], np.diff(cuts), [samples[a:b].astype(kind).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def read(self, first: int, end: int) -> np.ndarray:
        """Samples first to end, from the blocks that hold them, found by their offsets."""
        a, b = int(np.searchsorted(self.offsets, first, side="right")) - 1, int(np.searchsorted(self.offsets, end, side="left"))
        if a < 0 or b <= a:
            return np.empty(0, np.int64)
        held = np.frombuffer(b"".join(self.blocks[a:b]), np.int8 if self.bits <= 8 else np.dtype("<i2")).astype(np.int64)
        return held[first - int(self.offsets[a]) : end - int(self.offsets[a])]


def _decoded(streams: list[bytes]) -> list[Pcm]:
    return [Pcm.of(s, x) for s, x in zip(streams, decode(streams), strict=True)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "media", 4 << 20):
        streams = batch.column(1).to_pylist()
        known = [i for i, s in enumerate(streams) if s is not None]
        for i, x in zip(known, _decoded([streams[i] for i in known]), strict=True):
            n = len(x.blocks)
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(x.offsets), pa.array(x.sizes.astype(np.int32)), pa.array(x.blocks, pa.binary())], names=["doc_id", "block", "sample_offset", "n_samples", "pcm"])


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, block, sample_offset, n_samples and pcm (signed, little-endian) of every block of media (doc_id, media)."""
    return media.select("doc_id", "media").mapInArrow(tidy(_blocks), "doc_id long, block int, sample_offset long, n_samples int, pcm binary")


def feature(samples: np.ndarray) -> str:
    """Mean, root mean square, peak and the rates of zero crossings and of equal neighbours, of the samples."""
    x = samples.astype(np.int64)
    n = len(x)
    sign = x < 0
    return f"mean={x.sum() / n:.4f};rms={np.sqrt((x * x).sum() / n):.4f};peak={np.abs(x).max()};crossings={np.count_nonzero(sign[1:] != sign[:-1]) / n:.4f};still={np.count_nonzero(x[1:] == x[:-1]) / n:.4f}"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The report of each stream, from its PCM blocks: payload and feature from all of them, the tail by its offset."""
    for batch in steps(batches, "media", 4 << 20):
        streams = batch.column(2).to_pylist()
        pcm = _decoded(streams)
        sizes = [int(x.sizes.sum()) for x in pcm]
        samples = [x.read(0, n) for x, n in zip(pcm, sizes, strict=True)]
        tails = [(x.read(max(n - 16, 0), n) + 128).astype(np.uint8).tobytes() for x, n in zip(pcm, sizes, strict=True)]
        columns = [
            batch.column(0),
            batch.column(1),
            pa.array(sizes, pa.int64()),
            pa.array([hashlib.sha256((x + 128).astype(np.uint8).tobytes()).hexdigest() for x in samples], pa.string()),
            pa.array([zlib.crc32(x) for x in tails], pa.int64()),
            pa.array([len(x) for x in streams], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in streams], pa.string()),
            pa.array([f"{feature(x)};blocks={len(y.blocks)}" for x, y in zip(samples, pcm, strict=True)], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_report(media: DataFrame) -> DataFrame:
    """Digests and features of media (doc_id, n_bytes, media), read back from the streams by way of their PCM blocks."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(_digests), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_report(text_media(table(spark, sf_dir, "documents")))

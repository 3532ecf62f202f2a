"""FLAC media columns: an encoder and a decoder for mono streams that work on many frames side by side.

A stream is the marker, STREAMINFO with the MD5 of its samples, a SEEKTABLE with one point a frame, and frames.
Frames hold a constant, verbatim samples, or Rice-coded residuals of a fixed or quantised linear predictor; each
frame's header has a CRC-8 and the frame a CRC-16.  Decoding walks all frames of a batch in step: sample i of
every frame is decoded by the same few array operations, so Python's cost doesn't depend on the number of frames.
Frames that the stepwise path doesn't cover (partitions, escapes, wasted bits) take a scalar one.

Bytes are stored as 8-bit samples, byte minus 128.  Decoding checks both checksums of every frame, the sample
count and the MD5, and raises ``ValueError`` on any difference.

Defined cases: null and empty texts are one block of 64 zero bytes; rows that repeat are stored alike.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ready
from .wordhash import blocks

BLOCK_SIZE = 4096
RATE = 8000
PAD = 64
#: Bytes of text that one pass of array operations covers; its working memory is about 60 times that.
BATCH_BYTES = 2_000_000
#: Predictor orders that the encoder tries: fixed ones, and one whose coefficients follow from the frame's autocorrelation, with
#: their precision and shift.
FIXED_ORDERS = (0, 1, 2)
LPC_ORDER, PRECISION, SHIFT = 4, 9, 6
_FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


def _crc8_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x << 1) ^ 0x07 if x & 0x80 else x << 1
        out.append(x & 0xFF)
    return out


def _crc16_table() -> np.ndarray:
    """Of two bytes at once: polynomial 0x8005, high bit first."""
    x = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        x = np.where(x & 0x8000, (x << 1) ^ 0x8005, x << 1) & 0xFFFF
    return x.astype(np.uint16)


_CRC8, _CRC16 = _crc8_table(), _crc16_table()
_ZEROS = np.array([16] + [15 - (x.bit_length() - 1) for x in range(1, 1 << 16)], dtype=np.int64)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of many stretches of ``data`` in step.  Zero bytes in front change nothing, so odd lengths begin with one."""
    order = np.argsort(-length, kind="stable")
    begin, n = start[order] - (length[order] & 1), (length[order] + 1) >> 1
    padded = np.concatenate([[0], data, [0]]).astype(np.uint16)
    pairs = (padded[:-1] << np.uint16(8)) | padded[1:]  # pairs[i + 1] starts at data[i]
    out = np.zeros(len(n), dtype=np.uint16)
    odd = (length[order] & 1) == 1
    first = pairs[begin + 1]
    first[odd] &= np.uint16(0xFF)
    longest_first = -n
    for i in range(int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(longest_first, -i, side="left"))
        out[:m] = _CRC16[out[:m] ^ (first[:m] if i == 0 else pairs[begin[:m] + (2 * i + 1)])]
    back = np.empty_like(out)
    back[order] = out
    return back


def _coded_number(n: int) -> bytes:
    """Frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    out = []
    room = 0x3F
    while n > room:
        out.append(0x80 | n & 0x3F)
        n >>= 6
        room >>= 1
    return bytes([(0xFF & ~(2 * room + 1)) | n, *out[::-1]])


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    lead = data[at]
    if lead < 0x80:
        return lead, at + 1
    more = 1
    while lead & (0x80 >> (more + 1)):
        more += 1
    n = lead & (0x3F >> more)
    for b in data[at + 1 : at + 1 + more]:
        if b >> 6 != 2:
            raise ValueError("frame number is malformed")
        n = n << 6 | b & 0x3F
    return n, at + 1 + more


def _frame_header(number: int, n: int) -> bytes:
    size = 12 if n == BLOCK_SIZE else 6 if n <= 256 else 7
    tail = b"" if size == 12 else (n - 1).to_bytes(size - 5, "big")
    head = bytes([0xFF, 0xF8, size << 4 | 4, 1 << 1]) + _coded_number(number) + tail
    return head + bytes([crc8(head)])


def _autocorrelated(samples: np.ndarray, index: np.ndarray, start: np.ndarray, order: int) -> np.ndarray:
    """Predictor coefficients of each frame as whole numbers over 2**SHIFT: Levinson's recursion, all frames at once."""
    r = np.zeros((order + 1, len(start)))
    x = samples.astype(np.float32)
    for lag in range(order + 1):
        product = x.copy()
        product[lag:] *= x[: len(x) - lag]
        product[index < lag] = 0
        r[lag] = np.add.reduceat(product, start, dtype=np.float64)
    a = np.zeros((len(start), order))
    error = r[0] * (1 + 1e-6) + 1.0
    for i in range(order):
        k = (r[i + 1] - sum(a[:, j] * r[i - j] for j in range(i))) / error
        before = a[:, :i].copy()
        a[:, i] = k
        for j in range(i):
            a[:, j] = before[:, j] - k * before[:, i - 1 - j]
        error = error * np.maximum(1 - k * k, 1e-9)
    top = 1 << (PRECISION - 1)
    return np.clip(np.round(a * (1 << SHIFT)), -top, top - 1).astype(np.int32)


def _frames(data: np.ndarray, sizes: list[int], number: list[int], lpc: tuple[tuple[int, ...], int, int] | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Frames of samples that lie end to end; all of them, where each starts, and its bytes."""
    samples = data.astype(np.int32) - 128
    n = np.array(sizes, dtype=np.int64)
    start = np.cumsum(n) - n
    spread = lambda x: np.repeat(x, n)  # noqa: E731  a value of each frame, for each of its samples
    index = np.arange(len(data), dtype=np.int32) - spread(start.astype(np.int32))
    coefficients, precision, shift = (np.tile(np.array(lpc[0], dtype=np.int32), (len(n), 1)), *lpc[1:]) if lpc else (_autocorrelated(samples, index, start, LPC_ORDER), PRECISION, SHIFT)
    many = coefficients.shape[1]

    def residual_of(order: int, linear: bool) -> np.ndarray:
        r = samples.copy()
        if linear:
            p = np.zeros(len(r), dtype=np.int64 if lpc else np.int32)
            for j in range(1, many + 1):
                p[j:] += spread(coefficients[:, j - 1])[j:] * samples[:-j].astype(p.dtype)
            return (r - (p >> shift)).astype(np.int32)
        for j, c in enumerate(_FIXED[order], 1):
            r[j:] -= c * samples[:-j]
        return r

    best_cost = np.full(len(n), np.inf)
    best_order, best_k, best_linear = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=bool)
    folded = np.zeros(len(data), dtype=np.int32)
    for order, linear in [(many, True)] if lpc else [*((o, False) for o in FIXED_ORDERS), (many, True)]:
        r = residual_of(order, linear)
        u = (r << 1) ^ (r >> 31)
        u[index < order] = 0
        total = np.add.reduceat(u, start, dtype=np.int64)
        count = np.maximum(n - order, 1)
        k = np.clip(np.floor(np.log2(np.maximum(total / count * 0.6931, 1.0))), 0, 14).astype(np.int64)
        cost = 6.0 + order * 8 + count * (k + 1) + total / (1 << k) + (9 + precision * order if linear else 0)
        cost = np.where(n > order, cost, np.inf)
        better = cost < best_cost
        best_cost[better], best_order[better], best_k[better], best_linear[better] = cost[better], order, k[better], linear
        np.copyto(folded, u, where=spread(better))
    verbatim = best_cost >= 8.0 * n
    flat = np.maximum.reduceat(samples, start) == np.minimum.reduceat(samples, start)

    k_of = spread(best_k.astype(np.int32))
    coded = spread(~(verbatim | flat)) & (index >= spread(best_order.astype(np.int32)))
    width = ((folded >> k_of) + np.int32(1) + k_of) * coded
    bits = np.add.reduceat(width, start, dtype=np.int64)
    heads: list[bytes] = []
    body = np.zeros(len(n), dtype=np.int64)  # bits from the frame's start to its first residual
    byte_len = np.zeros(len(n), dtype=np.int64)
    for f in range(len(n)):
        head = _frame_header(number[f], sizes[f])
        s = int(start[f])
        if flat[f]:
            head += bytes([0, int(data[s]) ^ 0x80])
        elif verbatim[f]:
            head += bytes([2]) + (data[s : s + sizes[f]] ^ 0x80).tobytes()
        else:
            order, k = int(best_order[f]), int(best_k[f])
            head += bytes([(32 + order - 1 if best_linear[f] else 8 + order) << 1]) + (data[s : s + order] ^ 0x80).tobytes()
            value, length = k, 10  # method 0, partition order 0, parameter
            if best_linear[f]:
                v, length = precision - 1 << 5 | shift & 31, 9
                for c in coefficients[f].tolist():
                    v, length = v << precision | c & (1 << precision) - 1, length + precision
                value, length = v << 10 | k, length + 10
            body[f] = 8 * len(head) + length
            head += (value << (-length % 8)).to_bytes((length + 7) // 8, "big")
        heads.append(head)
        byte_len[f] = max(len(head), (int(body[f]) + int(bits[f]) + 7) // 8)
    offset = np.cumsum(byte_len + 2) - (byte_len + 2)
    out = np.zeros(int((byte_len + 2).sum()), dtype=np.uint8)
    at = np.flatnonzero(coded)
    if len(at):
        first = np.cumsum(bits) - bits
        ends = (np.cumsum(width, dtype=np.int64) + spread(8 * offset + body - first))[at]
        k = k_of[at]
        value = (np.int32(1) << k) | (folded[at] & ((np.int32(1) << k) - np.int32(1)))
        begin = ends - k - 1
        byte = begin >> 3
        window = value << (23 - (begin & 7).astype(np.int32) - k)
        for j in range(3):
            # Codes don't overlap, so sums of their bytes are their unions.
            part = np.bincount(byte + j, (window >> (16 - 8 * j)) & 0xFF, minlength=len(out) + 3)[: len(out)]
            out |= part.astype(np.uint8)
    for f, head in enumerate(heads):
        o = int(offset[f])
        out[o : o + len(head)] |= np.frombuffer(head, dtype=np.uint8)
    check = crc16(out, offset, byte_len)
    out[offset + byte_len] = check >> 8
    out[offset + byte_len + 1] = check & 0xFF
    return out.tobytes(), offset, byte_len + 2


def encode(payloads: list[bytes], lpc: tuple[tuple[int, ...], int, int] | None = None) -> list[bytes]:
    """One stream for each payload.  ``lpc`` (coefficients, precision, shift) replaces the search for a predictor.

    Frames are made BATCH_BYTES of samples at a time, wherever payloads begin and end, so neither many payloads nor a very
    long one needs more working memory.
    """
    made: list[list[bytes]] = [[] for _ in payloads]
    waiting: list[tuple[int, int]] = []
    size = 0

    def flush() -> None:
        sizes = [min(BLOCK_SIZE, len(payloads[k]) - j * BLOCK_SIZE) for k, j in waiting]
        data = np.frombuffer(b"".join([payloads[k][j * BLOCK_SIZE : (j + 1) * BLOCK_SIZE] for k, j in waiting]), dtype=np.uint8)
        whole, offset, length = _frames(data, sizes, [j for _, j in waiting], lpc)
        for (k, _), o, n in zip(waiting, offset.tolist(), length.tolist(), strict=True):
            made[k].append(whole[o : o + n])
        waiting.clear()

    for k, p in enumerate(payloads):
        for j in range(-(-len(p) // BLOCK_SIZE)):
            waiting.append((k, j))
            size += min(BLOCK_SIZE, len(p) - j * BLOCK_SIZE)
            if size >= BATCH_BYTES:
                flush()
                size = 0
    if waiting:
        flush()
    streams = []
    for p, frames in zip(payloads, made, strict=True):
        lengths = list(map(len, frames))
        block = max(16, min(BLOCK_SIZE, len(p)))
        info = block.to_bytes(2, "big") * 2 + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5((np.frombuffer(p, dtype=np.uint8) ^ 0x80).tobytes()).digest()
        points, at = [], 0
        for j, n in enumerate(lengths):
            points.append((BLOCK_SIZE * j).to_bytes(8, "big") + at.to_bytes(8, "big") + min(BLOCK_SIZE, len(p) - BLOCK_SIZE * j).to_bytes(2, "big"))
            at += n
        table = b"".join(points)
        streams.append(b"".join([b"fLaC\x00", len(info).to_bytes(3, "big"), info, b"\x83", len(table).to_bytes(3, "big"), table, *frames]))
    return streams


@dataclass
class Stream:
    """What the metadata of a stream say; ``points`` are (first sample, byte offset from the first frame, samples)."""

    total: int
    bits: int
    md5: bytes
    points: list[tuple[int, int, int]]
    frames_at: int


def metadata(stream: bytes) -> Stream:
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, found, points = 4, False, None, []
    while not last:
        kind, size = stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        last = stream[at] >= 0x80
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if packed >> 41 & 7:
                raise ValueError("only one channel is supported")
            found = (packed & (1 << 36) - 1, (packed >> 36 & 31) + 1, body[18:34])
        elif kind == 3:
            for j in range(0, size, 18):
                first = int.from_bytes(body[j : j + 8], "big")
                if first != (1 << 64) - 1:
                    points.append((first, int.from_bytes(body[j + 8 : j + 16], "big"), int.from_bytes(body[j + 16 : j + 18], "big")))
        at += 4 + size
    if found is None:
        raise ValueError("STREAMINFO is missing")
    return Stream(*found, points, at)


@dataclass
class Head:
    """A frame's header and the start of its subframe."""

    number: int
    n: int
    kind: int
    wasted: bool
    body: int  # byte after the subframe's header


_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, **{c: 256 << (c - 8) for c in range(8, 16)}}


def _head(data: bytes, at: int) -> Head:
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError("frame has no sync code")
    size, rate = data[at + 2] >> 4, data[at + 2] & 15
    number, p = _read_number(data, at + 4)
    if size in (6, 7):
        n = int.from_bytes(data[p : p + size - 5], "big") + 1
        p += size - 5
    elif size in _SIZES:
        n = _SIZES[size]
    else:
        raise ValueError("block size is reserved")
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(data[at:p]) != data[p]:
        raise ValueError("frame header fails its checksum")
    return Head(number, n, data[p + 1] >> 1 & 63, bool(data[p + 1] & 1), p + 2)


class _Bits:
    """Scalar reader."""

    def __init__(self, data: bytes, byte: int):
        self.data, self.at = data, 8 * byte

    def take(self, n: int) -> int:
        lo, hi = self.at >> 3, (self.at + n + 7) >> 3
        v = int.from_bytes(self.data[lo:hi], "big") >> (8 * hi - self.at - n) & (1 << n) - 1
        if hi > len(self.data):
            raise ValueError("stream ends early")
        self.at += n
        return v

    def signed(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        q = 0
        while not self.take(1):
            q += 1
        return q


def decode_scalar(data: bytes, at: int, bits: int) -> tuple[list[int], int]:
    """Samples of the frame at ``at`` and the byte after its body: every subframe kind, one sample at a time."""
    h = _head(data, at)
    r = _Bits(data, h.body)
    shift_up = 1 + r.unary() if h.wasted else 0
    bits -= shift_up
    if h.kind == 0:
        out = [r.signed(bits)] * h.n
    elif h.kind == 1:
        out = [r.signed(bits) for _ in range(h.n)]
    elif 8 <= h.kind <= 12 or h.kind >= 32:
        order = h.kind - 31 if h.kind >= 32 else h.kind - 8
        out = [r.signed(bits) for _ in range(order)]
        coefficients, shift = list(_FIXED[order]) if h.kind < 32 else [], 0
        if h.kind >= 32:
            precision, shift = r.take(4) + 1, r.signed(5)
            coefficients = [r.signed(precision) for _ in range(order)]
        width = (4, 5)[r.take(2)]
        parts = 1 << r.take(4)
        for part in range(parts):
            k = r.take(width)
            raw = r.take(5) if k == (1 << width) - 1 else None
            for _ in range(h.n // parts - (order if part == 0 else 0)):
                if raw is None:
                    q = r.unary()
                    u = q << k | (r.take(k) if k else 0)
                    e = u >> 1 ^ -(u & 1)
                else:
                    e = r.signed(raw)
                out.append(e + (sum(c * out[-j] for j, c in enumerate(coefficients, 1)) >> shift))
    else:
        raise ValueError("subframe type is reserved")
    return [x << shift_up for x in out], (r.at + 7) // 8


def decode_frames(data: bytes, starts: list[int], bits: int = 8) -> tuple[list[Head], np.ndarray, np.ndarray, list[int]]:
    """Headers, all samples end to end, first sample of each frame, and the byte after each frame; checksums verified."""
    heads = [_head(data, s) for s in starts]
    n = np.array([h.n for h in heads], dtype=np.int64)
    first = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), dtype=np.int64)
    ends = [0] * len(heads)
    raw = np.frombuffer(data, dtype=np.uint8)
    rows = []
    for f, h in enumerate(heads):
        order = h.kind - 31 if h.kind >= 32 else h.kind - 8
        if bits == 8 and not h.wasted and h.kind in (0, 1):
            take = 1 if h.kind == 0 else h.n
            out[first[f] : first[f] + h.n] = raw[h.body : h.body + take].view(np.int8)
            ends[f] = h.body + take
            continue
        if bits == 8 and not h.wasted and (8 <= h.kind <= 12 or h.kind >= 32) and order < h.n:
            r = _Bits(data, h.body + order)
            coefficients, shift = _FIXED.get(order, ()) if h.kind < 32 else (), 0
            if h.kind >= 32:
                precision, shift = r.take(4) + 1, r.signed(5)
                coefficients = tuple(r.signed(precision) for _ in range(order))
            method, parts, k = r.take(2), r.take(4), r.take(4)
            if method == 0 and parts == 0 and k != 15:
                out[first[f] : first[f] + order] = raw[h.body : h.body + order].view(np.int8)
                rows.append((f, order, k, r.at, coefficients, shift, h.kind >= 32))
                continue
        x, ends[f] = decode_scalar(data, starts[f], bits)
        out[first[f] : first[f] + h.n] = x
    if rows:
        rows.sort(key=lambda x: -(heads[x[0]].n - x[1]))
        which = np.array([x[0] for x in rows])
        order, k, pos = (np.array([x[j] for x in rows], dtype=np.int64) for j in (1, 2, 3))
        many = n[which] - order
        base = first[which] + order
        padded = np.concatenate([raw, np.zeros(16, dtype=np.uint8)])
        word = np.zeros(len(raw) + 8, dtype=np.uint64)
        for j in range(8):
            word |= padded[j : j + len(word)].astype(np.uint64) << np.uint64(56 - 8 * j)
        ku = k.astype(np.uint64)
        down = np.uint64(63) - ku
        for i in range(int(many[0])):
            m = int(np.searchsorted(-many, -i, side="left"))
            p = pos[:m]
            w = word[p >> 3] << (p & 7).astype(np.uint64)
            q = _ZEROS[(w >> np.uint64(48)).astype(np.int64)]
            if (q == 16).any():  # a long run of zeros, or the end of the data
                for j in np.flatnonzero(q == 16):
                    z = _Bits(data, 0)
                    z.at = int(p[j])
                    q[j] = z.unary()
                w = word[(p + q) >> 3] << ((p + q) & 7).astype(np.uint64)
                u = (q << k[:m]) | ((w << np.uint64(1)) >> np.uint64(1) >> down[:m]).astype(np.int64)
            else:
                u = (q << k[:m]) | ((w << (q + 1).astype(np.uint64)) >> np.uint64(1) >> down[:m]).astype(np.int64)
            out[base[:m] + i] = (u >> 1) ^ -(u & 1)
            pos[:m] = p + q + 1 + k[:m]
        for x, p in zip(rows, pos.tolist(), strict=True):
            ends[x[0]] = (p + 7) // 8
        _predict(out, first, n, rows)
    length = np.array(ends, dtype=np.int64) - np.array(starts, dtype=np.int64)
    stop = np.array(ends, dtype=np.int64)
    if len(stop) and int(stop.max()) + 2 > len(raw):
        raise ValueError("stream ends early")
    if len(stop) and (crc16(raw, np.array(starts, dtype=np.int64), length) != raw[stop].astype(np.uint16) * 256 + raw[stop + 1]).any():
        raise ValueError("frame fails its checksum")
    return heads, out, first, [e + 2 for e in ends]


def _predict(out: np.ndarray, first: np.ndarray, n: np.ndarray, rows: list[tuple]) -> None:
    """Residuals to samples, in place: order 0 is done, fixed orders are repeated sums, others go step by step."""
    for order in range(1, 5):
        mine = [x[0] for x in rows if x[1] == order and not x[6]]
        for f in mine:
            s = out[first[f] : first[f] + n[f]]
            # The warm-up samples as differences of rising order; then one running sum for each order.
            warm = s[:order].copy()
            for j in range(order):
                s[j] = warm[j]
                warm[j + 1 :] = np.diff(warm[j:])
            for j in range(order - 1, -1, -1):
                s[j:] = np.cumsum(s[j:])
    mine = [x for x in rows if x[6]]
    if mine:
        longest = max(x[1] for x in mine)
        f = np.array([x[0] for x in mine])
        sizes, at = n[f], first[f]
        rank = np.argsort(-sizes, kind="stable")
        f, sizes, at, mine = f[rank], sizes[rank], at[rank], [mine[i] for i in rank]
        c = np.zeros((len(mine), longest), dtype=np.int64)
        for i, x in enumerate(mine):
            c[i, : x[1]] = x[4]
        order, shift = np.array([x[1] for x in mine]), np.array([x[5] for x in mine])
        for i in range(1, int(sizes[0])):
            m = int(np.searchsorted(-sizes, -i, side="left"))
            live = order[:m] <= i
            back = np.minimum(i, longest)
            p = (c[:m, :back] * out[(at[:m, None] + i - 1 - np.arange(back)).clip(0)]).sum(1) >> shift[:m]
            out[at[:m] + i] += np.where(live, p, 0)


def decode(streams: list[bytes]) -> tuple[list[bytes], list[list[tuple[int, int, int]]]]:
    """Payload bytes of each stream, and its blocks as (first sample, samples, byte offset of the frame).

    Streams whose seek points cover them are decoded BATCH_BYTES of frames at a time, many streams or parts of one alike;
    others one frame after the other.
    """
    info = [metadata(s) for s in streams]
    spans: list[list[tuple[int, int, int]]] = [[] for _ in streams]
    out: list[list[bytes]] = [[] for _ in streams]
    waiting: list[tuple[int, int, int, int]] = []
    size = 0

    def kept(x: np.ndarray, bits: int) -> bytes:
        return (x.astype(np.int8).view(np.uint8) if bits == 8 else x.astype("<i2")).tobytes()

    def flush() -> None:
        data = b"".join([streams[s][lo:hi] for s, lo, hi, _ in waiting])
        lengths = [hi - lo for _, lo, hi, _ in waiting]
        starts = np.cumsum([0, *lengths]).tolist()
        heads, samples, first, ends = decode_frames(data, starts[:-1])
        for f, (s, lo, _, done) in enumerate(waiting):
            if ends[f] != starts[f + 1]:
                raise ValueError("frames don't follow one another")
            spans[s].append((done, heads[f].n, lo))
            out[s].append(kept(samples[first[f] : first[f] + heads[f].n], 8))
        waiting.clear()

    for s, m in enumerate(info):
        whole = m.bits == 8 and sum(x[2] for x in m.points) == m.total and all(a[0] + a[2] == b[0] and a[1] < b[1] for a, b in zip(m.points, m.points[1:], strict=False))
        if whole:
            places = [m.frames_at + p[1] for p in m.points] + [len(streams[s])]
            for point, lo, hi in zip(m.points, places, places[1:], strict=False):
                waiting.append((s, lo, hi, point[0]))
                size += hi - lo
                if size >= BATCH_BYTES:
                    flush()
                    size = 0
        else:  # no full seek table: one frame after the other
            at, done = m.frames_at, 0
            while at < len(streams[s]):
                heads, samples, _, ends = decode_frames(streams[s], [at], m.bits)
                spans[s].append((done, heads[0].n, at))
                out[s].append(kept(samples, m.bits))
                done, at = done + heads[0].n, ends[0]
    if waiting:
        flush()
    payloads = []
    for m, parts, blocks_ in zip(info, out, spans, strict=True):
        if sum(x[1] for x in blocks_) != m.total:
            raise ValueError("number of samples differs from STREAMINFO")
        raw = b"".join(parts)
        if m.md5 != bytes(16) and hashlib.md5(raw).digest() != m.md5:
            raise ValueError("samples fail their MD5")
        payloads.append((np.frombuffer(raw, dtype=np.uint8) ^ 0x80).tobytes() if m.bits == 8 else raw)
    return payloads, spans


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % PAD or (0 if text else PAD))


def feature(payload: bytes) -> str:
    """Figures of the samples, all whole numbers: count, sum, energy, peak, changes of sign, sum of steps."""
    total = energy = peak = turns = steps = 0
    for lo in range(0, len(payload), BATCH_BYTES):
        # A part begins with the last sample of the part before it, whose step and turn it adds.
        x = np.frombuffer(payload[max(0, lo - 1) : lo + BATCH_BYTES], dtype=np.uint8).astype(np.int32) - 128
        own = x[1:] if lo else x
        total += int(own.sum(dtype=np.int64))
        energy += int((own * own).sum(dtype=np.int64))
        peak = max(peak, int(np.abs(own).max()))
        turns += int(((x[1:] < 0) != (x[:-1] < 0)).sum())
        steps += int(np.abs(np.diff(x)).sum(dtype=np.int64))
    return f"n={len(payload)};sum={total};energy={energy};peak={peak};turns={turns};steps={steps}"


def add_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a stream, with the length of its UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, chars=BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(encode([padded(t) for t in texts]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return ready(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """Blocks of samples of (doc_id, media) with their place in time and in the stream; null media have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, streams in blocks(batches, "media", BATCH_BYTES):
            ids = rows.column(0).to_pylist()
            there = [i for i, s in enumerate(streams) if s]
            out: list[tuple] = []
            for i, payload, spans in zip(there, *decode([streams[i] for i in there]), strict=True):
                out += [(ids[i], b, lo, n, at, payload[lo : lo + n]) for b, (lo, n, at) in enumerate(spans)]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "block", "first_sample", "n_samples", "frame_offset", "pcm"])

    return ready(media).select("doc_id", "media").mapInArrow(run, "doc_id bigint, block int, first_sample bigint, n_samples bigint, frame_offset bigint, pcm binary")


def media_facts(media: DataFrame) -> DataFrame:
    """Of (doc_id, n_bytes, media): digests and features of the payload, all from the media column read back; null media has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, streams in blocks(batches, "media", BATCH_BYTES):
            there = pa.array([bool(s) for s in streams])
            rows, streams = rows.filter(there), [s for s in streams if s]
            back, spans = decode(streams)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": rows.column(0),
                    "n_bytes": rows.column(1),
                    "payload_bytes": pa.array(list(map(len, back)), pa.int64()),
                    "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in back], pa.string()),
                    "tail_crc32": pa.array([zlib.crc32(p[-PAD:]) for p in back], pa.int64()),
                    "media_bytes": pa.array(list(map(len, streams)), pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(s).hexdigest() for s in streams], pa.string()),
                    "feature": pa.array([feature(p) for p in back], pa.string()),
                    "n_blocks": pa.array(list(map(len, spans)), pa.int64()),
                }
            )

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_blocks bigint"
    return ready(media).select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def media_digest(docs: DataFrame) -> DataFrame:
    """The contract's rows: facts of the media column that the texts are stored in.  The column goes from one operator to the next
    within a stage; ``add_media(docs)`` can as well be written as a table and its facts taken from there."""
    return media_facts(add_media(docs))

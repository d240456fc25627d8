"""Media columns as FLAC: bytes in, lossless streams out, and back to PCM blocks.

encode() stores a payload of unsigned 8-bit samples as a mono FLAC stream of fixed
blocks: stream info with the MD5 of the samples, a seek table with every block, and
frames with checksums.  Each frame uses the cheapest of the fixed predictors 0 to 2 and
a linear predictor of order 4, with Rice-coded residuals in eight partitions.

decode() reads any stream of up to 8 channels and 24 bits (constant, verbatim, fixed and
linear subframes; both Rice methods, escapes, wasted bits; stereo decorrelation),
checks both checksums of each frame and the MD5, and returns the samples with the
offset of each block.  Frames are decoded side by side: one step reads the next residual
of all frames of a chunk.  A stream whose seek table does not list every block is read
frame after frame.

blocks() writes a stream out as PCM blocks, a row each with its sample offset; digest()
works through such rows, and excerpt() reads samples [first, last) by decoding only the
blocks that hold them.

Defined cases: null content is empty; an empty payload is one block of padding; a
damaged stream raises ValueError; rows with equal content have equal streams; extra
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import has_columns, text_or_empty

BLOCK = 576
PAD = 255
RATE = 8_000
CHUNK = 2_048  # frames that are coded side by side
_LPC, _PRECISION, _SHIFT, _PARTS = 4, 12, 9, 3  # order, bits and shift of coefficients; partition order
#: Fixed values of the format: block sizes by code, predictors of the fixed orders.
_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


@functools.cache
def _crc_table(bits: int, poly: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = (crc << 1 ^ poly if crc & top else crc << 1) & mask
        out.append(crc)
    return np.array(out, dtype=np.uint16)


def crc8(data: bytes) -> int:
    table, crc = _crc_table(8, 0x07), 0
    for byte in data:
        crc = int(table[crc ^ byte])
    return crc


def crc16(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of flat[start:end] for each pair, side by side; leading zeros do not change it, so all end in the last step."""
    table, width = _crc_table(16, 0x8005), int((ends - starts).max())
    crc = np.zeros(len(starts), np.uint16)
    at = ends - width
    padded = np.concatenate((np.zeros(width, np.uint8), flat))
    for i in range(width):
        byte = np.where(at + i >= starts, padded[at + (i + width)], 0)
        crc = table[(crc >> 8) ^ byte] ^ (crc << 8)
    return crc


def _number(n: int) -> bytes:
    """A frame number in the format's extension of UTF-8."""
    if n < 0x80:
        return bytes([n])
    extra = next(k for k in range(1, 7) if n < 1 << (6 * k + max(0, 6 - k)))
    lead = (0xFF << (7 - extra) & 0xFF) | (n >> 6 * extra)
    return bytes([lead, *(0x80 | n >> 6 * k & 0x3F for k in reversed(range(extra)))])


@functools.lru_cache(maxsize=65_536)
def _header(number: int) -> bytes:
    head = bytes([0xFF, 0xF8, 2 << 4, 0 << 4 | 1 << 1]) + _number(number)  # 576 samples, rate as in the stream info, mono, 8 bits
    return head + bytes([crc8(head)])


def _levinson(samples: np.ndarray) -> np.ndarray:
    """Quantised linear predictors of order _LPC, one row per frame."""
    x = samples.astype(np.float32)
    r = np.stack([(x[:, : x.shape[1] - lag] * x[:, lag:]).sum(axis=1) for lag in range(_LPC + 1)], axis=1).astype(np.float64)
    r[:, 0] = r[:, 0] * 1.0001 + 1e-3
    a, error = np.zeros((len(x), _LPC)), r[:, 0].copy()
    for i in range(_LPC):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        error = np.maximum(error * (1 - k * k), 1e-6)
    most = 2 ** (_PRECISION - 1)
    return np.clip(np.rint(a * 2**_SHIFT), -most, most - 1).astype(np.int32)


def _residuals(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per frame: the order of the best predictor, its residuals (the first `order` are zero), linear coefficients."""
    coefficients = _levinson(samples)
    guess = np.zeros_like(samples)
    for j in range(_LPC):
        guess[:, _LPC:] += coefficients[:, j : j + 1] * samples[:, _LPC - 1 - j : -1 - j]
    linear = samples - (guess >> _SHIFT)
    one = np.diff(samples, axis=1, prepend=samples[:, :1])
    two = np.diff(one, axis=1, prepend=one[:, :1])
    all_of = np.stack((samples, one, two, linear))
    for i, order in enumerate((0, 1, 2, _LPC)):
        all_of[i, :, :order] = 0
    cost = np.abs(all_of).sum(axis=2)
    best = cost.argmin(axis=0)
    return np.array([0, 1, 2, _LPC])[best], all_of[best, np.arange(len(samples))], coefficients


def encode_frames(samples: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of samples (frames x BLOCK, signed)."""
    n, part = len(samples), BLOCK >> _PARTS
    order, residual, coefficients = _residuals(samples)
    folded = (residual << 1) ^ (residual >> 31)
    sums = folded.reshape(n, -1, part).sum(axis=2)
    count = np.full(sums.shape, part)
    count[:, 0] -= order
    k = np.maximum(0, np.floor(np.log2(np.maximum(sums / count * 0.7, 1))).astype(np.int32))  # near the best for a geometric tail
    per = np.repeat(k, part, axis=1)
    quotient = folded >> per

    # tokens: value in the last `width` of `length` bits
    head = 8 + 4 + 9 + _LPC + 1  # columns before the partitions
    columns = head + (part + 1) * (1 << _PARTS)
    value, width, length = (np.zeros((n, columns), np.int32) for _ in range(3))

    def put(at: int, v, w, where=slice(None)) -> None:
        value[where, at], width[where, at], length[where, at] = v, w, w

    headers = [_header(i) for i in numbers]
    sizes = np.array([len(h) for h in headers])
    is_linear = order == _LPC
    put(8, np.where(is_linear, 32 | (_LPC - 1), 8 | order) << 1, 8)
    for j in range(_LPC):
        put(9 + j, samples[:, j] & 0xFF, np.where(j < order, 8, 0))
    put(9 + _LPC, (_PRECISION - 1) << 5 | _SHIFT, 9, is_linear)
    for j in range(_LPC):
        put(10 + _LPC + j, coefficients[is_linear, j] & ((1 << _PRECISION) - 1), _PRECISION, is_linear)
    put(head - 1, _PARTS, 6)
    body = slice(head, columns)
    codes = lambda x: x[:, body].reshape(n, 1 << _PARTS, part + 1)
    codes(value)[:, :, 0], codes(width)[:, :, 0], codes(length)[:, :, 0] = k, 4, 4
    low = (folded & ((1 << per) - 1)) | (1 << per)
    silent = np.arange(BLOCK) < order[:, None]
    shaped = lambda x: np.where(silent, 0, x).reshape(n, 1 << _PARTS, part)
    codes(value)[:, :, 1:], codes(width)[:, :, 1:], codes(length)[:, :, 1:] = shaped(low), shaped(per + 1), shaped(quotient + per + 1)

    bits = length.sum(axis=1)
    bytes_of = sizes + (bits + 7) // 8 + 2
    starts = np.concatenate(([0], np.cumsum(bytes_of)[:-1]))
    total = int(bytes_of.sum())
    ends = np.cumsum(length, axis=1, dtype=np.int64) + 8 * (starts + sizes)[:, None]
    used = width > 0
    value, width, ends = value[used].astype(np.uint64), width[used], ends[used]
    first = ends - width
    word, shift = first >> 5, (64 - (first & 31) - width).astype(np.uint64)
    wide = value << shift
    slots = total // 4 + 2
    packed = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), slots) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), slots)
    flat = packed.astype(np.uint64).astype(">u4").view(np.uint8)[:total].copy()
    for h, s in zip(headers, starts.tolist(), strict=True):
        flat[s : s + len(h)] = np.frombuffer(h, np.uint8)
    crc = crc16(flat, starts, starts + bytes_of - 2)
    flat[starts + bytes_of - 2], flat[starts + bytes_of - 1] = crc >> 8, crc & 0xFF
    data = flat.tobytes()
    return [data[s : s + b] for s, b in zip(starts.tolist(), bytes_of.tolist(), strict=True)]


def pad(payload: bytes) -> bytes:
    """payload with bytes 255 appended up to a positive multiple of BLOCK."""
    return payload + bytes([PAD]) * (-len(payload) % BLOCK or (0 if payload else BLOCK))


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A stream per padded payload."""
    counts = [len(p) // BLOCK for p in payloads]
    if any(len(p) % BLOCK or not p for p in payloads):
        raise ValueError(f"payloads have to be positive multiples of {BLOCK} bytes")
    flat, numbers, frames = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK), [i for c in counts for i in range(c)], []
    for i in range(0, len(flat), CHUNK):
        frames += encode_frames(flat[i : i + CHUNK].astype(np.int32) - 128, numbers[i : i + CHUNK])
    out, at = [], 0
    for payload, n in zip(payloads, counts, strict=True):
        own, at = frames[at : at + n], at + n
        out.append(_stream(payload, own))
    return out


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    sizes = np.array([len(f) for f in frames], dtype=np.int64)
    md5 = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
    info = (BLOCK << 16 | BLOCK).to_bytes(4, "big") + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + md5
    points = np.zeros(len(frames), dtype=[("sample", ">u8"), ("at", ">u8"), ("n", ">u2")])
    points["sample"], points["at"], points["n"] = np.arange(len(frames)) * BLOCK, np.cumsum(sizes) - sizes, BLOCK
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x80 | 3]) + (18 * len(frames)).to_bytes(3, "big") + points.tobytes() + b"".join(frames)


class Stream:
    """The metadata of a stream: rate, channels, bits, samples, md5; points: where blocks start, if the seek table lists all."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, points = 4, False, None
        while not last:
            kind, size = data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            last, block, at = bool(data[at] & 0x80), data[at + 4 : at + 4 + size], at + 4 + size
            if len(block) < size or at >= len(data) and not last:
                raise ValueError("the stream ends within its metadata")
            if kind == 0:
                self.block, bits = int.from_bytes(block[2:4], "big"), int.from_bytes(block[10:18], "big")
                self.rate, self.channels, self.bits, self.samples = bits >> 44, (bits >> 41 & 7) + 1, (bits >> 36 & 31) + 1, bits & (1 << 36) - 1
                self.md5 = block[18:34]
            elif kind == 3:
                points = np.frombuffer(block, dtype=[("sample", ">u8"), ("at", ">u8"), ("n", ">u2")])
        self.audio = at
        complete = points is not None and len(points) and points["n"].sum() == self.samples and (np.cumsum(points["n"]) - points["n"] == points["sample"]).all()
        self.starts = at + points["at"].astype(np.int64) if complete else None
        self.offsets = points["sample"].astype(np.int64) if complete else None


def _read_header(data: bytes, at: int) -> tuple[int, int, int, int]:
    """(block size, channel assignment, bits a sample or 0, header bytes) of the frame at `at`."""
    if data[at : at + 1] != b"\xff" or at + 6 > len(data) or data[at + 1] & 0xFE != 0xF8:
        raise ValueError("no frame where one should start")
    size, rate, end = data[at + 2] >> 4, data[at + 2] & 15, at + 4
    lead = data[end]
    end += 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if size == 6:
        n, end = data[end] + 1, end + 1
    elif size == 7:
        n, end = int.from_bytes(data[end : end + 2], "big") + 1, end + 2
    else:
        n = _SIZES.get(size, 0)
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not n or end >= len(data) or _crc8_cached(data[at:end]) != data[end]:
        raise ValueError("a frame header's checksum is wrong")
    return n, data[at + 3] >> 4, _BITS.get(data[at + 3] >> 1 & 7, 0), end + 1 - at


_crc8_cached = functools.lru_cache(maxsize=65_536)(crc8)


class _Bits:
    """Big-endian bit reads at many positions of one buffer."""

    def __init__(self, data: bytes):
        self.data = data + bytes(16)
        self.windows = np.ndarray(shape=(len(data) + 8,), dtype=">u8", buffer=self.data, strides=(1,))

    def top(self, pos: np.ndarray) -> np.ndarray:
        """The 57 or more bits from pos on, left-aligned."""
        return self.windows[np.minimum(pos >> 3, len(self.windows) - 1)].astype(np.uint64) << (pos & 7).astype(np.uint64)

    def read(self, pos: np.ndarray, n) -> np.ndarray:
        """n bits (0 to 32, one number or one for each position) as unsigned numbers."""
        return ((self.top(pos) >> np.uint64(1)) >> np.asarray(63 - n, dtype=np.uint64)).astype(np.int64)

    def signed(self, pos: np.ndarray, n) -> np.ndarray:
        v, n = self.read(pos, n), np.asarray(n, dtype=np.int64)
        half = np.left_shift(1, np.maximum(n - 1, 0))
        return np.where(n > 0, (v ^ half) - half, 0)

    def zeros(self, pos: np.ndarray) -> np.ndarray:
        """How many zero bits stand before the next one bit."""
        high = (self.top(pos) >> np.uint64(32)).astype(np.int64)
        n = 1054 - (np.maximum(high, 1).astype(np.float64).view(np.int64) >> 52)
        if not high.all():
            far = np.flatnonzero(high == 0)
            if (pos[far] >= 8 * len(self.data)).any():
                raise ValueError("a frame runs past the end of its stream")
            n[far] = 32 + self.zeros(pos[far] + 32)
        return n


def _subframes(bits: _Bits, pos: np.ndarray, n: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """One channel of frames that start at pos: samples (n x frames) and the positions after it."""
    out, kind = np.zeros((n, len(pos)), np.int64), bits.read(pos, 8)
    if (kind & 0x80).any():
        raise ValueError("a subframe does not start with zero")
    pos = pos + 8
    wasted = np.zeros(len(pos), np.int64)
    if (flagged := np.flatnonzero(kind & 1)).size:
        wasted[flagged] = bits.zeros(pos[flagged]) + 1
        pos[flagged] += wasted[flagged]
    kind = kind >> 1 & 0x3F
    for each in np.unique(kind * 64 + wasted).tolist():
        code, lost = divmod(each, 64)
        own = np.flatnonzero((kind == code) & (wasted == lost))
        samples, pos[own] = _one_kind(bits, pos[own], n, depth - lost, code)
        out[:, own] = samples << lost
    return out, pos


def _one_kind(bits: _Bits, pos: np.ndarray, n: int, depth: int, code: int) -> tuple[np.ndarray, np.ndarray]:
    if code == 0:
        return np.broadcast_to(bits.signed(pos, depth), (n, len(pos))), pos + depth
    if code == 1:
        return np.stack([bits.signed(pos + i * depth, depth) for i in range(n)]), pos + n * depth
    order = code - 8 if 8 <= code <= 12 else code - 31 if code >= 32 else -1
    if order < 0 or order > n:
        raise ValueError("a subframe has a reserved type")
    s = np.zeros((n, len(pos)), np.int64)
    for i in range(order):
        s[i] = bits.signed(pos + i * depth, depth)
    pos = pos + order * depth
    if code >= 32:
        precision, shift = bits.read(pos, 4) + 1, bits.signed(pos + 4, 5)
        pos, coefficients = pos + 9, []
        for _ in range(order):
            coefficients.append(bits.signed(pos, precision))
            pos = pos + precision
    else:
        shift, coefficients = np.zeros(len(pos), np.int64), _FIXED[order]
    residual, pos = _rice(bits, pos, n, order)
    if not order:
        return residual, pos
    for t in range(order, n):
        guess = coefficients[0] * s[t - 1]
        for j in range(1, order):
            guess = guess + coefficients[j] * s[t - 1 - j]
        s[t] = residual[t] + (guess >> shift if code >= 32 else guess)
    return s, pos


def _rice(bits: _Bits, pos: np.ndarray, n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals (n x frames, the first `order` rows zero) and the positions after them."""
    out, end = np.zeros((n, len(pos)), np.int64), pos + 6
    coding = bits.read(pos, 6)
    for each in np.unique(coding).tolist():
        method, parts = each >> 4, each & 15
        own = np.flatnonzero(coding == each)
        if method > 1 or n % (1 << parts) or n >> parts < order:
            raise ValueError("a residual has a reserved coding")
        at, wide, size = end[own], 4 + method, n >> parts
        block = np.zeros((n, len(own)), np.int64)
        for p in range(1 << parts):
            k = bits.read(at, wide)
            at = at + wide
            raw = k == (1 << wide) - 1
            escaped = bool(raw.any())
            if escaped:
                plain = np.where(raw, bits.read(at, 5), 0)
                at = at + 5 * raw
            shift = (63 - k).astype(np.uint64)
            for t in range(max(order, p * size), (p + 1) * size):
                q = bits.zeros(np.where(raw, 0, at)) if escaped else bits.zeros(at)
                top = bits.top(at) if (q < 32).all() else bits.top(at + q)
                skip = (q + 1 if top is not None and (q < 32).all() else np.ones_like(q)).astype(np.uint64)
                low = (((top << skip) >> np.uint64(1)) >> shift).astype(np.int64)
                v = q << k | low
                v = v >> 1 ^ -(v & 1)
                step = q + 1 + k
                if escaped:
                    v, step = np.where(raw, bits.signed(at, plain), v), np.where(raw, plain, step)
                block[t], at = v, at + step
        out[:, own], end[own] = block, at
    return out, end


def _decode_frames(data: bytes, starts: np.ndarray, default_bits: int | list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples (n x channels) of the frames at starts, and where they end; checks both checksums."""
    heads = [_read_header(data, s) for s in starts.tolist()]
    depths = default_bits if isinstance(default_bits, list) else [default_bits] * len(heads)
    shapes = [(n, channels, depth or d) for (n, channels, depth, _), d in zip(heads, depths, strict=True)]
    bits, out, ends = _Bits(data), [None] * len(heads), np.zeros(len(heads), np.int64)
    for shape in dict.fromkeys(shapes):
        n, assignment, depth = shape
        own = np.array([i for i, s in enumerate(shapes) if s == shape])
        pos = 8 * (starts[own] + np.array([heads[i][3] for i in own]))
        if assignment > 10:
            raise ValueError("a frame has a reserved channel assignment")
        channels = []
        for c in range(assignment + 1 if assignment < 8 else 2):
            side = (assignment, c) in ((8, 1), (9, 0), (10, 1))
            samples, pos = _subframes(bits, pos, n, depth + side)
            channels.append(samples)
        if assignment >= 8:
            a, b = channels
            channels = [a, a - b] if assignment == 8 else [a + b, b] if assignment == 9 else [((a << 1 | b & 1) + b) >> 1, ((a << 1 | b & 1) - b) >> 1]
        ends[own] = (pos + 7) >> 3
        whole = np.stack(channels, axis=2)
        for j, i in enumerate(own.tolist()):
            out[i] = whole[:, j]
    if (ends + 2 > len(data)).any():
        raise ValueError("a frame runs past the end of its stream")
    flat = np.frombuffer(data, np.uint8)
    if (crc16(flat, starts, ends) != flat[ends].astype(np.uint16) << 8 | flat[ends + 1]).any():
        raise ValueError("a frame's checksum is wrong")
    return out, ends + 2


def decode_many(streams: list[bytes]) -> list[tuple[Stream, list[np.ndarray]]]:
    """For each stream its metadata and its blocks (samples x channels), all checks passed."""
    infos, out = [Stream(s) for s in streams], [[] for _ in streams]
    todo = []
    for i, (info, data) in enumerate(zip(infos, streams, strict=True)):
        if info.starts is not None:
            todo += [(i, s) for s in info.starts.tolist()]
            continue
        at = info.audio
        while at < len(data):
            (block,), (at,) = _decode_frames(data, np.array([at]), info.bits)
            out[i].append(block)
    for c in range(0, len(todo), CHUNK):
        part = todo[c : c + CHUNK]
        used = sorted({i for i, _ in part})
        lows = {i: min(s for j, s in part if j == i) for i in (used[0], used[-1])}
        begin = {i: lows.get(i, 0) for i in used}  # of the first stream what went before is left out
        limit = {used[-1]: _after(infos[used[-1]], part[-1][1], len(streams[used[-1]]))}
        data, base = [], {}
        size = 0
        for i in used:
            base[i] = size - begin[i]
            data.append(streams[i][begin[i] : limit.get(i)])
            size += len(data[-1])
        blocks, _ = _decode_frames(b"".join(data), np.array([base[i] + s for i, s in part]), [infos[i].bits for i, _ in part])
        for (i, _), block in zip(part, blocks, strict=True):
            out[i].append(block)
    for info, blocks in zip(infos, out, strict=True):
        if any(info.md5) and hashlib.md5(_interleaved(blocks, info.bits)).digest() != info.md5:
            raise ValueError("the samples' MD5 is wrong")
    return list(zip(infos, out, strict=True))


def _after(info: Stream, start: int, size: int) -> int:
    later = info.starts[info.starts > start]
    return int(later[0]) if len(later) else size


def _interleaved(blocks: list[np.ndarray], bits: int) -> bytes:
    """Samples as signed little-endian numbers of whole bytes."""
    width = (bits + 7) // 8
    joined = np.concatenate([b.reshape(-1) for b in blocks]) if blocks else np.empty(0, np.int64)
    return joined.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def read_samples(data: bytes, first: int, last: int) -> np.ndarray:
    """Samples [first, last) x channels of one stream; only the blocks that hold them are decoded, if the seek table lists all."""
    info = Stream(data)
    first, last = max(first, 0), min(last, info.samples) if info.samples else last
    if first >= last:
        return np.empty((0, info.channels), np.int64)
    if info.starts is not None:
        i, j = int(np.searchsorted(info.offsets, first, side="right")) - 1, int(np.searchsorted(info.offsets, last))
        begin, end = int(info.starts[i]), int(info.starts[j]) if j < len(info.starts) else len(data)
        found, _ = _decode_frames(data[begin:end], info.starts[i:j] - begin, info.bits)
        return np.concatenate(found)[first - info.offsets[i] : last - info.offsets[i]]
    at, done, found = info.audio, 0, []
    while at < len(data) and done < last:
        (block,), (at,) = _decode_frames(data, np.array([at]), info.bits)
        found.append(block[max(first - done, 0) : max(last - done, 0)])
        done += len(block)
    return np.concatenate(found)


def payload_column(text: str = "text") -> Column:
    """A text's UTF-8 bytes, empty for null."""
    return text_or_empty(text).cast("binary")


def encode(rows: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, n_bytes, media): each content, padded, as a FLAC stream."""
    has_columns(rows, key, content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 1):
                bodies = part.column(1).to_pylist()
                media = encode_many([pad(b) for b in bodies])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(map(len, bodies), pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    body = F.coalesce(F.col(content), F.lit(b""))
    return rows.select(F.col(key).cast("long").alias(key), body.alias("content")).mapInArrow(run, f"`{key}` long, n_bytes long, media binary")


def _parts(batch: pa.RecordBatch, column: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `size` bytes of the column, one row at least."""
    first, total = 0, 0
    for i, v in enumerate(batch.column(column)):
        total += v.as_buffer().size
        if total >= size or i + 1 == batch.num_rows:
            yield batch.slice(first, i + 1 - first)
            first, total = i + 1, 0


def _block_batches(batches: Iterator[pa.RecordBatch], carried: int) -> Iterator[pa.RecordBatch]:
    """Batches of (key, media, carried columns) as batches of (key, block, sample_offset, n_samples, pcm, carried columns)."""
    names = ["key", "block", "sample_offset", "n_samples", "pcm", *(f"c{i}" for i in range(carried))]
    for batch in batches:
        for part in _parts(batch, 1):
            counts, firsts, offsets, sizes, pcm = [], [], [], [], []
            for info, found in decode_many(part.column(1).to_pylist()):
                counts.append(len(found))
                lengths = np.array([len(b) for b in found], np.int64)
                firsts.append(np.arange(len(found)))
                offsets.append(np.cumsum(lengths) - lengths)
                sizes.append(lengths)
                pcm += [_interleaved([b], info.bits) for b in found] if info.bits > 8 else _bytes_of(found)
            if pcm:
                first, row = np.concatenate(firsts), np.repeat(np.arange(len(counts)), counts)
                own = pa.array(row, mask=first > 0)
                columns = [part.column(0).take(pa.array(row)), pa.array(first, pa.int32()), pa.array(np.concatenate(offsets), pa.int64()), pa.array(np.concatenate(sizes), pa.int32()), pa.array(pcm, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *[part.column(2 + i).take(own) for i in range(carried)]], names=names)


def _typed(df: DataFrame, *names: str) -> str:
    return "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _named(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    return (b.rename_columns(names) for b in batches)


def blocks(media: DataFrame, key: str = "doc_id", carried: tuple[str, ...] = ()) -> DataFrame:
    """(key, block, sample_offset, n_samples, pcm, carried): a row per block; pcm has whole-byte signed samples, channels interleaved.

    The rows of a stream follow one another in order.  Other columns of media that are
    named in `carried` stand in the row of block 0 and are null in the others.
    """
    names = [key, "block", "sample_offset", "n_samples", "pcm", *carried]
    kept = media.select(key, "media", *carried)
    run = lambda batches: _named(_block_batches(batches, len(carried)), names)
    return kept.mapInArrow(run, f"{_typed(kept, key)[2:]}, block int, sample_offset long, n_samples int, pcm binary{_typed(kept, *carried)}")


def _bytes_of(found: list[np.ndarray]) -> list[bytes]:
    """Each block's samples of up to 8 bits as bytes."""
    data, at, out = np.concatenate([b.reshape(-1) for b in found]).astype(np.int8).tobytes(), 0, []
    for b in found:
        out.append(data[at : at + b.size])
        at += b.size
    return out


def features(samples: np.ndarray) -> str:
    """blocks:loudest:crossings:energy of signed samples."""
    negative = samples < 0
    crossings = int((negative[1:] != negative[:-1]).sum())
    return f"{-(-len(samples) // BLOCK)}:{int(np.abs(samples).max(initial=0))}:{crossings}:{int((samples * samples).sum())}"


_DIGEST = ("payload_bytes", "payload_sha256", "tail_crc32", "feature", "n_blocks", "last_offset")
_DIGEST_TYPES = ", payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, n_blocks long, last_offset long"


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches as _block_batches() gives them as batches of a row per stream, block after block."""
    held, own, at, last, types = [], None, 0, 0, []  # of the stream that goes on: its blocks, its first row, where the next block starts, where the last did

    def finish() -> tuple:
        signed = b"".join(held)
        samples = np.frombuffer(signed, np.int8).astype(np.int64)
        payload = (samples + 128).astype(np.uint8).tobytes()
        return (own[0], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), features(samples), len(held), last, *own[1:])

    for batch in batches:
        types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[batch.schema.field(i).type for i in range(5, batch.num_columns)]]
        key_of, block, offset, _, pcm, *more = (c.to_pylist() for c in batch.columns)
        out = []
        for i, b in enumerate(block):
            if b == 0:
                if own is not None:
                    out.append(finish())
                held, own, at = [], (key_of[i], *[c[i] for c in more]), 0
            if offset[i] != at:
                raise ValueError("a block is out of place")
            held.append(pcm[i])
            last, at = at, at + len(pcm[i])
        if out:
            yield _batch(out, types)
    if own is not None:
        yield _batch([finish()], types)


def digest(rows: DataFrame, key: str = "doc_id", carried: tuple[str, ...] = ()) -> DataFrame:
    """(key, payload_bytes, payload_sha256, tail_crc32, feature, n_blocks, last_offset, carried) of each 8-bit mono stream, from rows as blocks() gives them.

    Blocks are put in a row as their offsets say; one that is out of place raises ValueError.
    """
    kept = rows.select(key, "block", "sample_offset", F.lit(0).alias("n_samples"), "pcm", *carried)
    run = lambda batches: _named(_digest_batches(batches), [key, *_DIGEST, *carried])
    return kept.mapInArrow(run, f"{_typed(kept, key)[2:]}{_DIGEST_TYPES}{_typed(kept, *carried)}")


def read_back(media: DataFrame, key: str = "doc_id", carried: tuple[str, ...] = ()) -> DataFrame:
    """digest(blocks(media)): streams as PCM blocks, and these as digests, in one worker."""
    kept = media.select(key, "media", *carried)
    run = lambda batches: _named(_digest_batches(_block_batches(batches, len(carried))), [key, *_DIGEST, *carried])
    return kept.mapInArrow(run, f"{_typed(kept, key)[2:]}{_DIGEST_TYPES}{_typed(kept, *carried)}")


def _batch(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[str(i) for i in range(len(types))])


def excerpt(media: DataFrame, first: Column, last: Column, key: str = "doc_id") -> DataFrame:
    """(key, first, last, pcm) of media(key, media): samples [first, last) of each stream, by its seek table; places past an end are cut off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, a, b, streams = (batch.column(i).to_pylist() for i in range(4))
            pcm = [_interleaved([read_samples(d, x, y)], Stream(d).bits) for x, y, d in zip(a, b, streams, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(pcm, pa.binary())], names=[key, "first", "last", "pcm"])

    kept = media.select(key, first.cast("long").alias("first"), last.cast("long").alias("last"), "media")
    return kept.mapInArrow(run, f"`{key}` {kept.schema[key].dataType.simpleString()}, first long, last long, pcm binary")

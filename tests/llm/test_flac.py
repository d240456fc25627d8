from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import flac
from assay.llm.queries import op8_flac


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
            self.at += 1
        return out

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v


def crc(data: bytes, bits: int, poly: int) -> int:
    out = 0
    for byte in data:
        out ^= byte << (bits - 8)
        for _ in range(8):
            out = (out << 1 ^ poly if out >> (bits - 1) & 1 else out << 1) & ((1 << bits) - 1)
    return out


def plain_decode(data: bytes) -> bytes:
    """Samples of a mono 8-bit stream, bit by bit, straight from the format's definition; checks checksums and MD5."""
    assert data[:4] == b"fLaC"
    at, last, md5 = 4, False, b""
    while not last:
        last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            md5 = data[at + 22 : at + 38]
        at += 4 + size
    out = []
    while at < len(data):
        b = Bits(data[at:])
        assert b.take(15) == 0x7FFC and b.take(1) == 0
        assert (b.take(4), b.take(4), b.take(4), b.take(3), b.take(1)) == (2, 0, 0, 1, 0)
        lead = b.take(8)
        for _ in range(0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()):
            b.take(8)
        head = b.at // 8
        assert b.take(8) == crc(b.data[:head], 8, 0x07)
        assert b.take(1) == 0
        kind = b.take(6)
        assert b.take(1) == 0
        order = kind - 31 if kind >= 32 else kind - 8
        s = [b.signed(8) for _ in range(order)]
        if kind >= 32:
            precision, shift = b.take(4) + 1, b.signed(5)
            weights = [b.signed(precision) for _ in range(order)]
        else:
            shift, weights = 0, [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]
        method, parts = b.take(2), b.take(4)
        for p in range(1 << parts):
            k = b.take(4 + method)
            for _ in range((576 >> parts) - (order if p == 0 else 0)):
                q = 0
                while not b.take(1):
                    q += 1
                v = q << k | b.take(k)
                s.append((v >> 1 ^ -(v & 1)) + (sum(w * s[-1 - i] for i, w in enumerate(weights)) >> shift))
        b.at = (b.at + 7) // 8 * 8
        end = b.at // 8
        assert b.take(16) == crc(b.data[:end], 16, 0x8005)
        out += s
        at += end + 2
    assert hashlib.md5(bytes(x & 0xFF for x in out)).digest() == md5
    return bytes(x + 128 for x in out)


def payloads() -> list[bytes]:
    rng = random.Random(6)
    texts = ["", "a" * 576, "plain prose " * 100, "é☃漢" * 300]
    return [flac.pad(t.encode()) for t in texts] + [bytes(rng.randrange(256) for _ in range(1152)), bytes([0, 255] * 288), bytes(i % 256 for i in range(576 * 3)), bytes(int(128 + 100 * np.sin(i / 9)) for i in range(576))]


def test_streams_are_what_a_plain_decoder_reads():
    for payload, stream in zip(payloads(), flac.encode_many(payloads()), strict=True):
        assert plain_decode(stream) == payload
        ((_, blocks),) = flac.decode_many([stream])
        assert (np.concatenate(blocks)[:, 0] + 128).astype(np.uint8).tobytes() == payload


def test_padding():
    assert [len(flac.pad(bytes(n))) for n in (0, 1, 575, 576, 577)] == [576, 576, 576, 576, 1152]
    assert flac.pad(b"") == b"\xff" * 576


def test_damage_is_noticed():
    (stream,) = flac.encode_many([flac.pad(b"some text " * 90)])
    for at in (30, len(stream) - 200, len(stream) - 1):
        bad = bytearray(stream)
        bad[at] ^= 0x10
        with pytest.raises(ValueError):
            flac.decode_many([bytes(bad)])
    with pytest.raises(ValueError):
        flac.decode_many([b"RIFF"])


def test_query_reads_every_text_back(spark, sf_dir, empty_dir, table):
    want = {}
    for k, t in zip(table.doc_id, table.text, strict=True):
        body = (t or "").encode()
        p = flac.pad(body)
        want[str(k)] = (len(body), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    got = op8_flac(spark, sf_dir).collect()
    assert len(got) == len(table)
    by_payload = {}
    for r in got:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == want[str(r["doc_id"])]
        assert (r["n_blocks"], r["last_offset"]) == (r["payload_bytes"] // 576, r["payload_bytes"] - 576)
        by_payload.setdefault((r["payload_sha256"], r["n_bytes"]), set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_payload.values())
    assert op8_flac(spark, empty_dir).count() == 0


def test_blocks_carry_seekable_offsets(spark):
    rows = spark.createDataFrame([(1, bytearray(flac.pad(b"x" * 1_000)))], "doc_id long, content binary")
    media = flac.encode(rows)
    assert flac.read_back(media, carried=("n_bytes",)).collect() == flac.digest(flac.blocks(media, carried=("n_bytes",)), carried=("n_bytes",)).collect() != []
    found = flac.blocks(flac.encode(rows)).orderBy("block").collect()
    assert [(r["block"], r["sample_offset"], r["n_samples"], len(r["pcm"])) for r in found] == [(0, 0, 576, 576), (1, 576, 576, 576)]


def test_excerpts_need_only_their_blocks(spark):
    payload = flac.pad(bytes(i * i // 7 % 251 for i in range(10_000)))
    (stream,) = flac.encode_many([payload])
    signed = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    for first, last in ((0, 1), (575, 577), (1_000, 6_000), (9_999, 10_368), (10_367, 99_999), (7, 7), (20_000, 20_001), (-5, 3)):
        assert flac.read_samples(stream, first, last)[:, 0].tolist() == signed[max(first, 0) : max(last, 0)].tolist()
    broken = bytearray(stream)
    broken[flac.Stream(stream).starts[2] + 20] ^= 1  # block 2 is damaged: the others can still be read
    assert flac.read_samples(bytes(broken), 576 * 3, 576 * 5)[:, 0].tolist() == signed[576 * 3 : 576 * 5].tolist()
    with pytest.raises(ValueError):
        flac.read_samples(bytes(broken), 576 * 2, 576 * 3)
    media = spark.createDataFrame([("k", bytearray(stream))], "doc_id string, media binary")
    row = flac.excerpt(media, F.lit(570), F.lit(580)).first()
    assert (row["doc_id"], row["first"], row["last"]) == ("k", 570, 580) and np.frombuffer(row["pcm"], np.int8).tolist() == signed[570:580].tolist()


class Writer:
    """Puts a stream together bit by bit."""

    def __init__(self):
        self.bits = ""

    def put(self, v: int, n: int) -> None:
        self.bits += format(v & (1 << n) - 1, f"0{n}b") if n else ""

    def unary(self, q: int) -> None:
        self.bits += "0" * q + "1"

    def data(self) -> bytes:
        self.bits += "0" * (-len(self.bits) % 8)
        return int(self.bits, 2).to_bytes(len(self.bits) // 8, "big")


def subframe(w: Writer, samples: list[int], depth: int, kind: str) -> None:
    wasted = 3 if kind == "wasted" else 0
    code = {"constant": 0, "verbatim": 1, "wasted": 1, "rice": 8 + 2, "rice1": 8 + 1, "escape": 8}[kind]
    w.put(code << 1 | bool(wasted), 8)
    if wasted:
        w.unary(wasted - 1)
        samples, depth = [x >> wasted for x in samples], depth - wasted
    if code == 0:
        w.put(samples[0], depth)
        return
    if code == 1:
        for x in samples:
            w.put(x, depth)
        return
    order = code - 8
    residual = samples
    for _ in range(order):
        residual = [b - a for a, b in zip(residual, residual[1:], strict=False)]
    for x in samples[:order]:
        w.put(x, depth)
    method = int(kind == "rice1")
    w.put(method, 2)
    w.put(0, 4)  # one partition
    if kind == "escape":
        w.put(15, 4)
        w.put(depth, 5)
        for x in residual:
            w.put(x, depth)
        return
    k = 17 if method else 3
    w.put(k, 4 + method)
    for x in residual:
        v = x << 1 if x >= 0 else -x * 2 - 1
        w.unary(v >> k)
        w.put(v, k)


def frame(channels: list[list[int]], assignment: int, depth: int, kinds: list[str], number: int = 0) -> bytes:
    w = Writer()
    w.put(0x7FFC, 15)
    w.put(0, 1)
    w.put(7, 4)  # block size in 16 bits
    w.put(0, 4)
    w.put(assignment, 4)
    w.put(0, 3)  # depth as in the stream's information
    w.put(0, 1)
    w.put(number, 8)
    w.put(len(channels[0]) - 1, 16)
    w.put(crc(w.data(), 8, 0x07), 8)
    for i, (samples, kind) in enumerate(zip(channels, kinds, strict=True)):
        subframe(w, samples, depth + ((assignment, i) in ((8, 1), (9, 0), (10, 1))), kind)
    body = w.data()
    return body + crc(body, 16, 0x8005).to_bytes(2, "big")


def stream_of(frames: list[bytes], channels: list[list[int]], depth: int, block: int) -> bytes:
    n, width = len(channels[0]), (depth + 7) // 8
    flat = b"".join(x.to_bytes(width, "little", signed=True) for row in zip(*channels, strict=True) for x in row)
    bits = 8_000 << 44 | len(channels) - 1 << 41 | depth - 1 << 36 | n
    info = (block << 16 | block).to_bytes(4, "big") + bytes(6) + bits.to_bytes(8, "big") + hashlib.md5(flat).digest()
    return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + b"".join(frames)


@pytest.mark.parametrize("kind", ["constant", "verbatim", "wasted", "rice", "rice1", "escape"])
@pytest.mark.parametrize("depth", [8, 16, 24])
def test_every_kind_of_subframe(kind, depth):
    rng = random.Random(depth)
    top = 1 << (depth - 1)
    samples = [rng.randrange(-top, top) >> 3 << 3 for _ in range(60)] if kind in ("verbatim", "wasted", "escape", "rice1") else [40 if kind == "constant" else round(50 * np.sin(i / 5)) for i in range(60)]
    halves = [samples[:40], samples[40:]]
    stream = stream_of([frame([h], 0, depth, [kind], i) for i, h in enumerate(halves)], [samples], depth, 40)
    ((info, found),) = flac.decode_many([stream])
    assert (info.bits, info.channels, info.samples, [len(b) for b in found]) == (depth, 1, 60, [40, 20])
    assert np.concatenate(found)[:, 0].tolist() == samples
    assert flac.read_samples(stream, 35, 45)[:, 0].tolist() == samples[35:45]  # no seek table


@pytest.mark.parametrize("assignment", [1, 8, 9, 10])
def test_stereo(assignment):
    rng = random.Random(assignment)
    left = [rng.randrange(-30_000, 30_000) for _ in range(50)]
    right = [max(-32_768, min(32_767, x + rng.randrange(-900, 900))) for x in left]
    side = [a - b for a, b in zip(left, right, strict=True)]
    middle = [a + b >> 1 for a, b in zip(left, right, strict=True)]
    coded = {1: [left, right], 8: [left, side], 9: [side, right], 10: [middle, side]}[assignment]
    stream = stream_of([frame(coded, assignment, 16, ["verbatim", "rice1"])], [left, right], 16, 50)
    ((_, found),) = flac.decode_many([stream])
    assert found[0].T.tolist() == [left, right]


def test_blocks_out_of_place_are_noticed(spark):
    rows = spark.createDataFrame([(1, 0, 0, bytearray(b"ab")), (1, 1, 3, bytearray(b"cd"))], "doc_id long, block int, sample_offset long, pcm binary").coalesce(1)
    with pytest.raises(Exception, match="out of place"):
        flac.digest(rows).collect()

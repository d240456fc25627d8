"""op13 by exact round trips, and records against the plain rule."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
from collections import defaultdict
from pathlib import Path

import pytest

from assay.functions.durable import folder
from assay.llm import warc
from assay.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, archive string, number long, key string, digest int"
ROWS = [
    (1, "http://a.example/x?y=1", "<p>one</p>"), (2, "http://a.example/2", "<p>two</p>\r\n\r\nWARC/1.1\r\n"), (3, None, "<p>one</p>"), (4, "", None), (5, "http://b.example/ü \r\nX-Bad: 1", ""),
    (6, "http://c.example", "é漢\U0001f600"), (7, "u", "x" * 3_000_000), (None, "n", "<p>one</p>"), (None, "m", "alone"), (None, "m", "alone"), (8, "v", "<p>one</p>"), (8, "v", "<p>one</p>"), (9, "w", "last\r\n\r\n"),
]


def plain(rows: list[tuple], least: int = 0) -> list[tuple]:
    groups = defaultdict(list)
    for i, (k, _, h) in enumerate(rows):
        groups[(h or "").encode()].append((k is not None, k or 0, i))
    out = []
    for body, members in groups.items():
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        has, top, first = max(members)
        for _, _, i in members:
            keep = len(body) < least or i == first
            out.append((rows[i][0], len(body), digest, "response" if keep else "revisit", None if keep or not has else top))
    return sorted(out, key=str)


def pages(spark):
    return spark.createDataFrame([(*r, "a", 1, "k", 2) for r in ROWS], SCHEMA).repartition(3)


@pytest.mark.parametrize("least", [0, 5, 100])
def test_round_trip(spark, least):
    got = warc.round_trip(spark, pages(spark), least=least)
    assert sorted(map(tuple, got.select("key", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == plain(ROWS, least)
    uris = {r["key"]: r["target_uri"] for r in got.collect()}
    assert uris[5] == "http://b.example/ü%20%0D%0AX-Bad:%201" and uris[4] is None


def test_each_record_is_a_member_at_its_offset(spark):
    raw, done = folder(spark, "warc"), folder(spark, "warc")
    manifest = warc.write_pages(pages(spark), raw)
    archives = warc.normalise(warc.decisions(manifest), raw, done)
    assert archives.agg({"records": "sum"}).first()[0] == len(ROWS) + archives.count()
    html = {warc.digest_of((h or "").encode()): (h or "").encode() for _, _, h in ROWS}
    ids, refers = set(), set()
    for row in archives.collect():
        data = Path(done.removeprefix("file://"), row["archive"]).read_bytes()
        lines = [json.loads(x) for x in Path(done.removeprefix("file://"), row["archive"] + ".idx").read_text().splitlines()]
        assert [x["offset"] for x in lines] == [sum(y["length"] for y in lines[:i]) for i in range(len(lines))] and sum(x["length"] for x in lines) == len(data) == row["bytes"]
        for x in lines:
            headers, body = warc.record_at(lambda n, at, data=data: data[at : at + n], x["offset"], x["length"])
            if x["type"] == "warcinfo":
                continue
            ids.add(x["id"])
            head, _, payload = body.partition(b"\r\n\r\n")
            if x["type"] == "revisit":
                refers.add(warc.value_of(headers, "WARC-Refers-To"))
                assert payload == b"" and warc.value_of(headers, "WARC-Profile") == warc.PROFILE
            else:
                assert payload == html[x["digest"].removeprefix("sha1:")]
    assert len(ids) == len(ROWS) and refers <= ids
    # the archives before: one member each, the same payloads in full
    for row in manifest.select("archive").distinct().collect():
        stream = zlib_members(Path(raw.removeprefix("file://"), row["archive"]).read_bytes())
        assert len(stream) == 1


def zlib_members(data: bytes) -> list[bytes]:
    import zlib

    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return out


def record(kind: str, body: bytes, **more: str) -> bytes:
    return warc.head_of([("WARC-Type", kind), *more.items()], len(body)) + body + b"\r\n\r\n"


class Kept(warc.Sink):
    def __init__(self):
        self.out, self.level, self.size = io.BytesIO(), 6, 0


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_foreign_archives(monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    parts = [record("warcinfo", b"a: b\r\n"), record("request", b"GET / HTTP/1.1\r\n\r\n"), record("resource", b"\r\n\r\n" * 3, Odd="x:y"), record("metadata", b"")]
    together = b"".join(parts)
    for data in (together, gzip.compress(together), b"".join(map(gzip.compress, parts)), gzip.compress(parts[0]) + bytes(600) + gzip.compress(b"".join(parts[1:])) + bytes(512)):
        sink = Kept()
        lines = list(warc.rewrite(io.BytesIO(data).read, sink))
        assert [x["type"] for x in lines] == ["warcinfo", "request", "resource", "metadata"]
        assert b"".join(zlib_members(sink.out.getvalue())) == together
        assert zlib_members(sink.out.getvalue()) == parts
    assert list(warc.rewrite(io.BytesIO(b"").read, Kept())) == []


@pytest.mark.parametrize("damage", [lambda d: gzip.compress(d)[:-9], lambda d: gzip.compress(d[:-30]), lambda d: d[:-2], lambda d: b"no archive" + d, lambda d: d.replace(b"Content-Length: 5", b"Content-Length: 3")])
def test_damaged_archives_are_errors(damage):
    data = record("resource", b"hello") + record("resource", b"there" * 20)
    with pytest.raises((ValueError, warc.zlib.error)):
        list(warc.rewrite(io.BytesIO(damage(data)).read, Kept()))


def test_archives_that_differ_from_their_manifest_are_errors():
    data = record("response", b"HTTP/1.1 200 OK\r\n\r\nx") * 2
    for told in ([(0, True, ("a", 0), 1)], [(1, True, ("a", 0), 1)], [(i, True, ("a", 0), 1) for i in range(3)]):
        with pytest.raises(ValueError):
            list(warc.rewrite(io.BytesIO(data).read, Kept(), told))


def test_files_are_normalised_without_a_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"x{i}.warc.gz").write_bytes(gzip.compress(b"".join(record("response", warc.http_head(2) + b"%02d" % j, **{"WARC-Payload-Digest": "sha1:" + warc.digest_of(b"%02d" % j), warc.KEY: str(j)}) for j in range(i + 1))))
    names = spark.createDataFrame([(f"x{i}.warc.gz",) for i in range(3)], "archive string")
    done = warc.normalise(names, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    got = warc.read_records(done, f"file://{tmp_path}/out").collect()
    assert sorted(r["key"] for r in got) == [0, 0, 0, 1, 1, 2] and {r["record_type"] for r in got} == {"response"}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["op13_warc"](spark, str(tmp_path)).collect() == []


def test_whole_table(spark):
    at = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/pages.parquet").select("page_id", "url", "html").collect()]
    got = QUERIES["op13_warc"](spark, at)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)

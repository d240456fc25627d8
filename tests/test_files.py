"""Listings, reads by position, files written by tasks, and what is deleted behind them."""

from __future__ import annotations

import datetime
import gzip
import json
import os
import resource
import struct
import subprocess
import sys
import zipfile
from pathlib import Path
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from assay.functions.durable import durable, folder, scope, shared_dir
from assay.functions.stores import address, store
from assay.operators import archive
from assay.operators.archive import ArchiveLimits
from assay.plans import guard
from assay.plans.policy import Policy
from assay.sources.folder_sink import write_files, write_sanitized_files
from assay.sources.listing import folders, list_files, stream_files
from assay.sources.payloads import from_bytes, from_files
from assay.sources.ranged import locate, with_content
from assay.streaming import drops
from assay.wrapped import compound, drawn, tarred, zipped

PNG = b"\x89PNG\r\n\x1a\n" + bytes(20) + b"IEND\xae\x42\x60\x82"
FILES = {
    "a/notes.txt": b"just prose\n", "a/b/pic.svg": drawn(b"t"), "a/b/slip.zip": zipped(("../x", b"1"), ("word/document.xml", b"2")), "a/empty.txt": b"", "c/old.doc": compound("WordDocument", b"text"),
    "c/tail.png": PNG + b"#!/bin/sh and more" * 5_000, "c/x.tgz": gzip.compress(tarred(("ln", b"2", b"", "/etc"))), "c/pic.svgz": gzip.compress(drawn(b"z")), "c/in.zip": zipped(("in.zip", zipped(("deep.zip", b"PK")))), "d/%41 b+.txt": b"odd name",
    "d/iso.bin": bytes(0x8001) + b"CD001" + bytes(3000), "_hidden/x": b"1", "d/.dot": b"2", "d/broken.zip": b"PK\x03\x04" + bytes(40),
}


@pytest.fixture
def drop(tmp_path):
    for name, body in FILES.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(body)
    return tmp_path


SEEN = {n: b for n, b in FILES.items() if not n.startswith("_") and "/." not in n}


def names_of(paths, root) -> list[str]:
    return sorted(unquote(p).removeprefix(f"file://{root}/") for p in paths)


@pytest.mark.parametrize("least", [1, 3, 100])
def test_listing_finds_every_file_once(spark, drop, least):
    got = list_files(spark, f"file://{drop}", least).collect()
    assert names_of([r["path"] for r in got], drop) == sorted(SEEN)
    assert {unquote(r["path"]).removeprefix(f"file://{drop}/"): r["size"] for r in got} == {n: len(b) for n, b in SEEN.items()}
    shares = folders([f"file://{drop}"], least)
    assert len(shares) >= min(least, 4) and len({s.path for s in shares}) == len(shares)
    if least == 3:
        assert list_files(spark, f"file://{drop}", least).rdd.getNumPartitions() == len(shares)


def test_listing_of_files_several_roots_and_nothing(spark, drop, tmp_path_factory):
    got = list_files(spark, [f"file://{drop}/a/b", f"file://{drop}/a/notes.txt"]).collect()
    assert names_of([r["path"] for r in got], drop) == ["a/b/pic.svg", "a/b/slip.zip", "a/notes.txt"]
    assert list_files(spark, f"file://{tmp_path_factory.mktemp('none')}").collect() == []
    with pytest.raises(Exception, match="nowhere"):
        list_files(spark, "file:///nowhere/at/all").collect()


def test_addresses():
    assert address("file:///a", "/a/b") == "file:///a/b" and address("/a", "/a/b") == "file:///a/b"
    assert address("s3://bucket/x", "bucket/x/y") == "s3://bucket/x/y" and address("file:///a", "/a/%41 b") == "file:///a/%2541%20b" and address("hdfs://host:1/x", "/x/y") == "hdfs://host:1/x/y"
    assert store("file:///tmp")[1] == "/tmp"


def test_parts_of_files(spark, drop):
    rows = {r["filename"]: r for r in locate(list_files(spark, f"file://{drop}"), head=100, tail=9).collect()}
    assert len(rows) == len(SEEN)
    for n, body in SEEN.items():
        r = rows[n.rsplit("/", 1)[1]]
        assert (bytes(r["content"]), bytes(r["tail"]), r["size"]) == (body[:100], body[-9:] if body else b"", len(body))
    assert rows["slip.zip"]["listed"]["names"] == ["../x", "word/document.xml"] and rows["old.doc"]["streams"][1] == "WordDocument"
    assert rows["notes.txt"]["listed"] is None and rows["notes.txt"]["streams"] is None
    over = {r["filename"]: r["oversized"] for r in locate(list_files(spark, f"file://{drop}"), max_size=100).collect()}
    assert over["tail.png"] and not over["notes.txt"]


def test_whole_contents_up_to_a_bound(spark, drop):
    got = with_content(list_files(spark, f"file://{drop}/a"), 20).collect()
    assert {r["path"].rsplit("/", 1)[1]: r["content"] and bytes(r["content"]) for r in got} == {"notes.txt": b"just prose\n", "pic.svg": None, "slip.zip": None, "empty.txt": b""}


def test_a_file_that_is_gone_gives_no_row(spark, drop):
    files = durable(list_files(spark, f"file://{drop}"))
    (drop / "a/notes.txt").unlink()
    assert locate(files).count() == len(SEEN) - 1


def test_scans_by_position_equal_scans_of_contents(spark, drop):
    policy = Policy(max_size=50_000, archive_limits=ArchiveLimits(verify_sizes=True))
    by_position = guard.scan_files(spark, f"file://{drop}", policy)
    whole = guard.scan(from_files(spark, f"file://{drop}", policy.max_size), policy)
    plain = lambda rows: {unquote(r["payload_id"]).replace("file:///", "file:/") if "%25" in r["payload_id"] else r["payload_id"].replace("file:///", "file:/"): r.asDict(recursive=True) | {"payload_id": None} for r in rows.collect()}
    a, b = plain(by_position), plain(whole)
    assert len(a) == len(SEEN) and a == b


def sparse_zip(path: Path, size: int, entries: int = 1) -> None:
    """A ZIP file of entries that are stored, all zeros and take no room on disk, and a last one of text."""
    heads, each, at = [], size // entries, 0
    with open(path, "wb") as f:
        for i in range(entries + 1):
            name, n = (b"zeros%d.bin" % i, each) if i < entries else (b"last.txt", 4)
            crc = 0 if i < entries else 0x9BE3E0A3
            common = struct.pack("<HHHHHIIIHH", 20, 0, 0, 0, 0x21, crc, n, n, len(name), 0)
            f.seek(at)
            f.write(b"PK\x03\x04" + common + name)
            heads.append(b"PK\x01\x02" + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, at) + name)
            at += 30 + len(name) + n
        f.seek(at - 4)
        f.write(b"1234")
        f.write(b"".join(heads) + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(heads), len(heads), sum(map(len, heads)), at, 0))


def test_a_file_beyond_the_size_of_a_value(spark, tmp_path):
    big = tmp_path / "big.zip"
    sparse_zip(big, 3 << 30)
    assert big.stat().st_size > 3 << 30 and [e.filename for e in zipfile.ZipFile(big).infolist()] == ["zeros0.bin", "last.txt"]
    (row,) = guard.scan_files(spark, f"file://{tmp_path}").collect()
    assert row["detected"]["mime"] == "application/zip" and row["archive"]["entry_count"] == 2 and row["archive"]["total_uncompressed"] == 3 << 30 and row["archive"]["truncated"]
    assert {f["code"] for f in row["findings"]} == {"archive.bomb_size"} and row["size"] == big.stat().st_size
    # the same reads under a limit of memory
    code = f"""
import resource
resource.setrlimit(resource.RLIMIT_AS, (1 << 30, 1 << 30))
from assay.functions.stores import opened
from assay.operators import archive, containers
with opened("file://{big}") as f:
    print(containers.zip_listing(f, f[:2048])[0], len(archive.list_zip("p", f, archive.ArchiveLimits())[0]), f[len(f) - 22:][:2])
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[1])}, check=True)
    assert done.stdout.strip() == "['zeros0.bin', 'last.txt'] 3 b'PK'"
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1 << 20  # KB


def lying(data: bytes, name: bytes, size: int) -> bytes:
    """data, a ZIP file, whose directory gives another size for an entry."""
    out, at = bytearray(data), data.index(b"PK\x01\x02")
    while out[at + 46 : at + 46 + len(name)] != name:
        at = data.index(b"PK\x01\x02", at + 4)
    out[at + 24 : at + 28] = struct.pack("<I", size)
    return bytes(out)


def damaged(data: bytes, name: bytes) -> bytes:
    """data with zeros in the packed bytes of an entry."""
    at = data.index(name) + len(name)
    return data[: at + 2] + b"\xff\xff\xff\xff" + data[at + 6 :]


def test_sizes_are_verified_in_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "MEASURED", 2_000)
    body = [(f"e{i:03}.txt", os.urandom(400)) for i in range(60)]
    good = zipped(*body)
    files = {"good.zip": good, "lies.zip": lying(lying(good, b"e050.txt", 10), b"e031.txt", 10), "bad.zip": damaged(zipped(("x.txt", b"y" * 4000), ("e.txt", b"z" * 4000)), b"x.txt"), "nested.zip": zipped(("in.zip", lying(zipped(("i.txt", b"q" * 99)), b"i.txt", 5), ), stored=True), "none.zip": zipped()}
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    limits = ArchiveLimits(verify_sizes=True)
    located = durable(list_files(spark, f"file://{tmp_path}").select(F.element_at(F.split("path", "/"), -1).alias("payload_id"), "path", F.lit("zip").alias("archive")))
    contents = spark.createDataFrame([(n, "zip", bytearray(b)) for n, b in files.items()], "payload_id string, archive string, content binary")
    plain = lambda rows: {r["payload_id"]: ([(f["code"], f["message"]) for f in r["archive_findings"]], r["archive"]) for r in rows.collect()}
    got = plain(archive.inspect(located, limits, path="path"))
    assert got == plain(archive.inspect(contents, limits))
    assert ("archive.size_mismatch", "larger than declared: e031.txt") in got["lies.zip"][0] and ("archive.corrupt", "corrupt entry: x.txt") in got["bad.zip"][0]
    # one archive alone is dealt to several tasks
    one = located.where("payload_id = 'good.zip'")
    listed = durable(archive.entries(one, limits, path="path"))
    assert listed.where("measured = 'due'").count() == 60
    dealt = archive.dealt(listed, one.select("payload_id", "path"))
    assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert {r["measured"] for r in archive.measured(listed, one, limits).where("idx >= 0").collect()} == {"fits"}


def stream_once(spark, source, out, checkpoint) -> None:
    drops.run(source, f"{out}/results", f"{out}/{checkpoint}").awaitTermination()


def test_streams_see_files_without_bytes_and_renamed_ones(spark, drop, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")

    def once() -> None:
        found = drops.stream_located(spark, f"file://{drop}").withColumn("codes", F.transform(guard.size_findings(F.col("size"), F.col("oversized"), Policy()), lambda f: f["code"]))
        write = lambda batch, number: batch.select("filename", "codes").write.mode("overwrite").parquet(f"{out}/results/batch={number}")
        found.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    once()
    late = tmp_path_factory.mktemp("elsewhere") / "renamed.txt"
    late.write_bytes(b"")
    once()  # nothing new
    old = datetime.datetime.now().timestamp() - 600
    os.utime(late, (old, old))
    late.rename(drop / "c" / "renamed.txt")
    (drop / "a/notes.txt").write_bytes(b"written to again\n")
    once()
    rows = spark.read.parquet(f"{out}/results").collect()
    seen = sorted((r["filename"], r["codes"]) for r in rows)
    names = [n for n, _ in seen]
    assert sorted(names) == sorted([n.rsplit("/", 1)[1] for n in SEEN] + ["renamed.txt", "notes.txt"])
    assert dict(seen)["empty.txt"] == dict(seen)["renamed.txt"] and "size.empty" in dict(seen)["empty.txt"]
    assert {r["filename"]: r["batch"] for r in rows if r["filename"] in ("renamed.txt", "empty.txt")}["empty.txt"] == 0


def written_tables(spark) -> set[str]:
    at = Path(shared_dir(spark).removeprefix("file://"))
    return {p.name for p in at.iterdir()}


def test_streams_leave_no_table_behind(spark, tmp_path, tmp_path_factory):
    out, before = tmp_path_factory.mktemp("out"), written_tables(spark)
    for i in range(2):
        (tmp_path / f"{i}.zip").write_bytes(zipped(("x", b"1")))
        (tmp_path / f"{i}.svg").write_bytes(drawn(b"1"))
        stream_once(spark, drops.stream_located(spark, f"file://{tmp_path}"), out, "checkpoint")
    assert spark.read.parquet(f"{out}/results").count() == 4
    assert written_tables(spark) == before


def test_scopes_delete_their_own(spark):
    before = written_tables(spark)
    outer = durable(spark.range(3))
    with scope(spark):
        durable(spark.range(4))
        with scope(spark):
            durable(spark.range(5))
        assert len(written_tables(spark) - before) == 2
        os.makedirs(folder(spark, "x").removeprefix("file://"))
    assert len(written_tables(spark) - before) == 1 and outer.count() == 3
    with pytest.raises(RuntimeError), scope(spark):
        durable(spark.range(1))
        raise RuntimeError
    with pytest.raises(Exception, match="stop"), scope(spark):
        durable(spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("x")))
    assert len(written_tables(spark) - before) == 1


def files_in(at: Path) -> dict[str, bytes]:
    return {str(p.relative_to(at)): p.read_bytes() for p in at.rglob("*") if p.is_file() and not p.name.startswith((".", "_")) and "_pending" not in p.parts}


def test_files_are_written_one_for_each_payload(spark, tmp_path):
    rows = [("1", "x.txt", b"one"), ("2", "x.txt", b"two"), (None, None, b""), ("4", "a/../b\\c", None)]
    df = spark.createDataFrame([(a, b, c and bytearray(c), 1) for a, b, c in rows], "payload_id string, filename string, content binary, number int").repartition(2)
    write_files(df, f"file://{tmp_path}/out")
    got = files_in(tmp_path / "out")
    assert sorted(got.values()) == [b"", b"", b"one", b"two"] and all(n.startswith("part-0000") for n in got)
    index = [json.loads(x) | {"part": p.parent.name} for p in (tmp_path / "out").glob("part-*/_index.jsonl") for x in p.read_text().splitlines()]
    assert {(x["payload_id"], got[f"{x['part']}/{x['file']}"]) for x in index} == {("1", b"one"), ("2", b"two"), (None, b""), ("4", b"")}
    assert not any(".." in Path(n).parts for n in got) and not (tmp_path / "out/_pending").exists()
    write_files(df.where("payload_id = '1'"), f"file://{tmp_path}/out")
    assert len(files_in(tmp_path / "out")) == 5
    write_files(df.where("payload_id = '2'"), f"file://{tmp_path}/out", mode="overwrite")
    assert list(files_in(tmp_path / "out").values()) == [b"two"]


def test_a_failed_job_writes_nothing(spark, tmp_path):
    df = spark.range(100, numPartitions=4).select(F.col("id").cast("string").alias("payload_id"), F.lit("x").alias("filename"), F.when(F.col("id") == 90, F.raise_error(F.lit("stop"))).otherwise(F.lit("y")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="stop"):
        write_files(df, f"file://{tmp_path}/out")
    assert files_in(tmp_path) == {}


def test_sanitised_files(spark, tmp_path):
    results = guard.scan(from_bytes(spark, [("a.svg", drawn(b"1")), ("a.svg", drawn(b"2")), ("b.txt", b"prose")]))
    write_sanitized_files(results, f"file://{tmp_path}/out")
    got = files_in(tmp_path / "out")
    assert len(got) == 2 and all(n.endswith("-a.svg") for n in got) and not any(b"script" in b for b in got.values())


def test_stream_of_listings_is_a_stream(spark, drop):
    assert stream_files(spark, f"file://{drop}").isStreaming

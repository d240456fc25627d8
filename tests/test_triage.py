"""The policy over single payloads: files built here, verdicts known beforehand."""

from __future__ import annotations

import gzip
import io
import os
import struct
import subprocess
import sys
import tarfile
import zipfile
import zlib
from pathlib import Path

import pytest

from assay.functions.detect import detect
from assay.functions.values import CRITICAL
from assay.plans import guard, http
from assay.plans.policy import Policy
from assay.sources.payloads import UnsupportedSource, from_bytes, read_payloads

ROOT = Path(__file__).resolve().parents[1]


def png() -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped(entries: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in entries.items():
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def tarred(name: str) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        info = tarfile.TarInfo(name)
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    return out.getvalue()


SVG = b'<svg xmlns="http://www.w3.org/2000/svg" onload="x()"><script>1</script><rect width="1"/></svg>'
CASES = {
    "photo.png": (png(), "image/png", True, set()),
    "photo.jpg": (png(), "image/png", False, {"extension.mismatch"}),
    "shell.php": (b"<?php system($_GET['c']); ?>", "application/x-httpd-php", False, {"type.blocked", "filename.dangerous_extension"}),
    "tool.exe": (b"MZ" + bytes(58) + b"\x40\0\0\0PE\0\0" + bytes(80), "application/vnd.microsoft.portable-executable", False, {"type.blocked"}),
    "pic.svg": (SVG, "image/svg+xml", True, {"svg.script", "svg.event_handler"}),
    "data.zip": (zipped({"a.txt": b"hello"}), "application/zip", True, set()),
    "slip.zip": (zipped({"../../etc/passwd": b"x"}), "application/zip", False, {"archive.path_traversal"}),
    "bomb.zip": (zipped({"zeros": bytes(5 << 20)}), "application/zip", False, {"archive.bomb_ratio"}),
    "slip.tar": (tarred("../x"), "application/x-tar", False, {"archive.path_traversal"}),
    "log.gz": (gzip.compress(b"text " * 50), "application/gzip", True, set()),
    "both.png": (png() + b"<script>alert(1)</script>", "image/png", False, {"polyglot.embedded_html_script", "polyglot.trailing_data"}),
    "report.docx": (zipped({"[Content_Types].xml": b"", "word/document.xml": b"<w/>"}), "application/vnd.openxmlformats-officedocument.wordprocessingml.document", True, set()),
    "notes.txt": (b"just prose\n", "text/plain", True, set()),
    "empty.txt": (b"", None, False, {"size.empty"}),
    "../up.png": (png(), "image/png", False, {"filename.path_traversal"}),
}


@pytest.fixture(scope="module")
def results(spark):
    found = guard.scan(from_bytes(spark, [(n, c[0]) for n, c in CASES.items()])).cache()
    return found


def test_types_verdicts_and_findings(results):
    got = {r["filename"]: r for r in results.collect()}
    assert set(got) == set(CASES)
    wrong = []
    for name, (_, mime, ok, codes) in CASES.items():
        r = got[name]
        found = {f["code"] for f in r["findings"]}
        if (mime and r["detected"]["mime"] != mime) or r["ok"] != ok or not codes <= found:
            wrong.append((name, r["detected"]["mime"], r["ok"], sorted(found)))
    assert not wrong


def test_sanitised_svg_and_safe_names(results):
    got = {r["filename"]: r for r in results.collect()}
    clean = bytes(got["pic.svg"]["sanitized"])
    assert b"script" not in clean and b"onload" not in clean and b"rect" in clean
    assert got["../up.png"]["safe_filename"] == "up.png"


def test_split_statuses_and_exit_code(results):
    accepted, rejected = guard.split(results)
    assert accepted.count() == sum(c[2] for c in CASES.values()) and rejected.count() == len(CASES) - accepted.count()
    status = {r["payload_id"]: r["status"] for r in http.problem(results, Policy()).collect()}
    names = list(CASES)
    assert status[str(names.index("empty.txt"))] == 413 and status[str(names.index("photo.jpg"))] == 415 and status[str(names.index("slip.zip"))] == 422
    assert http.exit_code(results).first()[0] == 1 and http.exit_code(accepted).first()[0] == 0
    with pytest.raises(guard.Rejected):
        guard.check(from_bytes(results.sparkSession, [("x.php", b"<?php 1;")]))


def test_policies(spark):
    one = lambda policy: guard.scan(from_bytes(spark, [("photo.png", png())]), policy).first()
    assert not one(Policy(allowed=["application/pdf"]))["ok"]
    assert one(Policy(allowed=["image/*"]))["ok"]
    assert not one(Policy(max_size=10))["ok"]
    assert one(Policy(max_size=10, reject_threshold=CRITICAL))["ok"]
    with pytest.raises(ValueError):
        Policy(allowed=["/"])


def test_filters_on_simple_scans_stay_small(spark):
    rows = guard.scan_simple(from_bytes(spark, [(n, c[0]) for n, c in CASES.items()]))
    assert http.problem(rows, Policy()).count() > 0
    assert guard.roll_up(rows).count() > 0
    assert guard.scan_simple(from_bytes(spark, [("a.txt", b"x")])).first()["ok"]


def test_sources(spark, tmp_path):
    (tmp_path / "a b.txt").write_bytes(b"hello")
    (tmp_path / "none.txt").write_bytes(b"")
    (tmp_path / "large.bin").write_bytes(bytes(100))
    got = {r["filename"]: (r["size"], r["oversized"]) for r in read_payloads(spark, f"file://{tmp_path}", max_size=50).collect()}
    assert got == {"a b.txt": (5, False), "none.txt": (0, False), "large.bin": (100, True)}
    with pytest.raises(UnsupportedSource):
        read_payloads(spark, 5)


def test_detection_of_nothing(spark):
    assert detect(from_bytes(spark, [("x", b"")])).first()["detected"]["category"] == "unknown"


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    rows = [(None, "slip.zip", CASES["slip.zip"][0]), (None, "pic.svg", SVG), ("7", "data.zip", CASES["data.zip"][0]), ("7", "slip.zip", CASES["slip.zip"][0]), ("7", "pic.svg", SVG)]
    found = guard.scan(spark.createDataFrame([(k, n, bytearray(b)) for k, n, b in rows], "payload_id string, filename string, content binary")).collect()
    assert sorted((str(r["payload_id"]), r["filename"], r["ok"]) for r in found) == sorted((str(k), n, n != "slip.zip") for k, n, _ in rows)
    assert all(r["archive"] is not None for r in found if r["filename"] != "pic.svg")
    assert all(r["sanitized"] is not None for r in found if r["filename"] == "pic.svg")


def test_a_missing_report_stops_the_job(spark, monkeypatch):
    look = guard.inspect_archives
    monkeypatch.setattr(guard, "inspect_archives", lambda *a: look(*a).where("false"))
    with pytest.raises(Exception, match="no report"):
        guard.scan(from_bytes(spark, [("slip.zip", CASES["slip.zip"][0])])).collect()


def test_the_package_reaches_executors_by_itself(tmp_path):
    """From another folder, with the package on the driver's path only."""
    code = (
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "from assay.plans import guard\n"
        "from assay.sources.payloads import read_payloads\n"
        f"rows = guard.scan(read_payloads(spark, [('pic.svg', {SVG!r})])).collect()\n"
        "assert rows[0]['ok'] and rows[0]['sanitized'] is not None\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-2000:]

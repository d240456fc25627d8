"""Streams, SQL functions, the command line, HTTP bodies."""

from __future__ import annotations

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from assay import cli
from assay.plans import guard, http, sql
from assay.plans.policy import Policy
from assay.sources.payloads import from_bytes, write_sanitized_file
from assay.streaming import drops
from assay.wrapped import compound, drawn, tarred, zipped


@pytest.fixture
def folder(tmp_path):
    files = {"notes.txt": b"just prose\n", "pic.svg": drawn(b"t"), "slip.zip": zipped(("../x", b"1"))}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    return tmp_path


def test_dropped_files_are_scanned_once(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    for name in (None, "later.exe"):
        if name:
            (folder / name).write_bytes(b"MZ" + bytes(58) + b"\x40\0\0\0PE\0\0" + bytes(80))
        drops.run(drops.stream_payloads(spark, f"file://{folder}"), f"{out}/results", f"{out}/checkpoint").awaitTermination()
    got = {r["filename"]: (r["ok"], r["batch"], r["sanitized"] is not None) for r in spark.read.parquet(f"{out}/results").collect()}
    assert got == {"notes.txt": (True, 0, False), "pic.svg": (True, 0, True), "slip.zip": (False, 0, False), "later.exe": (False, 1, False)}


def test_simple_scans_of_a_stream_and_rates_by_window(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 12)
    rows = [(str(i), n, bytearray(b), at + datetime.timedelta(minutes=m)) for i, (n, b, m) in enumerate([("a.txt", b"x y", 0), ("b.php", b"<?php 1;", 1), ("c.txt", b"z", 7), ("d.txt", b"z", 60)])]
    spark.createDataFrame(rows, "payload_id string, filename string, content binary, modificationTime timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = drops.scan_stream(stream).writeStream.format("memory").queryName("simple_scans").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["filename"]: r["ok"] for r in spark.table("simple_scans").collect()} == {"a.txt": True, "b.php": False, "c.txt": True, "d.txt": True}
    timed = stream.withColumn("ok", ~F.col("filename").endswith(".php"))
    query = drops.rejection_rates(timed).writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r["window"]["start"].minute, r["rejected"], r["payloads"]) for r in spark.table("rates").collect())
    assert got == [(0, 1, 2), (5, 0, 1)]  # the last window is still open


def test_functions_in_sql(spark):
    names = sql.register(spark)
    assert {"classify_url", "file_extension", "archive_entries", "svg_nodes"} <= set(names)
    row = spark.sql("SELECT classify_url(' java\\tscript:x') AS a, file_extension('x.tar.GZ') AS b, file_stem('a/b.txt') AS c, nested_archive('q.zip') AS d, mime_for_extension('png') AS e").first()
    assert tuple(row) == ("script", "gz", "b", True, "image/png")
    spark.createDataFrame([("z", "zip", bytearray(zipped(("a", b"12"), ("b", b"3")))), ("t", "tar", bytearray(tarred(("c", b"0", b"4", "")))), ("n", None, None)], "id string, kind string, content binary").createOrReplaceTempView("files")
    got = spark.sql("SELECT id, name, size FROM files, LATERAL archive_entries(id, kind, content) WHERE idx >= 0").collect()
    assert sorted(map(tuple, got)) == [("t", "c", 1), ("z", "a", 2), ("z", "b", 1)]
    row = spark.sql("SELECT sanitize_filename('..\\\\a/\ufb01 <x>.TXT') AS a, all_extensions('x.tar.gz') AS b, filename_findings('a.php.jpg')[0].code AS c").first()
    assert tuple(row) == ("fi _x_.TXT", ["tar", "gz"], "filename.double_extension")
    spark.createDataFrame([("p", bytearray(b"\x89PNG\r\n\x1a\n" + bytes(9) + b"<?php 1;")), ("z", bytearray(zipped(("word/x", b"1")))), ("t", bytearray(b"prose")), ("e", bytearray()), ("n", None)], "id string, content binary").createOrReplaceTempView("contents")
    got = {r["id"]: (r["e"], r["f"]) for r in spark.sql("SELECT id, get(detect_type(content).extensions, 0) AS e, transform(embedded_formats(content, detect_type(content)), f -> f.code) AS f FROM contents").collect()}
    assert got == {"p": ("png", ["polyglot.embedded_php"]), "z": ("docx", []), "t": ("txt", []), "e": (None, []), "n": (None, [])}
    spark.createDataFrame([(bytearray(drawn(b"t")),)], "content binary").createOrReplaceTempView("drawings")
    assert [r["local"] for r in spark.sql("SELECT local FROM drawings, LATERAL svg_nodes('1', content) ORDER BY node").collect()] == ["svg", "script", "text"]


def test_answers(spark):
    results = guard.scan(from_bytes(spark, [("a.png", b"<?php 1;"), ("empty.txt", b""), ("fine.txt", b"text"), ("pic.svg", drawn(b"t")), ("x.zip", zipped(("../y", b"1")))]))
    answers = {r["payload_id"]: (r["status"], json.loads(r["body"])) for r in http.problem(results, Policy()).collect()}
    assert {k: v[0] for k, v in answers.items()} == {"0": 415, "1": 413, "4": 422}
    assert all(set(b) == {"error", "message", "detected_type", "findings"} and b["error"] == "upload_rejected" for _, b in answers.values())
    assert {f["code"] for f in answers["4"][1]["findings"]} == {"archive.path_traversal"} and answers["4"][1]["findings"][0]["severity"] == "CRITICAL"
    assert http.status(F.lit(None), Policy()) is not None
    whole = {r["payload_id"]: json.loads(r["json"]) for r in http.to_json(results).collect()}
    assert whole["4"]["archive"]["format"] == "zip" and whole["4"]["archive"]["unsafe_paths"] == ["../y"] and whole["2"]["archive"] is None and whole["3"]["sanitized"] is True
    text = {r["payload_id"]: r["text"] for r in http.to_text(results).collect()}
    assert text["2"].startswith("accepted | 2 | text/plain | ") and text["4"].startswith("rejected | 4 | ") and "  - archive.path_traversal, CRITICAL: " in text["4"]
    assert spark.range(1).select(http.validation_code(F.lit("archive.path_traversal"))).first()[0] == "archive_path_traversal"
    with pytest.raises(guard.Rejected) as raised:
        guard.check(from_bytes(spark, [("a.png", b"<?php 1;")]))
    assert "type.blocked" in raised.value.codes


def test_command_line(spark, folder, capsys, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out") / "clean.svg")
    assert cli.main(["scan", str(folder / "notes.txt")]) == 0
    told = capsys.readouterr()
    assert told.out.startswith("accepted | ") and told.err.splitlines()[-1] == "1 payloads, 0 rejected, 0 findings: none"
    assert cli.main(["scan", str(folder), "--json"]) == 1
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert {x["filename"]: x["ok"] for x in lines} == {"notes.txt": True, "pic.svg": True, "slip.zip": False}
    assert cli.main(["scan", str(folder / "notes.txt"), "--allow", "image/*"]) == 1
    assert cli.main(["scan", str(folder / "notes.txt"), "--max-size", "3"]) == 1
    assert cli.main(["scan", str(folder / "slip.zip"), "--block", ".zip", "--threshold", "CRITICAL"]) == 1
    assert cli.main(["scan", str(folder / "pic.svg"), "--write-sanitized", out]) == 0
    assert b"script" not in open(out, "rb").read()
    assert cli.main(["scan", str(folder / "pic.svg"), "--no-sanitize"]) == 1
    capsys.readouterr()
    assert cli.main(["detect", str(folder / "slip.zip")]) == 0 and "application/zip" in capsys.readouterr().out
    assert cli.main(["scan", str(folder / "absent.txt")]) == 2
    with pytest.raises(SystemExit):
        cli.main(["scan"])


def test_one_file_put_right(spark, tmp_path):
    path = str(tmp_path / "x")
    assert not write_sanitized_file(guard.scan(from_bytes(spark, [("a.txt", b"x")])), path) and not os.path.exists(path)
    with pytest.raises(ValueError):
        write_sanitized_file(guard.scan(from_bytes(spark, [("a.svg", drawn(b"1")), ("b.svg", drawn(b"2"))])), path)


def test_compound_files(spark):
    files = {"WordDocument": "application/msword", "Book": "application/vnd.ms-excel", "PowerPoint Document": "application/vnd.ms-powerpoint", "__properties_version1.0": "application/vnd.ms-outlook", "\u3840x": "application/x-msi", "Other": "application/x-ole-storage"}
    got = {r["filename"]: r["detected"]["mime"] for r in guard.scan(from_bytes(spark, [(n, compound(n, b"text")) for n in files])).collect()}
    assert got == files

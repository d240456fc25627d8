"""Markers of other formats: all of them in one pass, against a search for each by itself."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from assay.functions.polyglot import MARKERS, byte_marker, embedded, offsets
from assay.functions.values import latin


def plain(data: bytes, marker) -> int | None:
    pattern = re.compile(marker.pattern.encode("latin-1"))
    found = pattern.search(data, marker.first)
    return found.start() if found else None


def samples() -> list[bytes]:
    rng = random.Random(5)
    parts = [b"%PDF-", b"PK\x03\x04", b"\x7fELF", b"This program cannot be run in DOS mode", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"Rar!\x1a\x07", b"7z\xbc\xaf\x27\x1c", b"<?PhP", b"<%", b"<ScRiPt>", b"<iframe\n", b"<!DOCTYPE html>", b"<svg/", b"JavaScript:", b"#!/", b"\xca\xfe\xba\xbe",
             b"<", b"P", b"PK", b"%PDF", b"\x00", b"\xff\xc4\x80", b"<<<%%", b"script", b"x" * 40]
    made = [b"".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    return [*made, *parts, b"", b"<%" * 20_000, b"q" * 100_000 + b"#!/"]


OWN = [byte_marker("abab", b"abab", 30), byte_marker("ba", b"ba", 20), byte_marker("late", b"abab", 10, 3), byte_marker("nul", b"\x00\xff.*", 20), byte_marker("bracket", b"]^-[", 20)]


@pytest.mark.parametrize("markers", [list(MARKERS.values()), OWN])
def test_one_pass_finds_what_single_searches_find(spark, markers):
    data = samples() if markers is not OWN else [b"ababab", b"xbaba", b"", b"ab\x00\xff.*", b"]^-[]^-[", b"\x00\xff.x", b"aba", b"ba" * 9_000]
    rows = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "id int, content binary").repartition(4)
    got = {r["id"]: r["at"] for r in rows.select("id", offsets(latin(F.col("content")), markers).alias("at")).collect()}
    for i, d in enumerate(data):
        assert got[i] == [plain(d, m) for m in markers], d[:80]


def test_markers_of_ones_own(spark):
    detected = F.struct(F.lit("image/png").alias("mime"), F.lit("PNG").alias("description"), F.lit("image").alias("category"))
    row = spark.createDataFrame([(bytearray(b"..SECRET..<?php"),)], "content binary")
    found = row.select(embedded(F.col("content"), detected, markers=[byte_marker("canary", b"SECRET", 40), "php"]).alias("f")).first()["f"]
    assert [(f["code"], f["severity"], f["detail"]["offset"]) for f in found] == [("polyglot.embedded_canary", 40, "2"), ("polyglot.embedded_php", 40, "10")]
    assert row.select(embedded(F.col("content"), detected, limit=5, markers=[byte_marker("canary", b"SECRET", 40)]).alias("f")).first()["f"] == []
    assert row.select(embedded(F.col("content"), detected, markers=[]).alias("f")).first()["f"] == []
    with pytest.raises(ValueError):
        byte_marker("none", b"", 10)

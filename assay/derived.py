"""Payload relations derived from the driver's tables, in Spark and, letter for letter, in DuckDB SQL.

The tables hold text only, so payloads are made by putting bytes around it, a case for
each residue of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.registry import SIGNATURES
from assay.functions.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# (before, after) the customer's name
NAMES = [
    ("", ".png"), ("", ".php.jpg"), ("../", ".png"), ("", ".tar.gz"), (".", ""), ("", ""), ("C:\\dir\\", ".TXT"), ("/etc/", ".conf"), ("a/b/", ".JPEG"), ("", ".exe"), ("con.", ".txt"), ("", ".svg"),
    ("", ".docx. "), ("\u202e", ".txt"), ("zero\u200bwidth ", ".pdf"), ("nul\x00", ".png"), ("tab\t", ".csv"), ("..", ""), ("", ".sh.backup.7z"), ("LPT1", ".doc"), ("web.config/", ".web.config"), ("", ".x y"), ("<a>:", "?.html"),
    ("lo" + "n" * 250 + "g", ".yml"), ("\\\\host\\", ".midi"), (" ", " .htm "), ("é", ".Pdf"), ("", ".unknownext"),
]
CONTENT_TYPES = ["image/png", "image/jpg", "TEXT/PLAIN; charset=utf-8", "application/x-pdf", "application/octet-stream", "text/xml", "audio/wave", "application/javascript", " video/mp4 ", "image/x-png", "application/vnd.rar", "application/zip", ""]
KINDS = ["PNG", "JPEG", "PLAIN", "PDF", "HTML", "XML", "WAV", "ZIP", "MP4", "DOCX", "RAR", "ICO"]
SIZES = [0, 1, 5, 100, 5000, 70000]


def by_case(key: Column, values: list[Column]) -> Column:
    n = F.pmod(key, F.lit(len(values)))
    out = F.when(n == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(n == i, v)
    return out


def sql_text(value: str) -> str:
    """A string in SQL; characters that literals cannot hold by their number."""
    parts, run = [], ""
    for c in value:
        if ord(c) < 32 or ord(c) > 126:
            parts += [f"'{run}'"] * bool(run) + [f"chr({ord(c)})"]
            run = ""
        else:
            run += "''" if c == "'" else c
    return " || ".join([*parts, *([f"'{run}'"] if run or not parts else [])])


def sql_case(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uploads(k, filename, content_type, kind, size), a row per customer."""
    rows = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    names = [F.concat(F.lit(a), F.col("c_name"), F.lit(b)) for a, b in NAMES]
    return rows.select(k.alias("k"), by_case(k, names).alias("filename"), by_case(k, [F.lit(c) for c in CONTENT_TYPES]).alias("content_type"), by_case(k, [F.lit(c) for c in KINDS]).alias("kind"), by_case(k, [F.lit(s) for s in SIZES]).cast("long").alias("size"))


UPLOADS_SQL = f"""
    SELECT c_custkey AS k,
           {sql_case("c_custkey", [f"{sql_text(a)} || c_name || {sql_text(b)}" for a, b in NAMES])} AS filename,
           {sql_case("c_custkey", [sql_text(c) for c in CONTENT_TYPES])} AS content_type,
           {sql_case("c_custkey", [f"'{c}'" for c in KINDS])} AS kind,
           ({sql_case("c_custkey", [str(s) for s in SIZES])})::BIGINT AS size
    FROM customer"""


def _refined() -> list[bytes]:
    """Starts that a second look settles."""
    icon = bytes([0, 0, 1, 0, 1, 0, 16, 16, 0, 0, 1, 0, 32, 0]) + (40).to_bytes(4, "little") + (22).to_bytes(4, "little")
    return [
        b"RIFF\x10\0\0\0WAVE", b"RIFF\x10\0\0\0AVI ", b"RIFF\x10\0\0\0WEBP", b"RIFF\x10\0\0\0ABCD", b"FORM\0\0\0\x10AIFF", b"FORM\0\0\0\x10XXXX",
        b"\0\0\0\x18ftypisom\0\0\0\0", b"\0\0\0\x18ftypM4A \0\0\0\0", b"\0\0\0\x18ftypheic\0\0\0\0", b"\0\0\0\x18ftyp3gpz\0\0\0\0", b"\0\0\0\x18ftypzzzz\0\0\0\0avifqt  ", b"\0\0\0\x14ftypzzzz\0\0\0\0avif",
        b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + bytes(8), b"BM" + bytes(8) + (9).to_bytes(4, "little") + (40).to_bytes(4, "little") + bytes(8), b"BM is prose",
        icon, icon[:4] + b"\0\0" + icon[6:], b"\0\x01\0\0\0\x0c\0\0\0\0\0\0", b"\0\x01\0\0\0\xff\0\0\0\0\0\0", b"G" + b"x" * 187 + b"G" + b"y" * 187 + b"G", b"Gnothing",
        b"\xff\xfb\x90\0", b"\xff\xfb\xf0\0", b"\xff\xfb\x9c\0", b"\xca\xfe\xba\xbe\0\0\0\x02", b"\xca\xfe\xba\xbe\0\0\0\x34", b"\x60\xea\x22\0" + bytes(6) + b"\x02\0" + bytes(30), b"\x60\xea\x22\0" + bytes(40),
        b"\x10\0\0\0\x04\0\0\0" + bytes(26) + b"LP", b"\x04\0\0\0\x10\0\0\0" + bytes(26) + b"LP", b"\x1aE\xdf\xa3\x9fB\x82\x84webm", b"\x1aE\xdf\xa3\x9fB\x82\x88matroska", b"\x1aE\xdf\xa3\x9fB\x86\x81\x01webm", b"\x1aE\xdf\xa3\x9f",
    ]


STARTS: list[bytes] = [bytes(s.offset) + s.magic for s in SIGNATURES if s.offset < 2048] + _refined() + [b""]


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blobs(k, content): a start of bytes before each document's text."""
    k = F.col("doc_id")
    start = by_case(k, [F.lit(s) for s in STARTS])
    return table(spark, sf_dir, "documents").select(k.alias("k"), F.concat(start, F.coalesce("text", F.lit("")).cast("binary")).alias("content"))


def sql_blob(value: bytes) -> str:
    return f"from_hex('{value.hex()}')" if value else "''::BLOB"


BLOBS_SQL = f"SELECT doc_id AS k, ({sql_case('doc_id', [sql_blob(s) for s in STARTS])}) || encode(coalesce(text, '')) AS content FROM documents"

TEXTS = [
    "", "<?php echo 1; ?>", "<?= 1 ?>", "#!/bin/bash\n", "#!/usr/bin/env python3\n", "Windows Registry Editor Version 5.00\n", "REGEDIT4\n", "-----BEGIN CERTIFICATE-----\n", "BEGIN:VCARD\n", "BEGIN:VCALENDAR\n", "From: a@b.c\n", "MIME-Version: 1.0\n",
    "<!DOCTYPE html><p>", "<!doctype svg><svg>", "<?xml version=\"1.0\"?><svg xmlns=\"s\">", "<?xml version=\"1.0\"?><!-- c --><rss>", "<feed xmlns=\"a\">", "<html><hta:application/>", "<html>", "<job><script>", "<job>", "<div>", "<my:tag>", "<bare", "<unknown>",
    "  \n<svg>", "text <iframe src=x> ", "text <svg > ", "{\"a\": 1, ", "[1, 2] ", "[true] ", "{ } ", "{oops ", "<rdf:rss>", "\t\n ",
]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts(k, content): a start of text before each document's text."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(k.alias("k"), F.concat(by_case(k, [F.lit(t) for t in TEXTS]), F.coalesce("text", F.lit(""))).alias("body")).select("k", F.col("body").cast("binary").alias("content"))


TEXTS_SQL = f"SELECT doc_id AS k, ({sql_case('doc_id', [sql_text(t) for t in TEXTS])}) || coalesce(text, '') AS body FROM documents"

# (start, middle, end, type key, category) around and after the text
BODIES = [
    (b"\x89PNG\r\n\x1a\n", b"", b"IEND\xae\x42\x60\x82", "PNG"), (b"\x89PNG\r\n\x1a\n", b"<?php x", b"IEND\xae\x42\x60\x82<script>alert(1)</script>", "PNG"), (b"\x89PNG\r\n\x1a\n", b"PK\x03\x04", b"", "PNG"),
    (b"GIF89a", b"<SCRIPT>", b"\0;", "GIF"), (b"GIF89a", b"%PDF-", b"\0;\0\1\2", "GIF"), (b"GIF89a", b"", b"!", "GIF"), (b"\xff\xd8\xff\xe0", b"\x7fELF", b"\xff\xd9\0\0", "JPEG"), (b"\xff\xd8\xff\xe0", b"<iframe>", b"\xff\xd9trailing text here", "JPEG"),
    (b"%PDF-1.7", b"<% asp %>", b"%%EOF\n", "PDF"), (b"%PDF-1.7", b"#!/bin/sh", b"%%EOF12345", "PDF"), (b"%PDF-1.7", b"", b"", "PDF"), (b"fLaC", b"<?PHP", b"", "FLAC"), (b"wOFF", b"#!/", b"", "WOFF"), (b"PAR1", b"<script ", b"", "PARQUET"), (b"SQLite format 3\0", b"<iframe>", b"", "SQLITE"),
    (b"{\\rtf", b"<?php", b"", "RTF"), (b"", b"<?php", b"", "PLAIN"), (b"8BPS", b"<!doctype html>", b"", "PSD"), (b"8BPS", b"<svg/>7z\xbc\xaf\x27\x1c", b"", "PSD"), (b"FLV\1", b"This program cannot be run in DOS mode", b"", "FLV"), (b"II*\0", b"\xca\xfe\xba\xbeRar!\x1a\x07<%", b"", "TIFF"),
]


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bodies(k, kind, content): a conversation turn between a start, a middle and an end, and again."""
    k = F.col("conv_id") * 100 + F.col("turn")
    text = F.coalesce("text", F.lit("")).cast("binary")
    pick = lambda i: by_case(k, [F.lit(b[i]) for b in BODIES])
    return table(spark, sf_dir, "conversations").select(k.alias("k"), pick(3).alias("kind"), F.concat(pick(0), text, pick(1), text, pick(2)).alias("content"))


BODIES_SQL = f"""
    SELECT conv_id * 100 + turn AS k, {sql_case("(conv_id * 100 + turn)", [f"'{b[3]}'" for b in BODIES])} AS kind,
           {" || ".join(["(" + sql_case("(conv_id * 100 + turn)", [sql_blob(b[0]) for b in BODIES]) + ")", "encode(coalesce(text, ''))", "(" + sql_case("(conv_id * 100 + turn)", [sql_blob(b[1]) for b in BODIES]) + ")", "encode(coalesce(text, ''))", "(" + sql_case("(conv_id * 100 + turn)", [sql_blob(b[2]) for b in BODIES]) + ")"])} AS content
    FROM conversations"""

URLS = [("", ""), ("#", ""), ("//", ""), ("java\tscript:", ""), ("VBScript:", ""), ("data:image/png;base64,", ""), ("data:text/html,", ""), ("data:,", ""), ("https://x/", ""), ("mailto:", "@x"), ("foo+bar:", ""), ("a/", ".svg"), (" \u200bjavascript:", "")]


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """urls(k, url): a scheme before each part's name."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("k"), by_case(k, [F.concat(F.lit(a), F.col("p_name"), F.lit(b)) for a, b in URLS]).alias("url"))


URLS_SQL = f"SELECT p_partkey AS k, {sql_case('p_partkey', [f'{sql_text(a)} || p_name || {sql_text(b)}' for a, b in URLS])} AS url FROM part"

STYLES = ["fill:url(#N)", "fill:url('http://x/N')", "a{b:url(\"N.png\")}", "behavior:url(N)", "width:expression(N)", "/* url(http://N) */color:red", "@import 'N'", "x:url(data:image/png;base64,N)", "x:url(data:text/html,N)", "x:url( #N ) y:url(//N)"]


def styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("k"), F.replace(by_case(k, [F.lit(s) for s in STYLES]), F.lit("N"), F.col("p_name")).alias("css"))


STYLES_SQL = f"SELECT p_partkey AS k, replace({sql_case('p_partkey', [sql_text(s) for s in STYLES])}, 'N', p_name) AS css FROM part"

MEMBERS = [("N", ""), ("a/../N", ""), ("a/../../N", ""), ("/N", ""), ("C:N", ""), ("..\\N", ""), ("./N/.", ""), ("a//../..", ""), ("d/N.zip", "../x"), ("d/N.tar.GZ", "../../x"), ("d/N", "/etc"), ("N.7z", "a/../../b"), ("a/b/N", "../../.."), ("N", "x/..")]


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """members(k, name, target): archive members and link targets."""
    k, n = F.col("s_suppkey"), F.col("s_name")
    pick = lambda i: F.replace(by_case(k, [F.lit(m[i]) for m in MEMBERS]), F.lit("N"), n)
    return table(spark, sf_dir, "supplier").select(k.alias("k"), pick(0).alias("name"), pick(1).alias("target"))


MEMBERS_SQL = f"SELECT s_suppkey AS k, replace({sql_case('s_suppkey', [sql_text(m[0]) for m in MEMBERS])}, 'N', s_name) AS name, {sql_case('s_suppkey', [sql_text(m[1]) for m in MEMBERS])} AS target FROM supplier"

LISTING_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as archive entries: (archive, idx, size, packed, header_offset, name_bytes)."""
    rank = F.expr(f"cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY {LISTING_ORDER}) - 1 AS int)")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("archive"), rank.alias("idx"), F.floor("l_extendedprice").cast("long").alias("size"), F.floor(F.col("l_quantity") * 100).cast("long").alias("packed"), (F.col("l_partkey") * 7).cast("long").alias("header_offset"), F.col("l_linenumber").cast("int").alias("name_bytes"))


LISTING_SQL = f"SELECT l_orderkey AS archive, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {LISTING_ORDER}) - 1)::INT AS idx, floor(l_extendedprice)::BIGINT AS size, floor(l_quantity * 100)::BIGINT AS packed, (l_partkey * 7)::BIGINT AS header_offset, l_linenumber::INT AS name_bytes FROM lineitem"

"""Documents inside containers, archives and SVG files, and in DuckDB SQL what is in each.

The bytes are made in Python, as no table has any; what has to be found in them follows
from how they are made, and is stated here as SQL: `n` is the size of the text in bytes.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.derived import sql_case, sql_text, table
from assay.functions.registry import KINDS
from assay.functions.ship import small_batches
from assay.operators.archive import ArchiveLimits

#: Bytes of files that are handed on together.
TOGETHER = 1 << 20
LONG = "d" * 40 + "/" + "e" * 140
NS = 'xmlns="http://www.w3.org/2000/svg"'


def zipped(*entries: tuple[str, bytes], stored: bool = False) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries:
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def tarred(*members: tuple[str, bytes, bytes, str], layout: int = tarfile.USTAR_FORMAT) -> bytes:
    """Members: name, kind, body, link target."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=layout) as t:
        for name, kind, body, target in members:
            info = tarfile.TarInfo(name)
            info.size, info.type, info.linkname = len(body), kind, target
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def compound(stream: str, body: bytes) -> bytes:
    """A compound file: a header, a sector of sector links, a sector of names, and the body."""
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    header = bytearray(512)
    header[:8] = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
    struct.pack_into("<HHHHH", header, 0x18, 0x3E, 3, 0xFFFE, 9, 6)
    struct.pack_into("<III", header, 0x2C, 1, 1, 0)  # sectors of links; first sector of names
    struct.pack_into("<109I", header, 0x4C, 0, *[free] * 108)
    links = struct.pack("<128I", free - 2, end, *[free] * 126)
    names = b"".join((n.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<H", 2 * len(n) + 2) + bytes(62) for n in ("Root Entry", stream))
    return bytes(header) + links + names.ljust(512, b"\0") + body


def locked(data: bytes) -> bytes:
    """A ZIP file whose entries say that they are encrypted."""
    out = bytearray(data)
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        out[data.index(mark) + at] |= 1
    return bytes(out)


def drawn(body: bytes) -> bytes:
    """An SVG file with script and the body as text."""
    return f'<svg {NS} onload="x()"><script>1</script><text>'.encode() + plain(body) + b"</text></svg>"


def plain(body: bytes) -> bytes:
    """body without what XML does not take as it is."""
    return body.translate(None, b"&<" + bytes(c for c in range(32) if c not in b"\t\n\r"))


class Wrap(NamedTuple):
    """report: what an archive holds, in SQL: (format, entries, bytes, depth, nested, unsafe, codes)."""

    filename: str
    kind: str
    build: Callable[[bytes], bytes]
    report: tuple[str, str, str, int, str, str, str] | None = None


_FILE, _LINK, _HARD, _DEVICE = tarfile.REGTYPE, tarfile.SYMTYPE, tarfile.LNKTYPE, tarfile.CHRTYPE
WRAPS = [
    Wrap("a.zip", "ZIP", lambda b: zipped(("x.txt", b), ("../y", b"1")), ("zip", "2", "n + 1", 0, "", "../y", "archive.path_traversal:40")),
    Wrap("a.tar", "TAR", lambda b: tarred(("../x", _FILE, b, "")), ("tar", "1", "n", 0, "", "../x", "archive.path_traversal:40")),
    Wrap("a.tgz", "GZIP_TAR", lambda b: gzip.compress(tarred(("x", _FILE, b, ""), ("ln", _LINK, b"", "/etc/passwd")), mtime=0), ("tar+gzip", "2", "n", 0, "", "", "archive.symlink:30")),
    Wrap("a.gz", "GZIP", lambda b: gzip.compress(b, mtime=0), ("gzip", "1", "n", 0, "", "", "")),
    Wrap("a.docx", "DOCX", lambda b: zipped(("word/document.xml", b)), ("zip", "1", "n", 0, "", "", "")),
    Wrap("a.svg", "SVG", drawn),
    Wrap("a.zip", "ZIP", lambda b: zipped(("in.zip", zipped(("x", b), stored=True)), ("x.txt", b"1"), stored=True), ("zip", "3", "2 * n + 101", 1, "in.zip", "", "")),
    Wrap("a.svgz", "GZIP_SVG", lambda b: gzip.compress(drawn(b), mtime=0)),
    Wrap("a.doc", "DOC", lambda b: compound("WordDocument", b)),
    Wrap("a.xls", "XLS", lambda b: compound("Workbook", b)),
    Wrap("a.ole", "OLE2", lambda b: compound("Contents", b)),
    Wrap("a.tbz", "BZIP2", lambda b: bz2.compress(tarred((LONG, _FILE, b, ""), layout=tarfile.PAX_FORMAT)), ("tar+bzip2", "1", "n", 0, "", "", "")),
    Wrap("a.xz", "XZ", lambda b: lzma.compress(b), ("xz", "1", "n", 0, "", "", "")),
    Wrap("a.tar", "TAR", lambda b: tarred((LONG + "/x.zip", _FILE, b, ""), layout=tarfile.GNU_FORMAT), ("tar", "1", "n", 0, LONG + "/x.zip", "", "")),
    Wrap("a.tar", "TAR", lambda b: tarred(("x", _FILE, b, ""), ("h", _HARD, b"", "x"), ("c", _DEVICE, b"", "")), ("tar", "3", "n", 0, "", "", "archive.symlink:30,archive.device_file:30")),
    Wrap("a.zip", "ZIP", lambda b: locked(zipped(("x", b))), ("zip", "1", "n", 0, "", "", "archive.encrypted:10")),
]

# (file with {} for the text, codes when scanned)
DRAWINGS = [
    (f"<svg {NS}><text>{{}}</text></svg>", ""),
    (f'<svg {NS} onload="x()"><script>{{}}</script></svg>', "svg.event_handler:40,svg.script:40"),
    (f'<svg {NS}><a href="javascript:x"><text>{{}}</text></a></svg>', "svg.javascript_uri:40"),
    (f'<svg {NS}><foreignObject/><iframe/><text>{{}}</text></svg>', "svg.dangerous_element:30,svg.foreign_object:30"),
    (f'<svg {NS}><image href="https://x/y"/><use href="z.svg"/><text>{{}}</text></svg>', "svg.external_reference:20,svg.external_reference:30"),
    (f'<svg {NS}><style>a{{{{width:expression(1)}}}}</style><text style="fill:url(//x)">{{}}</text></svg>', "svg.css_script:40,svg.external_reference:20"),
    (f'<svg {NS}><animate attributeName="href" to="x"/><text fill="url(https://x)" src="y" target="z">{{}}</text></svg>', "svg.animated_href:30,svg.dangerous_attribute:10,svg.dangerous_attribute:30,svg.external_reference:20"),
    (f'<?xml version="1.0"?><!DOCTYPE svg><?x y?><svg {NS}><m xmlns="urn:f"/><text>{{}}</text></svg>', "svg.doctype:10,svg.foreign_element:20,svg.processing_instruction:20"),
    ("<html><text>{}</text></html>", "svg.not_svg:30"),
    (f"<svg {NS}><text>{{}}</svg>", "svg.parse_error:30"),
    ('<!DOCTYPE svg [<!ENTITY e "f">]><svg><text>{}</text></svg>', "svg.entity_declaration:40"),
]


def built_batches(batches: Iterator[pa.RecordBatch], build: Callable[[int, bytes], tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """What build makes of every (doc_id, body), TOGETHER bytes at a time."""

    def batch_of(rows: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], names=["payload_id", "filename", "content"])

    rows, held = [], 0
    for batch in batches:
        for k, body in zip(*batch.columns, strict=True):  # one document's bytes at a time
            k = k.as_py()
            rows.append((str(k), *build(k, body.as_py())))
            held += len(rows[-1][-1])
            if held >= TOGETHER:
                yield batch_of(rows)
                rows, held = [], 0
    if rows:
        yield batch_of(rows)


def _built(spark: SparkSession, sf_dir: str, build: Callable[[int, bytes], tuple[str, bytes]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return built_batches(batches, build)

    small_batches(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    return rows.mapInArrow(run, "payload_id string, filename string, content binary")


def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payloads(payload_id, filename, content): every document inside one of WRAPS."""

    def build(k: int, body: bytes) -> tuple[str, bytes]:
        w = WRAPS[k % len(WRAPS)]
        return w.filename, w.build(body)

    return _built(spark, sf_dir, build)


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payloads(payload_id, filename, content): every document inside one of DRAWINGS."""
    return _built(spark, sf_dir, lambda k, body: ("a.svg", plain(body).join(x.encode() for x in DRAWINGS[k % len(DRAWINGS)][0].replace("{{", "{ ").replace("}}", " }").split("{}"))))


# ---------------------------------------------------------------- archives at their limits

LIMITS = ArchiveLimits(max_total_uncompressed=12_288, max_ratio=10, ratio_min_uncompressed=2000, max_entries=4, max_nested_bytes=1000, verify_sizes=True, allow_symlinks=True)
_REAL = 300
#: Bytes of a ZIP file of one stored entry with a name of one letter, beside the entry's.
_AROUND = 30 + 1 + 46 + 1 + 22


def relisted(data: bytes, size: int) -> bytes:
    """data, a ZIP file of one entry, whose directory says that it is of this size."""
    at = data.rindex(b"PK\x01\x02") + 24
    return data[:at] + struct.pack("<I", size) + data[at + 4 :]


class Limit(NamedTuple):
    """build: an archive out of n, the size of a text; entries, truncated, codes: what has to be found, as SQL over n."""

    filename: str
    build: Callable[[int], bytes]
    entries: str
    truncated: str
    codes: str


def _when(condition: str, code: str) -> str:
    return f"CASE WHEN {condition} THEN '{code}' ELSE '' END"


LIMITED = [
    # more entries than are looked at
    Limit("a.zip", lambda n: zipped(*((f"{i}", b"1") for i in range(n % 9)), stored=True), "n % 9", f"n % 9 > {LIMITS.max_entries}", _when(f"n % 9 > {LIMITS.max_entries}", "archive.too_many_entries:30")),
    # more bytes than are unpacked
    Limit("a.zip", lambda n: zipped(*((f"{i}", bytes(n % 6000)) for i in range(3)), stored=True), "3", f"3 * (n % 6000) > {LIMITS.max_total_uncompressed}", _when(f"3 * (n % 6000) > {LIMITS.max_total_uncompressed}", "archive.bomb_size:40")),
    # an archive inside that is too large to be opened; one that is opened counts its entry
    Limit("a.zip", lambda n: zipped(("x.zip", zipped(("y", bytes(n % 2000)), stored=True)), stored=True), f"CASE WHEN n % 2000 + {_AROUND} > {LIMITS.max_nested_bytes} THEN 1 ELSE 2 END", "false", _when(f"n % 2000 + {_AROUND} > {LIMITS.max_nested_bytes}", "archive.nested_too_large:20")),
    # an archive inside one inside one, by its depth
    Limit("a.zip", lambda n: zipped(("x.zip", zipped(("y.zip" if n % 2 else "y", b"1"), stored=True)), stored=True), "2", "false", _when("n % 2 = 1", "archive.nested_uninspected:20")),
    # a size that is not the entry's
    Limit("a.zip", lambda n: relisted(zipped(("x", bytes(_REAL)), stored=True), n % 600), "1", "false", _when(f"n % 600 < {_REAL}", "archive.size_mismatch:40")),
    # compressed zeros: a ratio, or more bytes than are unpacked
    Limit("a.gz", lambda n: gzip.compress(bytes(n % 40 * 500), mtime=0), f"CASE WHEN n % 40 * 500 > {LIMITS.max_total_uncompressed} THEN 0 ELSE 1 END", f"n % 40 * 500 > {LIMITS.max_total_uncompressed}", f"CASE WHEN n % 40 * 500 > {LIMITS.max_total_uncompressed} THEN 'archive.bomb_size:40' WHEN n % 40 * 500 >= {LIMITS.ratio_min_uncompressed} THEN 'archive.bomb_ratio:40' ELSE '' END"),
    # a link, as many folders up as n says, out of a folder in a folder
    Limit("a.tar", lambda n: tarred(("a/b/x", _LINK, b"", "../" * (n % 6) + "y")), "1", "false", _when("n % 6 > 2", "archive.path_traversal:40,archive.symlink_escape:40")),
    # a ZIP file that has lost its directory
    Limit("a.zip", lambda n: (lambda z: z[: z.index(b"PK\x01\x02")])(zipped(("x", bytes(n % 100)), stored=True)) + bytes(n % 50), "0", "false", "'archive.corrupt:30'"),
    # members of a tar beyond the limit
    Limit("a.tar", lambda n: tarred(*((f"{i}", _FILE, b"1", "") for i in range(1 + n % 8))), f"least(1 + n % 8, {LIMITS.max_entries + 1})", f"1 + n % 8 > {LIMITS.max_entries}", _when(f"1 + n % 8 > {LIMITS.max_entries}", "archive.too_many_entries:30")),
    # an inner archive that unpacks to more than it says
    Limit("a.zip", lambda n: relisted(zipped(("x.zip", zipped(("y", b"1"), stored=True)), stored=True), n % 200), f"CASE WHEN n % 200 < {_AROUND + 1} THEN 1 ELSE 2 END", f"n % 200 < {_AROUND + 1}", _when(f"n % 200 < {_AROUND + 1}", "archive.size_mismatch:40")),
]


def limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payloads(payload_id, filename, content): for every document one of LIMITED, made by its size."""

    def build(k: int, body: bytes) -> tuple[str, bytes]:
        limit = LIMITED[k % len(LIMITED)]
        return limit.filename, limit.build(len(body))

    return _built(spark, sf_dir, build)


LIMITS_SQL = f"""
    WITH d AS (SELECT doc_id AS k, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
    SELECT k::VARCHAR AS payload_id, ({sql_case('k', [x.entries for x in LIMITED])})::BIGINT AS entry_count, {sql_case('k', [x.truncated for x in LIMITED])} AS truncated, {sql_case('k', [x.codes for x in LIMITED])} AS codes FROM d"""
TYPES_SQL = f"SELECT doc_id::VARCHAR AS payload_id, {sql_case('doc_id', [sql_text(KINDS[w.kind].mime) for w in WRAPS])} AS mime FROM documents"
FILES_SQL = """
    WITH d AS (SELECT doc_id AS k, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE octet_length(encode(coalesce(text, ''))) END::BIGINT AS size FROM documents)
    SELECT k, size, CASE WHEN size = 0 THEN 'size.empty:30' ELSE '' END AS codes FROM d"""

KINDS_SQL = f"SELECT doc_id::VARCHAR AS payload_id, {sql_case('doc_id', [sql_text(w.kind) for w in WRAPS])} AS kind FROM documents"


def _reports_sql() -> str:
    held = [w.report or ("", "0", "0", 0, "", "", "") for w in WRAPS]
    column = lambda i, text: sql_case("k", [sql_text(str(r[i])) if text else str(r[i]) for r in held])
    own = ", ".join(str(i) for i, w in enumerate(WRAPS) if w.report)
    return f"""
    WITH d AS (SELECT doc_id AS k, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
    SELECT k::VARCHAR AS payload_id, {column(0, True)} AS format, ({column(1, False)})::BIGINT AS entry_count, ({column(2, False)})::BIGINT AS total_uncompressed, ({column(3, False)})::INT AS max_depth,
           {column(4, True)} AS nested, {column(5, True)} AS unsafe, {column(6, True)} AS codes
    FROM d WHERE k % {len(WRAPS)} IN ({own})"""


REPORTS_SQL = _reports_sql()
DRAWINGS_SQL = f"SELECT doc_id::VARCHAR AS payload_id, {sql_case('doc_id', [sql_text(c) for _, c in DRAWINGS])} AS codes FROM documents"

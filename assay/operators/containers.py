"""What ZIP, OLE2 and gzip files hold, as far as their type needs it.

The lists inside are read by small helpers over Arrow batches, for rows with the right
magic only (other rows send null), one payload's bytes copied at a time; telling types
apart by the lists is an expression.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.registry import HEAD
from assay.functions.stores import Ranged, seekable
from assay.functions.values import part

# MIME types in a `mimetype` entry.
MIMETYPES = {
    "application/epub+zip": "EPUB",
    "application/vnd.oasis.opendocument.text": "ODT",
    "application/vnd.oasis.opendocument.spreadsheet": "ODS",
    "application/vnd.oasis.opendocument.presentation": "ODP",
    "application/vnd.oasis.opendocument.graphics": "ODG",
}
_ZIP, _OLE, _GZIP = (b"PK\x03\x04", b"PK\x07\x08"), b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"\x1f\x8b"
_NONE = 0xFFFFFFFA  # sector numbers from here on mean something else


def local_names(head: bytes, limit: int = 64) -> tuple[list[str], str | None]:
    """Names in consecutive local headers, and what a stored `mimetype` entry says."""
    names: list[str] = []
    mimetype, at = None, 0
    while at + 30 <= len(head) and len(names) < limit and head.startswith(_ZIP[0], at):
        flags, method = struct.unpack_from("<HH", head, at + 6)
        (packed,) = struct.unpack_from("<I", head, at + 18)
        name_size, extra_size = struct.unpack_from("<HH", head, at + 26)
        name = head[at + 30 : at + 30 + name_size]
        if len(name) < name_size:
            break
        names.append(name.decode("utf-8", "replace"))
        body = at + 30 + name_size + extra_size
        if names[-1] == "mimetype" and not method and packed:
            mimetype = head[body : body + packed].decode("ascii", "replace").strip()
        if flags & 8 and not packed:  # the size comes after the data
            break
        at = body + packed
    return names, mimetype


def _zip_list(content: bytes | Ranged) -> tuple[list[str], str | None]:
    names, mimetype = [], None
    try:
        with zipfile.ZipFile(seekable(content)) as z:
            entries = z.infolist()[:512]
            names = [e.filename for e in entries]
            first = next((e for e in entries if e.filename == "mimetype" and e.file_size < 256), None)
            if first is not None:
                mimetype = z.read(first).decode("ascii", "replace").strip()
    except (zipfile.BadZipFile, OSError, ValueError, RuntimeError, EOFError, NotImplementedError, zlib.error):
        names = []
    return (names, mimetype) if names else local_names(content[:HEAD])


@F.arrow_udf(T.StructType([T.StructField("names", T.ArrayType(T.StringType())), T.StructField("mimetype", T.StringType())]))
def _zip_lists(contents: pa.Array) -> pa.Array:
    found = [_zip_list(c.as_py()) if c.is_valid else (None, None) for c in contents]
    return pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.list_(pa.string())), pa.array([m for _, m in found], pa.string())], ["names", "mimetype"])


def zip_listing(content: Ranged, head: bytes) -> tuple[list[str], str | None] | None:
    """What zip_kind() goes by, read by position; null for what is no ZIP file."""
    return _zip_list(content) if head[:4] in _ZIP else None


def ole_listing(content: Ranged, head: bytes) -> list[str] | None:
    """What ole_kind() goes by, read by position; null for what is no compound file."""
    return ole_names(content) if head[:8] == _OLE else None


def ole_names(content: bytes | Ranged, most: int = 16) -> list[str]:
    """Names in the directory sectors of a compound file."""
    head = content[:512]
    if len(head) < 512:
        return []
    (shift,) = struct.unpack_from("<H", head, 0x1E)
    if shift not in (9, 12):
        return []
    size = 1 << shift
    (sector,) = struct.unpack_from("<I", head, 0x30)
    fats = struct.unpack_from("<109I", head, 0x4C)
    names, seen = [], set()
    while sector < _NONE and sector not in seen and len(seen) < most:
        seen.add(sector)
        data = content[(sector + 1) * size : (sector + 2) * size]
        for at in range(0, len(data) - 127, 128):
            (n,) = struct.unpack_from("<H", data, at + 64)
            if 2 <= n <= 64:
                try:
                    names.append(data[at : at + n - 2].decode("utf-16-le"))
                except UnicodeDecodeError:
                    pass
        if len(data) < 128 or sector // (size // 4) >= len(fats) or fats[sector // (size // 4)] >= _NONE:
            break
        at = (fats[sector // (size // 4)] + 1) * size + sector % (size // 4) * 4
        if at + 4 > len(content):
            break
        (sector,) = struct.unpack("<I", content[at : at + 4])
    return names


@F.arrow_udf(T.ArrayType(T.StringType()))
def _ole_lists(contents: pa.Array) -> pa.Array:
    return pa.array([ole_names(c.as_py()) if c.is_valid else None for c in contents], pa.list_(pa.string()))


@F.arrow_udf(T.BinaryType())
def _inflated_start(heads: pa.Array) -> pa.Array:
    def start(head: bytes | None) -> bytes | None:
        if head is None:
            return None
        try:
            return zlib.decompressobj(wbits=31).decompress(head, 600)
        except zlib.error:
            return None

    return pa.array([start(h.as_py()) for h in heads], pa.binary())


def kind_of_names(names: Column, mimetype: Column) -> Column:
    """The type of a ZIP file by its entries' names."""
    low = F.transform(names, F.lower)
    has = lambda start: F.exists(low, lambda n: n.startswith(start))
    named = lambda *of: F.arrays_overlap(low, F.array(*[F.lit(n) for n in of]))
    said = None
    for mime, kind in MIMETYPES.items():
        hit = F.coalesce(mimetype.startswith(mime), F.lit(False))
        said = F.when(hit, kind) if said is None else said.when(hit, kind)
    return (
        said.when(has("word/"), "DOCX")
        .when(has("xl/"), "XLSX")
        .when(has("ppt/"), "PPTX")
        .when(has("visio/"), "VSDX")
        .when(named("androidmanifest.xml", "classes.dex"), "APK")
        .when(named("meta-info/mozilla.rsa") | (named("manifest.json") & has("meta-inf/mozilla")), "XPI")
        .when(named("meta-inf/manifest.mf"), "JAR")
        .when(named("fixeddocumentsequence.fdseq", "fixeddocseq.fdseq"), "XPS")
        .when(named("[content_types].xml"), "OOXML")
        .otherwise("ZIP")
    )


def kind_of_streams(names: Column) -> Column:
    """The type of a compound file by its streams' names."""
    has = lambda *of: F.arrays_overlap(names, F.array(*[F.lit(n) for n in of]))
    return (
        F.when(has("WordDocument"), "DOC")
        .when(has("Workbook", "Book"), "XLS")
        .when(has("PowerPoint Document"), "PPT")
        .when(has("VisioDocument"), "VSD")
        .when(F.exists(names, lambda n: n.startswith("__substg1.0_") | (n == "__properties_version1.0")), "MSG")
        .when(F.exists(names, lambda n: n.rlike("^[\\x{3800}-\\x{4840}]")), "MSI")
        .otherwise("OLE2")
    )


def kind_of_inflated(start: Column) -> Column:
    """The type of a gzip file by the first bytes inside; plain gzip if they cannot be had."""
    text = F.decode(start, "ISO-8859-1")
    trimmed = F.regexp_replace(text, "^[\\t-\\r ]+", "")
    return F.when(F.substring(text, 258, 5) == "ustar", "GZIP_TAR").when((trimmed.startswith("<?xml") | trimmed.startswith("<svg")) & text.contains("<svg"), "GZIP_SVG").otherwise("GZIP")


def zip_kind(content: Column, listed: Column | None = None, read: Callable[[Column], Column] = _zip_lists) -> Column:
    """Null for what is no ZIP file; listed: names and mimetype, where they have been read; read: what else reads them."""
    if listed is None:
        listed = read(F.when(part(content, 0, 4).isin(*[F.lit(m) for m in _ZIP]), content))
    return F.when(listed["names"].isNotNull(), kind_of_names(listed["names"], listed["mimetype"]))


def ole_kind(content: Column, names: Column | None = None, read: Callable[[Column], Column] = _ole_lists) -> Column:
    if names is None:
        names = read(F.when(part(content, 0, 8) == F.lit(_OLE), content))
    return F.when(names.isNotNull(), kind_of_streams(names))


def gzip_kind(content: Column, read: Callable[[Column], Column] = _inflated_start) -> Column:
    is_gzip = part(content, 0, 2) == F.lit(_GZIP)
    return F.when(is_gzip, kind_of_inflated(read(F.when(is_gzip, F.substring(content, 1, HEAD)))))

"""WARC archives out of page tables, and a normaliser of archives that are one gzip stream.

write_pages() puts pages into archives as they come, every page a full response record and
every archive one gzip member from end to end, which is what a crawler that compresses its
whole output leaves.  Such a file can only be read from its beginning.  normalise() inflates
each of them once, as a stream, writes every record again as a gzip member of its own, and
puts an index beside the archive: one JSON line a record with its offset and length.  It
also turns repeated payloads into revisit records on the way: equal payloads are found
beforehand from the digests alone, so page texts are never shuffled.  read_records() then
goes to each record by its offset and inflates nothing else.

Files are written by the tasks, through Arrow's file systems, under a name of their own for
each attempt; only the names that a finished task returned are ever read, so a task that is
run again leaves nothing but an unread file.  Nothing holds an archive: payloads pass in
pieces of `CHUNK` bytes, a record at most when it is read by its index.

Of equal payloads (SHA-1) of at least `least` bytes the row with the largest key is the
response; of rows with that key one is, and the rest refer to it.

Defined cases: a null payload is empty; a null key ranks below all others, and is null when
it is read back, in a reference too; a null or empty address is left out, white space and
control characters in it are percent-encoded; repeated rows are records of their own; an
empty table gives no archives and no rows; archives of several members, of zeros after a
member or without compression are read as well; one that ends too early or does not hold
what its manifest says is an error; extra columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.durable import folder, forget
from assay.llm.common import has_columns, materialize

#: Bytes of records, before compression, after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 20
#: Partitions that archives are dealt to at most; each takes its archives one by one.
PARTITIONS = 10_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT, INFO = "response", "revisit", "warcinfo"
#: Extension fields: the key of the page, and of the page that a revisit refers to.
KEY, REFERS = "X-Page-Key", "X-Refers-To-Page-Key"

Headers = list[tuple[str, str]]


def digest_of(payload: bytes) -> str:
    """SHA-1 in base32, as payload digests are written."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def address(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record_id(archive: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{number}')}>"


def head_of(headers: Headers, length: int) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers if name.lower() != "content-length")
    return f"WARC/1.1\r\n{lines}Content-Length: {length}\r\n\r\n".encode()


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def value_of(headers: Headers, name: str) -> str | None:
    return next((v for n, v in headers if n.lower() == name.lower()), None)


class Sink:
    """A file that gzip members are appended to."""

    def __init__(self, files: fs.FileSystem, path: str, level: int):
        self.out, self.level, self.size = files.open_output_stream(path, compression=None), level, 0

    def begin(self) -> None:
        self.gzip, self.began = zlib.compressobj(self.level, zlib.DEFLATED, 31), self.size

    def write(self, data: bytes) -> None:
        self._put(self.gzip.compress(data))

    def end(self) -> tuple[int, int]:
        """Offset and length of the member."""
        self._put(self.gzip.flush())
        return self.began, self.size - self.began

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.size += len(data)

    def close(self) -> None:
        self.out.close()


def inflated(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """What a file holds, in pieces: gzip members one after the other, zeros between or after them passed over, or plain bytes."""
    data = read(CHUNK)
    while len(data) == 1 and (more := read(CHUNK)):
        data += more
    if data and data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = read(CHUNK)
        return
    while data:
        member = zlib.decompressobj(31)
        while not member.eof:
            if not data:
                raise ValueError("the archive ends within a gzip member")
            piece = member.decompress(data, CHUNK)
            data = member.unconsumed_tail or (b"" if member.eof else read(CHUNK))
            if piece:
                yield piece
        data = member.unused_data.lstrip(b"\0")
        while not data:
            more = read(CHUNK)
            if not more:
                return
            data = more.lstrip(b"\0")


class Records:
    """The records of an archive, one by one; the block of each has to be gone through before the next."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def _more(self) -> bool:
        piece = next(self.pieces, b"")
        self.held += piece
        return bool(piece)

    def __iter__(self) -> Iterator[tuple[Headers, Iterator[bytes]]]:
        while True:
            while (end := self.held.find(b"\r\n\r\n")) < 0 and self._more():
                pass
            if end < 0:
                if self.held.strip(b"\r\n"):
                    raise ValueError("the archive ends within a record's head")
                return
            first, *lines = self.held[:end].decode("utf-8", "replace").split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"not a WARC record: {first[:40]!r}")
            self.held = self.held[end + 4 :]
            headers = [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in lines)]
            self.left = int(value_of(headers, "Content-Length") or 0)
            yield headers, self._block()
            if self.left:
                raise ValueError("a record's block was not gone through")
            while len(self.held) < 4 and self._more():
                pass
            if self.held[:4] != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            self.held = self.held[4:]

    def _block(self) -> Iterator[bytes]:
        while self.left:
            if not self.held and not self._more():
                raise ValueError("the archive ends within a record's block")
            piece, self.held = self.held[: self.left], self.held[self.left :]
            self.left -= len(piece)
            yield piece


def files_at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(names)], names=[n for n, _ in names])


MANIFEST = "archive string, number long, key long, digest string, payload_bytes long"


def write_pages(pages: DataFrame, to: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str | None = None, level: int = 1) -> DataFrame:
    """Write pages to archives in the folder `to`, each one gzip stream; MANIFEST, a row for each record, written."""
    has_columns(pages, key, url, payload)
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = files_at(to)
        files.create_dir(root, recursive=True)
        sink, archive, number, raw = None, "", 0, 0
        for batch in batches:
            rows = []
            for k, u, body in zip(*(batch.column(i) for i in range(3)), strict=True):
                if sink is None or raw > ARCHIVE_BYTES:
                    if sink:
                        sink.end()
                        sink.close()
                    archive, number, raw = f"{TaskContext.get().partitionId():06}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = Sink(files, f"{root}/{archive}", level)
                    sink.begin()
                    about = b"software: assay\r\nformat: WARC File Format 1.1\r\n"
                    sink.write(head_of([("WARC-Type", INFO), ("WARC-Record-ID", record_id(archive, -1)), ("WARC-Date", date), ("WARC-Filename", archive), ("Content-Type", "application/warc-fields")], len(about)) + about + b"\r\n\r\n")
                data, at = body.as_py() or b"", address(u.as_py())
                digest, top = digest_of(data), http_head(len(data))
                headers = [("WARC-Type", RESPONSE), ("WARC-Record-ID", record_id(archive, number)), ("WARC-Date", date)]
                headers += [("WARC-Target-URI", at)] if at else []
                headers += [("WARC-Payload-Digest", f"sha1:{digest}"), (KEY, "" if k.as_py() is None else str(k.as_py())), ("Content-Type", "application/http; msgtype=response")]
                head = head_of(headers, len(top) + len(data))
                sink.write(head + top)
                for i in range(0, len(data), CHUNK):
                    sink.write(data[i : i + CHUNK])
                sink.write(b"\r\n\r\n")
                rows.append((archive, number, k.as_py(), digest, len(data)))
                number, raw = number + 1, raw + len(head) + len(top) + len(data)
            yield _batch(rows, MANIFEST)
        if sink:
            sink.end()
            sink.close()

    return materialize(pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(payload).cast("string").cast("binary")).mapInArrow(run, MANIFEST))


def decisions(manifest: DataFrame, least: int = 0) -> DataFrame:
    """(archive, number, keep, first, first_key): whether a record stays a response, and else the place and key of the one it revisits."""
    rank = F.struct(F.col("key").isNotNull().alias("has"), F.col("key").alias("key"), F.col("archive").alias("archive"), F.col("number").alias("number"))
    first = materialize(manifest.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max(rank).alias("first")))
    found = manifest.join(first, "digest", "left")
    same = (F.col("first.archive") == F.col("archive")) & (F.col("first.number") == F.col("number"))
    keep = (F.col("payload_bytes") < least) | same
    return found.select("archive", "number", keep.alias("keep"), F.col("first.archive").alias("first_archive"), F.col("first.number").alias("first_number"), F.col("first.key").alias("first_key"))


def rewrite(read: Callable[[int], bytes], sink: Sink, told: Iterable[tuple] | None = None) -> Iterator[dict]:
    """Write each record as a member of its own; yields its line of the index.

    told: for each record that is not of type warcinfo, in order, (number, keep, place of the first, its key).
    """
    told = None if told is None else iter(told)
    count = 0
    for headers, block in Records(inflated(read)):
        kind, top = value_of(headers, "WARC-Type"), None
        if kind != INFO and told is not None:
            number, keep, first, first_key = next(told, (None,) * 4)
            if number != count:
                raise ValueError(f"record {count} is not in the manifest")
            count += 1
            if not keep:
                head = b""
                for piece in block:  # the HTTP head stays, the payload goes
                    if top is None:
                        head += piece
                        end = head.find(b"\r\n\r\n")
                        top = head[: end + 4] if end >= 0 else None
                top = top or b""
                refers = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*first)), (REFERS, "" if first_key is None else str(first_key))]
                headers = [(n, REVISIT if n.lower() == "warc-type" else v) for n, v in headers] + refers
                kind = REVISIT
        sink.begin()
        sink.write(head_of(headers, int(value_of(headers, "Content-Length") or 0) if top is None else len(top)))
        for piece in block if top is None else (top,):
            sink.write(piece)
        sink.write(b"\r\n\r\n")
        offset, length = sink.end()
        yield {"offset": offset, "length": length, "type": kind, "id": value_of(headers, "WARC-Record-ID"), "digest": value_of(headers, "WARC-Payload-Digest"), "uri": value_of(headers, "WARC-Target-URI")}
    if told is not None and next(told, None) is not None:
        raise ValueError("the manifest has more records than the archive")


ARCHIVES = "archive string, records long, bytes long"


def normalise(archives: DataFrame, source: str, to: str, level: int = 6) -> DataFrame:
    """Rewrite archives of the folder `source` into `to`, each with an index beside it; ARCHIVES, written.

    archives: what decisions() gives, or just the names (column archive) of archives whose records all stay as they are.
    """
    has_columns(archives, "archive")
    told = "number" in archives.columns
    if not told:
        archives = archives.select("archive").distinct()
    parts = max(1, min(PARTITIONS, archives.select("archive").distinct().count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (files, root), (outs, at) = files_at(source), files_at(to)
        outs.create_dir(at, recursive=True)
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for archive, own in itertools.groupby(rows, lambda r: r[0]):
            name = f"{archive.split('.')[0]}-{uuid.uuid4().hex[:8]}.warc.gz"
            sink, records = Sink(outs, f"{at}/{name}", level), 0
            steps = ((n, keep, (a, i), k) for _, n, keep, a, i, k in own) if told else None
            with files.open_input_stream(f"{root}/{archive}", compression=None) as f, outs.open_output_stream(f"{at}/{name}.idx", compression=None) as index:
                for line in rewrite(f.read, sink, steps):
                    index.write(json.dumps(line).encode() + b"\n")
                    records += 1
            sink.close()
            yield _batch([(name, records, sink.size)], ARCHIVES)

    order = ["archive", "number"] if told else ["archive"]
    return materialize(archives.repartitionByRange(parts, "archive").sortWithinPartitions(*order).mapInArrow(run, ARCHIVES))


RECORDS = "archive string, offset long, length long, record_type string, key long, refers_to long, payload_bytes long, payload_digest string, target_uri string"


def record_at(read_at: Callable[[int, int], bytes], offset: int, length: int) -> tuple[Headers, bytes]:
    """One record by its place in an archive."""
    data = read_at(length, offset)
    records = iter(Records(iter([zlib.decompress(data, 31)])))
    headers, block = next(records)
    body = b"".join(block)
    if next(records, None) is not None:
        raise ValueError("more than one record in a member")
    return headers, body


def read_records(archives: DataFrame, at: str) -> DataFrame:
    """RECORDS, a row for each record but those of type warcinfo, read by the indexes beside the archives in the folder `at`.

    Digest and length of a response are worked out from its payload, those of a revisit are what it says of the payload that it refers to.
    """
    has_columns(archives, "archive")
    parts = max(1, min(PARTITIONS, archives.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = files_at(at)
        for archive in (a for b in batches for a in b.column(0).to_pylist()):
            with files.open_input_stream(f"{root}/{archive}.idx", compression=None) as f, files.open_input_file(f"{root}/{archive}") as data:
                lines, rest = [], b""
                while piece := f.read(CHUNK):
                    *lines, rest = (rest + piece).split(b"\n")
                    rows = []
                    for line in map(json.loads, lines):
                        if line["type"] == INFO:
                            continue
                        headers, body = record_at(data.read_at, line["offset"], line["length"])
                        head, _, payload = body.partition(b"\r\n\r\n")
                        said = (value_of(headers, "WARC-Payload-Digest") or "").removeprefix("sha1:")
                        size, digest = len(payload), said
                        if line["type"] == REVISIT:
                            size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
                        elif (digest := digest_of(payload)) != said:
                            raise ValueError(f"{archive}: the payload at {line['offset']} is not what its digest says")
                        number = lambda name, headers=headers: int(v) if (v := value_of(headers, name)) else None
                        rows.append((archive, line["offset"], line["length"], value_of(headers, "WARC-Type"), number(KEY), number(REFERS), size, digest, value_of(headers, "WARC-Target-URI")))
                    yield _batch(rows, RECORDS)

    return archives.select("archive").repartitionByRange(parts, "archive").mapInArrow(run, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """RECORDS of pages that were written to archives, normalised with equal payloads as revisits, and read back by the indexes."""
    raw, done = folder(spark, "warc"), folder(spark, "warc")
    manifest = write_pages(pages, raw, key, url, payload)
    archives = normalise(decisions(manifest, least), raw, done)
    forget(spark, raw)
    return read_records(archives, done)

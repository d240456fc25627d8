"""Payloads of files that are read by position: beginning, end and directory, never the whole.

A located payload has, beside the columns of a payload, its path; content is only its
beginning.  What else its type and findings need is read by seeking: its end, the names in
a ZIP file's directory, the streams of a compound file.  Files of any size pass, as nothing
of the size of a file is ever held.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.polyglot import TAIL
from assay.functions.ship import ship
from assay.functions.stores import opened
from assay.operators.containers import ole_listing, zip_listing

LOCATED = ("path", "tail", "listed", "streams")
SCHEMA = "payload_id string, filename string, content_type string, size long, oversized boolean, content binary, path string, tail binary, listed struct<names:array<string>,mimetype:string>, streams array<string>"
#: Bytes of parts, and of names that are read, that are handed on together.
TOGETHER = 1 << 20
_ARROW = pa.schema([
    ("payload_id", pa.string()), ("filename", pa.string()), ("content_type", pa.string()), ("size", pa.int64()), ("oversized", pa.bool_()), ("content", pa.binary()), ("path", pa.string()), ("tail", pa.binary()),
    ("listed", pa.struct([("names", pa.list_(pa.string())), ("mimetype", pa.string())])), ("streams", pa.list_(pa.string())),
])


def spread_out(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows that stand for files, dealt evenly: what they cost has nothing to do with their own size."""
    spark = files.sparkSession
    return files.repartition(partitions or max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def located_batches(found: Iterator[dict | None]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA, TOGETHER bytes at a time; None gives no row."""
    rows, held = [], 0
    for row in found:
        if row is None:
            continue
        rows.append(row)
        names = (row.get("listed") or {}).get("names") or row.get("streams") or ()
        held += len(row["content"]) + len(row.get("tail") or b"") + sum(map(len, names))
        if held > TOGETHER:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def locate(files: DataFrame, head: int = 1 << 20, tail: int = TAIL, max_size: int | None = None, partitions: int | None = None) -> DataFrame:
    """Located payloads of files (path, size); a file that is gone by then gives no row, one over max_size is not read."""
    ship(files.sparkSession)

    def one(path: str, listed_size: int) -> dict | None:
        row = {"payload_id": path, "path": path, "filename": unquote(path.rsplit("/", 1)[-1]), "size": listed_size, "oversized": max_size is not None and listed_size > max_size, "content": b""}
        if row["oversized"]:
            return row
        try:
            with opened(path) as f:
                content = f[:head]
                names = zip_listing(f, content)
                return row | {"size": len(f), "content": content, "tail": f[max(0, len(f) - tail) :], "listed": names and dict(zip(("names", "mimetype"), names, strict=True)), "streams": ole_listing(f, content)}
        except FileNotFoundError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        return located_batches(one(*x) for x in listed)

    return spread_out(files.select("path", "size"), partitions).mapInArrow(run, SCHEMA)


def with_content(files: DataFrame, most: int, path: str = "path", to: str = "content") -> DataFrame:
    """files with the whole content of each in a column; null where it is over `most` bytes."""
    ship(files.sparkSession)
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(path)
        for batch in batches:
            for i in range(batch.num_rows):  # one file's bytes at a time
                with opened(batch.column(at)[i].as_py()) as f:
                    body = f[:] if len(f) <= most else None
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([body], pa.binary())], names=[*names, to])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return spread_out(files).mapInArrow(run, f"{kinds}, `{to}` binary")

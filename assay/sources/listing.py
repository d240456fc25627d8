"""Listings of folders as a data source: tasks list, the driver only finds enough folders to share out.

A partition is a folder, with all below it or by itself.  The driver lists folders from the
roots down until there are `folders` of them (64 unless told otherwise) and no further.
Files of no bytes are listed like all others; names that begin with `.` or `_` are not.

As a stream, an offset is a point in time, and a batch lists what was changed between two
of them.  A file that is renamed into the folder keeps its time and may come to be seen
late, so each batch looks back over the time `late` and the same file is let through
once, by Structured Streaming's own memory of that time.  A file that is older than that
when it comes to be seen is missed; one that is written to again is another file.
"""

from __future__ import annotations

import datetime
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from assay.functions.ship import ship
from assay.functions.stores import address, store

NAME = "assay_listing"
SCHEMA = "path string, modificationTime timestamp, size long"
FOLDERS = 64
#: Files in one batch of rows.
TOGETHER = 10_000
_ARROW = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("size", pa.int64())])


@dataclass
class Folder(InputPartition):
    root: str
    path: str
    recursive: bool
    since: int | None = None  # microseconds; files changed after this,
    until: int | None = None  # and not after this


def _hidden(name: str) -> bool:
    return name.startswith((".", "_"))


def folders(roots: list[str], least: int) -> list[Folder]:
    """Folders that together hold all files below the roots, at least so many if there are so many."""
    waiting, done = [], []
    for root in roots:
        files, path = store(root)
        kind = files.get_file_info(path).type
        if kind == fs.FileType.NotFound:
            raise FileNotFoundError(root)
        (waiting if kind == fs.FileType.Directory else done).append(Folder(root, path, kind == fs.FileType.Directory))
    while waiting and len(waiting) + len(done) < least:
        folder = waiting.pop(0)
        below = store(folder.root)[0].get_file_info(fs.FileSelector(folder.path))
        waiting += [Folder(folder.root, i.path, True) for i in below if i.type == fs.FileType.Directory and not _hidden(i.base_name)]
        done.append(Folder(folder.root, folder.path, False))
    return done + waiting


def _listed(folder: Folder) -> Iterator[pa.RecordBatch]:
    files, _ = store(folder.root)
    found = files.get_file_info(folder.path)
    infos = [found] if found.type == fs.FileType.File else files.get_file_info(fs.FileSelector(folder.path, recursive=folder.recursive, allow_not_found=True))
    rows: list[tuple] = []
    for i in infos:
        if i.type != fs.FileType.File or i is not found and any(_hidden(x) for x in i.path[len(folder.path) :].strip("/").split("/")):
            continue
        changed = (i.mtime_ns or 0) // 1000
        if folder.since is not None and not folder.since < changed <= folder.until:
            continue
        rows.append((address(folder.root, i.path), changed, i.size))
        if len(rows) == TOGETHER:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    paths, changed, sizes = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(changed, pa.int64()).cast(pa.timestamp("us", "UTC")), pa.array(sizes, pa.int64())], schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots, self.least = json.loads(options["roots"]), int(options.get("folders", FOLDERS))

    def partitions(self) -> list[Folder]:
        return folders(self.roots, self.least)

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return _listed(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.roots, self.least, self.late = json.loads(options["roots"]), int(options.get("folders", FOLDERS)), int(float(options["late"]) * 1e6)

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() // 1000}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        since = start["until"] - self.late if start["until"] else -1
        return [Folder(f.root, f.path, f.recursive, since, end["until"]) for f in folders(self.roots, self.least)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return _listed(partition)


class Listing(DataSource):
    """Options: roots (JSON list of addresses), folders, late (seconds; streams)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options)


def _options(paths: str | list[str], least: int) -> dict[str, str]:
    return {"roots": json.dumps([paths] if isinstance(paths, str) else list(paths)), "folders": str(least)}


def list_files(spark: SparkSession, paths: str | list[str], least: int = FOLDERS) -> DataFrame:
    """(path, modificationTime, size) of all files below paths, those of no bytes too."""
    ship(spark)
    spark.dataSource.register(Listing)
    return spark.read.format(NAME).options(**_options(paths, least)).load()


def stream_files(spark: SparkSession, paths: str | list[str], late: datetime.timedelta = datetime.timedelta(hours=1), least: int = FOLDERS) -> DataFrame:
    """The same as a stream: each file once, and again whenever it was written to."""
    ship(spark)
    spark.dataSource.register(Listing)
    seconds = late.total_seconds()
    files = spark.readStream.format(NAME).options(late=str(seconds), **_options(paths, least)).load()
    # a second more than is looked back: what is listed again is still remembered
    return files.withWatermark("modificationTime", f"{int(seconds * 1000) + 1000} milliseconds").dropDuplicatesWithinWatermark(["path", "modificationTime"])

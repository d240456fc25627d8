"""Payloads as files of a folder: a data source that is written to.

Each task writes its files to a folder of its own beside the others, under `_pending`.  When
all tasks are done the driver moves these folders to their places, part-00000 and so on; if
the job fails it removes them.  A task that fails removes its own at once, what a lost
one leaves behind goes with the job's, and one that is late finds no folder to write to.  A file's name is its number in the task and the
name it was given, so that equal names stand side by side; `_index.jsonl` in each part tells
which payload a file is of.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from assay.functions.ship import ship
from assay.functions.stores import store

NAME = "assay_folder"


@dataclass
class _Part(WriterCommitMessage):
    path: str | None
    number: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, uri: str, overwrite: bool):
        self.uri, self.overwrite, self.job = uri, overwrite, uuid.uuid4().hex

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        files, root = store(self.uri)
        root = root.rstrip("/")
        return files, root, f"{root}/_pending/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        files, _, pending = self._places()
        number = TaskContext.get().partitionId()
        at = f"{pending}/{number}-{uuid.uuid4().hex}"
        lines: list[str] = []
        try:
            for batch in iterator:
                for payload, name, content in zip(*(batch.column(c) for c in ("payload_id", "name", "content")), strict=True):
                    if not lines:
                        files.create_dir(at, recursive=False)  # fails once the job has been given up
                    given = re.sub(r"[/\\\x00]", "_", name.as_py() or "")
                    file = f"{len(lines):06}" + (f"-{given}" if given else "")
                    with files.open_output_stream(f"{at}/{file}", compression=None) as out:
                        out.write(content.as_buffer() if content.is_valid else b"")
                    lines.append(json.dumps({"payload_id": payload.as_py(), "file": file}))
            if lines:
                with files.open_output_stream(f"{at}/_index.jsonl", compression=None) as out:
                    out.write("".join(f"{x}\n" for x in lines).encode())
        except BaseException:
            _delete(files, at)
            raise
        return _Part(at if lines else None, number)

    def commit(self, messages: list[_Part | None]) -> None:
        files, root, pending = self._places()
        old = {i.base_name: i.path for i in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.Directory and re.fullmatch(r"part-\d+", i.base_name)}
        if self.overwrite:
            for path in old.values():
                files.delete_dir(path)
            old = {}
        first = max((int(n[5:]) + 1 for n in old), default=0)
        parts = sorted((m for m in messages if m is not None and m.path), key=lambda m: m.number)
        files.create_dir(root, recursive=True)
        for i, part in enumerate(parts):
            _move(files, part.path, f"{root}/part-{first + i:05}")
        _delete(files, pending)

    def abort(self, messages: list[_Part | None]) -> None:
        files, _, pending = self._places()
        _delete(files, pending)


def _delete(files: fs.FileSystem, path: str) -> None:
    """Remove a folder, and the one above if nothing else is in it."""
    if files.get_file_info(path).type == fs.FileType.Directory:
        files.delete_dir(path)
    above = path.rsplit("/", 1)[0]
    if above.endswith("/_pending") and not files.get_file_info(fs.FileSelector(above, allow_not_found=True)):
        if files.get_file_info(above).type == fs.FileType.Directory:
            files.delete_dir(above)


def _move(files: fs.FileSystem, old: str, new: str) -> None:
    try:
        files.move(old, new)
    except (NotImplementedError, OSError):  # stores without folders move file by file
        files.create_dir(new, recursive=True)
        for i in files.get_file_info(fs.FileSelector(old)):
            files.move(i.path, f"{new}/{i.base_name}")


class Folder(DataSource):
    """Option path; rows of payload_id, name and content."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "payload_id string, name string, content binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        writer = _Writer(self.options["path"], overwrite)
        files, _, pending = writer._places()
        files.create_dir(pending, recursive=True)
        return writer


def write_files(rows: DataFrame, path: str, name: str = "filename", content: str = "content", payload_id: str = "payload_id", mode: str = "append") -> None:
    """Each row's content as a file in the folder at path."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(Folder)
    column = lambda c, kind, to: F.col(c).cast(kind).alias(to)
    rows.select(column(payload_id, "string", "payload_id"), column(name, "string", "name"), column(content, "binary", "content")).write.format(NAME).option("path", path).mode(mode).save()


def write_sanitized_files(results: DataFrame, path: str, mode: str = "append") -> None:
    """The bytes of the files that were put right, each as a file under its safe name."""
    write_files(results.where(F.col("sanitized").isNotNull()), path, "safe_filename", "sanitized", mode=mode)

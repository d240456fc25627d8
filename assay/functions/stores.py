"""Files by position, in any store that Arrow reaches by its address."""

from __future__ import annotations

import io
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path within it."""
    return fs.FileSystem.from_uri(uri)


def address(uri: str, path: str) -> str:
    """The address of a path in the file system of uri; signs that have a meaning in addresses are percent-encoded."""
    scheme, mark, rest = uri.partition("://")
    path = quote(path, safe="/:@!$&'()*+,;=~")
    if not mark:
        return f"file://{path}"
    host = "" if scheme == "file" else rest.split("/", 1)[0]
    inside = path.removeprefix(f"{host}/") if host and not path.startswith("/") else path.lstrip("/")
    return f"{scheme}://{host}/{inside}"


class Ranged:
    """A file that is sliced like bytes; a slice is all that is read of it."""

    def __init__(self, file, size: int | None = None):
        self.file, self.size = file, file.size() if size is None else size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: slice) -> bytes:
        start, stop, _ = at.indices(self.size)
        return self.file.read_at(stop - start, start) if stop > start else b""


class _Seekable(io.RawIOBase):
    """A file by position as the standard library reads files; a place before its beginning is its beginning, as with bytes in memory."""

    def __init__(self, content: Ranged):
        self.content, self.at = content, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, offset + (0, self.at, len(self.content))[whence])
        return self.at

    def readinto(self, buffer) -> int:
        data = self.content[self.at : self.at + len(buffer)]
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


@contextmanager
def opened(uri: str) -> Iterator[Ranged]:
    files, path = store(uri)
    with files.open_input_file(path) as f:
        yield Ranged(f)


def seekable(content: bytes | Ranged):
    """What the readers of the standard library take."""
    return io.BufferedReader(_Seekable(content), 1 << 16) if isinstance(content, Ranged) else io.BytesIO(content)

"""Files by path or URI for sources that read byte ranges and sinks that commit: whatever ``pyarrow.fs`` opens."""

from __future__ import annotations

import contextlib
import posixpath
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def files_of(path: str) -> list[tuple[str, int]]:
    """Path and size of a file, or of all files below a folder but those whose name begins with ``_`` or ``.``; none where there is nothing."""
    system, at = place_of(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    if info.type == fs.FileType.NotFound:
        return []
    base = info.path.rstrip("/")
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    hidden = lambda p: any(x[:1] in "_." for x in p[len(base) :].strip("/").split("/"))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path))


class Ranges:
    """An open file that counts the bytes that are read from it; ``gz`` files are unpacked in memory."""

    def __init__(self, root: str, path: str) -> None:
        system = place_of(root)[0]
        self.bytes_read = 0
        if path.endswith(".gz"):
            with system.open_input_stream(path, compression="gzip") as stream:
                self._file: BinaryIO = pa.BufferReader(stream.read())
        else:
            self._file = system.open_input_file(path)

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_: object) -> None:
        self._file.close()

    def seek(self, place: int, whence: int = 0) -> int:
        return self._file.seek(place, whence)

    def read(self, size: int) -> bytes:
        data = self._file.read(size)
        self.bytes_read += len(data)
        return data

    def at(self, place: int, size: int) -> bytes:
        """A range; ``ValueError`` if the file ends before."""
        self.seek(place)
        data = self.read(size)
        if len(data) < size:
            raise ValueError(f"{len(data)} of {size} bytes at {place}")
        return data


class Output:
    """Where a job's tasks write files that appear only when the job commits.

    Each attempt of a task has names of its own below ``_temporary-<job>``; the commit moves the files of the
    attempts that succeeded, by a rename each, and an abort or a lost executor leaves nothing in view.
    """

    def __init__(self, root: str, overwrite: bool) -> None:
        self.root, self.overwrite, self.job = root, overwrite, uuid.uuid4().hex
        self.temporary = posixpath.join(place_of(root)[1].rstrip("/"), f"_temporary-{self.job}")

    @contextlib.contextmanager
    def create(self, suffix: str) -> Iterator[tuple[str, BinaryIO]]:
        """A new file of this attempt: its name in the end, and the stream to write it to."""
        system, _ = place_of(self.root)
        name = f"part-{uuid.uuid4().hex}{suffix}"
        system.create_dir(self.temporary, recursive=True)
        with system.open_output_stream(posixpath.join(self.temporary, name)) as stream:
            yield name, stream

    def commit(self, names: list[str]) -> None:
        system, at = place_of(self.root)
        system.create_dir(at, recursive=True)
        before = [p for p, _ in files_of(self.root)] if self.overwrite else []
        for name in names:
            system.move(posixpath.join(self.temporary, name), posixpath.join(at.rstrip("/"), name))
        for path in before:
            system.delete_file(path)
        self.abort()

    def abort(self) -> None:
        system, _ = place_of(self.root)
        if system.get_file_info(self.temporary).type != fs.FileType.NotFound:
            system.delete_dir(self.temporary)

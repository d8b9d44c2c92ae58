"""Files that tasks write and read by URI: local or remote, atomic per attempt, mapped where possible."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse


def file_system(uri: str):
    """(pyarrow file system, path) of a URI or an absolute path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


class NewFile:
    """A file under a name no other attempt of the task uses.

    The name reaches readers only in the rows that the finished task returns, so a lost or repeated
    attempt leaves at most a file that nothing refers to.
    """

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"
        self.system, path = file_system(self.uri)
        self.system.create_dir(os.path.dirname(path), recursive=True)
        self.stream = self.system.open_output_stream(path, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()


def open_for_ranges(uri: str):
    system, path = file_system(uri)
    return system.open_input_file(path)


def mapped(uri: str) -> mmap.mmap:
    """The file in mapped memory; a remote one by way of an unnamed local copy that goes with the process."""
    from pyarrow import fs

    system, path = file_system(uri)
    if isinstance(system, fs.LocalFileSystem):
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    with tempfile.TemporaryFile() as copy, system.open_input_stream(path) as source:
        while block := source.read(8 << 20):
            copy.write(block)
        copy.flush()
        return mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ)
